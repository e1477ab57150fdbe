import re

from tierloom.llm import lines


def plain(docs):
    """Indexes of dropped lines by document, from the definition: every template's own documents are counted."""
    docs = list(dict.fromkeys(docs))
    rows = []
    for k, (_, t) in enumerate(docs):
        for n, line in enumerate((t or "").split("\n")):
            w = ["<*>" if re.search("[0-9]", x) else x for x in re.split("[ \t]+", line) if x]
            if w:
                rows.append((k, n, line, w, (len(w), *w[:3])))
    of = lambda pairs: {v: len(s) for v, s in pairs.items()}
    leaf_docs, token_docs, line_docs, template_docs = {}, {}, {}, {}
    for k, _, line, w, leaf in rows:
        leaf_docs.setdefault(leaf, set()).add(k)
        line_docs.setdefault(line, set()).add(k)
        for at, x in enumerate(w):
            token_docs.setdefault((leaf, at, x), set()).add(k)
    token_docs = of(token_docs)
    template = lambda w, leaf: tuple(x if x != "<*>" and token_docs[leaf, at, x] >= 3 else "<*>" for at, x in enumerate(w))
    for k, _, _, w, leaf in rows:
        template_docs.setdefault((leaf, template(w, leaf)), set()).add(k)
    out = {}
    for k, n, line, w, leaf in rows:
        t = template(w, leaf)
        recurs = len(template_docs[leaf, t]) >= 3 and sum(x != "<*>" for x in t) >= 0.7 * len(w)
        if len(leaf_docs[leaf]) >= 3 and (recurs or len(line_docs[line]) >= 3):
            out.setdefault(docs[k], set()).add(n)
    return {d: sorted(v) for d, v in out.items()}


DOCS = [(i, f"unique {'x' * i} words of {i}\nuser {i} logged in from host h{i} at noon today\n\nAll rights reserved.\ncommon line here") for i in range(6)]
DOCS += [(50, "user 9 went somewhere else and never came back home\nAll rights reserved."), (51, "common line"), (52, "two docs\nonly"), (53, "two docs\nonly")]


def test_equals_definition(spark, frame, edge):
    docs = DOCS + edge
    got = {}
    table = frame(docs)
    keys = {(r._k1, r._k2): (r.doc_id, r.text) for r in table.select("doc_id", "text", *lines.row_key("doc_id", "text")).collect()}
    for r in lines.recurring(table).collect():
        got.setdefault(keys[r["_k1"], r["_k2"]], []).append(r["n"])
    assert {k: sorted(v) for k, v in got.items()} == plain(docs)


def test_templates_mask_variable_fields(frame):
    found = {r.template for r in lines.recurring(frame(DOCS)).collect()}
    assert "user <*> logged in from host <*> at noon today" in found


def test_drop_lines(frame, edge):
    table = frame(DOCS + edge)
    kept = lines.drop_lines(table)
    assert kept.columns == table.columns and kept.count() == len(DOCS + edge)
    text = {r.doc_id: r.text for r in kept.where("doc_id < 6 AND doc_id <> 5 OR doc_id >= 50").collect()}
    assert text[4] == "unique xxxx words of 4\n" and text[50] == "user 9 went somewhere else and never came back home" and text[1] is not None
    assert lines.drop_lines(frame([])).count() == 0


def test_templates_of_too_few_documents_stay(frame):
    """A line whose tokens stand pairwise in other documents' lines, but whose template stands in one, and a line of two documents."""
    pairs = [("c1", "d1"), ("e1", "f1"), ("g1", "h1")]
    docs = [(1, "aa bb cq dq eq fq gq hq"), (2, "aa bb cq dq x1q x2q x3q x4q"), (3, "aa bb y1q y2q eq fq y3q y4q"), (4, "aa bb z1q z2q z3q z4q gq hq"), (5, "x y only two"), (6, "x y only two")]
    docs += [(10 + i, f"aa bb {a} {b} here it ends now") for i, (a, b) in enumerate(pairs)]
    gone = {(r.line, r.template) for r in lines.recurring(frame(docs)).collect()}
    assert gone == {(f"aa bb {a} {b} here it ends now", "aa bb <*> <*> here it ends now") for a, b in pairs}


def test_query_equals_sql(spark):
    import duckdb

    duck = duckdb.connect()
    duck.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    got = sorted(tuple(r) for r in lines.op4_lines(spark, "/root/testdata/sf0.01").select("doc_id", "n_lines", "dropped", "kept_chars").collect())
    assert got == sorted(duck.execute(lines.OP4_SQL).fetchall()) and sum(r[2] for r in got) > 100
