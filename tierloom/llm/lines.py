"""Line dedup with a log-template tree, in DataFrame functions only.

A line descends a tree of fixed depth: by its number of tokens, then by its `DEPTH` leading tokens; a token with a digit is a
variable field from the start. Leaves whose lines stand in fewer than `MIN_DOCS` documents are left alone. In the others a token
is constant at its position if lines of `MIN_DOCS` documents have it there, and a variable field otherwise. A line's template is
the line with its variable fields masked. It is recurring, and its lines are dropped from every document, if `MIN_CONSTANT` of
its tokens are constant and lines of `MIN_DOCS` documents have this very template; so is a line that stands word for word in
`MIN_DOCS` documents, whatever its digits.

Lines are split at line feeds; tokens at spaces and tabs. Blank lines stay. Null and empty texts have no lines. Rows equal in id
and text are one document and lose the same lines. Results do not depend on the order of rows, so ties need no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, read, row_key, settle, sifted

DEPTH, MIN_DOCS, MIN_CONSTANT = 3, 3, 0.7
MASK = "<*>"


def _tokens(line: str) -> Column:
    return F.array_remove(F.split(F.col(line), "[ \t]+"), "")


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), MASK).otherwise(t))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row key, n (the line's number from 0), line and leaf of every line that is not blank."""
    each = docs.where(F.length(text_col) > 0).select(*row_key(id_col, text_col), F.posexplode_outer(F.split(text_col, "\n")).alias("n", "line"))
    each = each.withColumn("tokens", _tokens("line")).where(F.size("tokens") > 0)
    lead = F.array_join(_masked(F.slice("tokens", 1, DEPTH)), " ")
    return each.select(*KEY, "n", "line", F.xxhash64(F.size("tokens"), lead).alias("leaf"))


def _recurring(rows: DataFrame, name: str) -> DataFrame:
    """The values of a column that stand in MIN_DOCS documents or more."""
    return rows.select(name, *KEY).distinct().groupBy(name).count().where(F.col("count") >= MIN_DOCS).select(name)


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row key, n, line and template of every line to drop."""
    every = lines(docs, id_col, text_col)
    leaves = settle(_recurring(every, "leaf"), "leaves")
    shared = settle(sifted(every, leaves, "leaf").join(leaves, "leaf").select(*KEY, "n", "line", "leaf", F.xxhash64("leaf", "line").alias("text")), "lines")
    # a text that recurs word for word is told by its hash alone; its tokens are constant wherever its leaf has them
    whole = settle(_recurring(shared, "text"), "whole")
    one = shared.join(whole, "text", "left_semi").groupBy("text").agg(F.min("line").alias("line"), F.min("leaf").alias("leaf"))
    one = settle(one.select("text", "line", "leaf", _masked(_tokens("line")).alias("tokens")), "one")
    rest = settle(shared.join(whole, "text", "left_anti").select(*KEY, "text", "line", "leaf"), "rest")
    slot = lambda df, *c: df.select(*c, F.posexplode("tokens").alias("at", "token")).where(F.col("token") != MASK).withColumn("slot", F.xxhash64("leaf", "at", "token"))
    held = slot(rest.select(*KEY, "leaf", _masked(_tokens("line")).alias("tokens")), *KEY, "leaf").select("slot", *KEY)
    constant = slot(one, "leaf").select("slot").unionByName(_recurring(held, "slot")).distinct()
    texts = rest.groupBy("text").agg(F.min("line").alias("line"), F.min("leaf").alias("leaf")).select("text", "leaf", _masked(_tokens("line")).alias("tokens"))
    kept = slot(texts, "text", "leaf").join(settle(constant, "constant"), "slot").groupBy("text").agg(F.array_sort(F.collect_list("at")).alias("constants"))
    near = kept.join(texts, "text").where(F.size("constants") >= MIN_CONSTANT * F.size("tokens"))
    masked = F.transform("tokens", lambda t, i: F.when(F.array_contains("constants", i), t).otherwise(MASK))
    near = near.select("text", "leaf", F.array_join(masked, " ").alias("template"))
    near = settle(near.withColumn("shape", F.xxhash64("leaf", "template")), "near")
    # the template of a text that recurs word for word recurs too, if enough of it is constant
    own = F.filter("tokens", lambda t: t != MASK)
    sure = one.where(F.size(own) >= MIN_CONSTANT * F.size("tokens")).select(F.xxhash64("leaf", F.array_join("tokens", " ")).alias("shape"))
    often = settle(_recurring(rest.join(near.select("text", "shape"), "text"), "shape").unionByName(sure).distinct(), "often")
    drop = near.join(often, "shape", "left_semi").select("text", "template").unionByName(one.select("text", F.array_join(_tokens("line"), " ").alias("template")))
    found = shared.select(*KEY, "n", "line", "text").join(settle(drop, "drop"), "text")
    if not shared.groupBy(*KEY, "n").count().where("count > 1").isEmpty():  # rows that are equal throughout
        found = found.dropDuplicates([*KEY, "n"])
    return found.select(*KEY, "n", "line", "template")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without their recurring lines; a document that loses all lines stays, with an empty text."""
    gone = recurring(docs, id_col, text_col).groupBy(*KEY).agg(F.collect_set("n").alias("gone"))
    own = docs.select(F.struct("*").alias("_row"), *row_key(id_col, text_col)).join(gone, KEY, "left")
    text = F.col(f"_row.{text_col}")
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i))
    row = F.col("_row").withField(text_col, F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n")))
    return own.select(row.alias("_row")).select("_row.*")


def op4_lines(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    gone = recurring(docs).groupBy(*KEY).agg(
        F.count("*").alias("dropped"),
        F.sum(F.char_length("line")).alias("chars"),
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", *row_key("doc_id", "text"), F.when(F.length(text) > 0, F.size(F.split(text, "\n"))).otherwise(0).cast("long").alias("n_lines"), F.char_length(text).cast("long").alias("n_chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return own.join(gone, KEY, "left").select("doc_id", "n_lines", zero("dropped"), (F.col("n_chars") - F.coalesce("chars", F.lit(0))).cast("long").alias("kept_chars"))


OP4_SQL = f"""
WITH l AS (SELECT doc_id, text AS doc, n, line, list_filter(regexp_split_to_array(line, '[ \t]+'), lambda x: x <> '') AS words
           FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE length(text) > 0)),
t AS (SELECT *, [CASE WHEN regexp_matches(x, '[0-9]') THEN '{MASK}' ELSE x END FOR x IN words] AS tokens FROM l WHERE len(words) > 0),
g AS (SELECT *, tokens[1:{DEPTH}] AS lead, len(tokens) AS size FROM t),
leaves AS (SELECT size, lead FROM g GROUP BY size, lead HAVING count(DISTINCT (doc_id, doc)) >= {MIN_DOCS}),
s AS (SELECT g.* FROM g JOIN leaves USING (size, lead)),
same AS (SELECT line FROM s GROUP BY line HAVING count(DISTINCT (doc_id, doc)) >= {MIN_DOCS}),
k AS (SELECT DISTINCT doc_id, doc, size, lead, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM s),
c AS (SELECT size, lead, pos, token FROM k WHERE token <> '{MASK}' GROUP BY ALL HAVING count(DISTINCT (doc_id, doc)) >= {MIN_DOCS}),
u AS (SELECT size, lead, line, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM (SELECT DISTINCT size, lead, line, tokens FROM s)),
m AS (SELECT size, lead, line, count(one) AS constants, string_agg(CASE WHEN one = 1 THEN u.token ELSE '{MASK}' END, ' ' ORDER BY u.pos) AS template
      FROM u LEFT JOIN (SELECT *, 1 AS one FROM c) USING (size, lead, pos, token) GROUP BY size, lead, line),
often AS (SELECT size, lead, template FROM s JOIN m USING (size, lead, line) WHERE constants >= {MIN_CONSTANT} * size GROUP BY ALL HAVING count(DISTINCT (doc_id, doc)) >= {MIN_DOCS}),
x AS (SELECT line FROM m JOIN often USING (size, lead, template) WHERE constants >= {MIN_CONSTANT} * size UNION SELECT line FROM same),
d AS (SELECT doc_id, doc, count(*) AS dropped, sum(length(line)) AS chars FROM s JOIN x USING (line) GROUP BY doc_id, doc)
SELECT documents.doc_id, CAST(CASE WHEN length(text) > 0 THEN len(string_split(text, chr(10))) ELSE 0 END AS BIGINT) AS n_lines, CAST(coalesce(dropped, 0) AS BIGINT) AS dropped,
       CAST(length(coalesce(text, '')) - coalesce(chars, 0) AS BIGINT) AS kept_chars
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id AND documents.text = d.doc
"""
