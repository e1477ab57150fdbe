"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only.

Every window of an item (10 consecutive words, or the whole of a shorter item) must be contained in full, so the prefix
that a match cannot avoid is one word long: the window's rarest word over all documents. Document words that equal such a
prefix word give candidates; the word's position in the window fixes where the window would start (positional bound), the
document's length must leave room for it (length bound), and the words there are compared one by one.

Nulls have no words, and empty documents get zero counts. Rows that repeat id and text are one document and give equal
rows. Items without words are ignored, a null item id is an empty one; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, LOWER, UPPER, WORD_SEP, alnum_words, read, row_key, settle, without

WINDOW = 10
#: Windows are broadcast while their words take no more bytes and rows than this; beyond it the join shuffles.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 400_000
#: Files of windows and of prefixes that are written while they are that small, however many partitions made them.
FILES = 4


def item_windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The distinct windows of all items: window (array), items (the ids that have it, as strings)."""
    items = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), alnum_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))).alias("at")
    return items.select("item", "words", at).select(F.col("item"), F.slice("words", F.col("at"), window).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))


def _fits(windows: DataFrame) -> bool:
    rows, size = windows.agg(F.count("*"), F.sum(F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " ")))).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def prefixes(docs: DataFrame, windows: DataFrame, small: bool, text_col: str = "text") -> DataFrame:
    """windows with their rarest word and its offset: word, off, window, items. Frequencies are counted over all documents."""
    hint = F.broadcast if small else (lambda x: x)
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    seen = docs.select(F.explode_outer(alnum_words(F.col(text_col))).alias("word")).join(hint(vocabulary), "word").groupBy("word").count()
    each = windows.select("window", "items", F.posexplode("window").alias("off", "word"))
    ranked = each.join(hint(seen) if small else seen, "word", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "off")).alias("first")
    return ranked.groupBy("window").agg(rarest, F.first("items").alias("items")).where("first.n > 0").select("first.word", "first.off", "window", "items")


def matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Verified occurrences of windows: the row's key, start (words from 0), length, items."""
    most = bench.agg(F.sum(F.octet_length(text_col))).first()[0] or 0  # times `window`: the bytes of all windows at most
    windows = settle(item_windows(bench, item_col, text_col, window), "windows", FILES if most * window <= BROADCAST_BYTES else None)
    small = _fits(windows)
    wanted = settle(prefixes(docs, windows, small, text_col), "prefixes", FILES if small else None)
    words = docs.select(*row_key(id_col, text_col), alnum_words(F.col(text_col)).alias("words"))
    placed = words.select(*KEY, "words", F.posexplode_outer("words").alias("pos", "word"))
    start, length = F.col("pos") - F.col("off"), F.size("window")
    if small:
        found = placed.join(F.broadcast(wanted), "word").where((start >= 0) & (start + length <= F.size("words")))
        found = found.where(F.slice("words", F.greatest(start, F.lit(0)) + 1, length) == F.col("window"))
    else:  # each word travels with its neighbourhood, not with its document
        low = F.greatest(F.col("pos") - (window - 1), F.lit(0))
        near = placed.select(*KEY, "pos", "word", low.alias("low"), F.slice("words", low + 1, 2 * window - 1).alias("near"))
        found = near.join(wanted, "word").where(start >= F.col("low"))
        found = found.where(F.slice("near", F.greatest(start - F.col("low"), F.lit(0)) + 1, length) == F.col("window"))
    return found.select(*KEY, start.alias("start"), length.alias("length"), "items")


def scan(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row per contaminated document: its key, n_hit (words inside any occurrence), items (sorted ids), spans."""
    per_doc = matches(docs, bench, id_col, text_col, item_col, window).groupBy(*KEY).agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(acc, x):
        end = (x["start"] + x["length"]).cast("long")
        gain = F.greatest(end - F.greatest(x["start"].cast("long"), acc["end"]), F.lit(0).cast("long"))
        return F.struct((acc["n"] + gain).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return per_doc.withColumn("n_hit", F.aggregate("spans", zero, add, lambda acc: acc["n"]))


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents no window occurs in, with their own columns."""
    return without(docs, matches(docs, bench, id_col, text_col).select(*KEY), row_key(id_col, text_col))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = scan(docs, bench).select(*KEY, "n_hit", "items")
    own = docs.select("doc_id", *row_key("doc_id", "text"), F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    return own.join(found, KEY, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


OP9_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_SEP.replace("[", "[^", 1)}') AS w FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_SEP.replace("[", "[^", 1)}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS g
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
occ AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT o.doc_id, o.i, o.n, win.item FROM occ o JOIN win ON o.g = win.g AND o.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON dw.doc_id = pos.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
