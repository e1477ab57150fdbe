"""Queries over the driver's tables, one per operator, each with the DuckDB SQL that checks it.

`part` names are a modifier and a noun; the WIDGETS pack reads them. A batch is made of all parts: some titles and keys are
blanked by rule, a catalog holds the keys of one type, and a fixture stands in for a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import row_digest, tree_digest
from ..functions.text import first_number, first_token, normalize_key, normalize_title, tokens
from ..operators import adapter, bundle, compare, contract, evaluate, registry, rules, tiers, validate
from ..packs import PARTS, WIDGETS, Pack
from ..sources import files
from ..sources.jsonl import object_status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores. Parquet is split by bytes, so a million keys may be one task however much is computed of each."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _long(c) -> F.Column:
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


# ---- the batch over part --------------------------------------------------------------------------------------------

_NOUNS = {"BOLT": ("Bolts", "Fixing"), "RING": ("Rings", "Fixing"), "GEAR": ("Gears", "Moving"), "ROD": ("Rods", "Moving"), "ANVIL": ("Anvils", "Heavy"), "PLATE": ("Plates", "Heavy"), "GIZMO": ("Gizmos", "Misc"), "WIDGET": ("Widgets", "Misc")}
_HITS = " + ".join(f"contains(norm, '{n}')::INT" for n in _NOUNS)
_SUB = "CASE " + " ".join(f"WHEN contains(norm, '{n}') THEN '{s}'" for n, (s, _) in _NOUNS.items()) + " END"
_PHRASE = "CASE " + " ".join(f"WHEN contains(norm, '{n}') THEN '{n}'" for n in _NOUNS) + " END"
_CAT = "CASE " + " ".join(f"WHEN sub = '{s}' THEN '{c}'" for s, c in _NOUNS.values()) + " END"

#: Rules over a table t(id, norm): one row an id with what each step finds.
_RULES = f"""
w AS (SELECT *, string_split(norm, ' ') AS words FROM t),
b AS (SELECT *, list_filter(words, lambda x: regexp_matches(x, '^BRAND#([1-9]|1[0-9]|20)$'))[1] AS alias, {_HITS} AS hits, {_SUB} AS sub0, {_PHRASE} AS phrase FROM w),
c AS (SELECT *, 'Brand#' || substr(alias, 7) AS brand, CASE WHEN hits = 1 THEN sub0 END AS sub FROM b),
d AS (SELECT *, {_CAT} AS cat FROM c),
e AS (SELECT *, lower(list_filter(words, lambda x: x IN ('RED', 'BLUE'))[1]) AS colour,
        CASE WHEN cat <> 'Heavy' THEN CASE list_filter(words, lambda x: x IN ('SMALL', 'LARGE'))[-1] WHEN 'SMALL' THEN 'S' WHEN 'LARGE' THEN 'L' END END AS size,
        list_filter(words, lambda x: x = 'COLD' OR (x = 'NEW' AND cat = 'Heavy'))[1] AS flag_token,
        CASE WHEN alias IS NOT NULL AND sub IS NOT NULL THEN 'rules:brand=' || brand || ';kw=' || phrase || coalesce(';flag=' || list_filter(words, lambda x: x = 'COLD' OR (x = 'NEW' AND cat = 'Heavy'))[1], '') END AS evidence FROM d)
"""
_PART_RULES = "WITH t AS (SELECT p_partkey AS id, upper(p_brand || ' ' || p_name) AS norm FROM part)," + _RULES

#: The batch: raw rows, three tiers and their outcome.
_BATCH = f"""
raw AS (SELECT CAST(p_partkey AS VARCHAR) AS row_id, p_partkey, p_size, p_name,
          CASE WHEN p_partkey % 83 = 0 THEN ' ' ELSE ' p-' || p_partkey || ' ' END AS sku,
          CASE WHEN p_partkey % 97 = 0 THEN '' WHEN p_partkey % 89 = 0 THEN 'ab ' ELSE p_brand || ' ' || p_name END AS title FROM part),
t AS (SELECT row_id AS id, upper(trim(title)) AS norm, * FROM raw),
{_RULES},
fixture AS (SELECT upper(p_brand || ' ' || p_name) AS norm, CASE WHEN max(p_size) > 25 THEN 'Widgets' ELSE 'Unknown' END AS fsub, max(p_size) % 2 = 0 AS fflag FROM part WHERE p_type = 'ECONOMY' GROUP BY 1),
catalog AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN 'Bolts' ELSE 'Anvils' END AS csub, p_size % 2 = 0 AS cflag FROM part WHERE p_type = 'PROMO'),
x AS (SELECT e.*, csub, cflag, fsub, fflag,
        CASE WHEN trim(title) = '' THEN 'empty_title' WHEN length(trim(title)) < 4 THEN 'short_title' WHEN trim(sku) = '' THEN 'missing_sku' END AS bad
      FROM e LEFT JOIN catalog ON trim(e.sku) <> '' AND e.p_partkey = catalog.p_partkey LEFT JOIN fixture ON fixture.norm = e.norm),
y AS (SELECT *, CASE WHEN bad IS NOT NULL THEN NULL WHEN csub = 'Anvils' THEN 'catalog' WHEN evidence IS NOT NULL THEN 'rules' WHEN fsub = 'Widgets' THEN 'model' END AS tier FROM x),
o AS (SELECT *, CASE WHEN bad IS NOT NULL THEN 'quarantined' WHEN tier IS NOT NULL THEN 'decoded' ELSE 'abstained' END AS state,
        CASE tier WHEN 'catalog' THEN 'Heavy' WHEN 'rules' THEN cat WHEN 'model' THEN 'Misc' END AS o_cat,
        CASE tier WHEN 'catalog' THEN 'Anvils' WHEN 'rules' THEN sub WHEN 'model' THEN 'Widgets' END AS o_sub,
        CASE WHEN tier = 'rules' THEN colour END AS o_colour, CASE WHEN tier = 'rules' THEN size END AS o_size,
        CASE tier WHEN 'catalog' THEN cflag WHEN 'rules' THEN flag_token IS NOT NULL WHEN 'model' THEN fflag END AS o_flag,
        bad IS NULL AND csub = 'Bolts' AS inv_catalog, bad IS NULL AND tier IS NULL AND fsub = 'Unknown' AS inv_model FROM y)
"""
#: The gold set: every part; labels from the name alone.
_GOLD = f"""
{_BATCH},
g0 AS (SELECT row_id, upper(p_name) AS norm, p_partkey, p_name FROM raw),
g1 AS (SELECT *, CASE WHEN p_partkey % 30 = 0 THEN 'abstain' ELSE 'decode' END AS expect, {_SUB} AS sub FROM g0),
g AS (SELECT row_id, expect, {_CAT} AS g_cat, sub AS g_sub, CASE WHEN contains(norm, 'RED ') THEN 'red' WHEN contains(norm, 'BLUE ') THEN 'blue' END AS g_colour,
       CASE WHEN contains(norm, 'SMALL ') THEN 'S' WHEN contains(norm, 'LARGE ') THEN 'L' END AS g_size, contains(norm, 'COLD ') AS g_flag FROM g1),
j AS (SELECT g.*, o.state, o.tier, o.o_cat, o.o_sub, o.o_colour, o.o_size, coalesce(o.o_flag, false) AS o_flag, g.expect = 'decode' AS wanted, coalesce(o.state = 'decoded', false) AS got,
        coalesce(o.o_cat = g.g_cat, false) AS cat_ok, coalesce(o.o_sub = g.g_sub, false) AS sub_ok FROM g LEFT JOIN o ON g.row_id = o.row_id)
"""


def part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("title", F.concat_ws(" ", "p_brand", "p_name"))


def raw_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    sku = F.when(k % 83 == 0, " ").otherwise(F.concat(F.lit(" p-"), k, F.lit(" ")))
    title = F.when(k % 97 == 0, "").when(k % 89 == 0, "ab ").otherwise(F.concat_ws(" ", "p_brand", "p_name"))
    return p.select(k.cast("string").alias("row_id"), sku.alias("sku"), title.alias("title"))


def part_tiers(spark: SparkSession, sf_dir: str) -> list:
    p = table(spark, sf_dir, "part")
    attrs = F.lit(None).cast(rules.attributes_type(WIDGETS)).alias("attributes")
    catalog = p.where("p_type = 'PROMO'").select(
        normalize_key(F.concat(F.lit("p-"), "p_partkey")).alias("key"),
        F.lit("Heavy").alias("category"),
        F.when(F.col("p_size") > 45, "Bolts").otherwise("Anvils").alias("subcategory"),
        attrs,
        (F.col("p_size") % 2 == 0).alias("is_winter_rated"),
    )
    title = normalize_title(F.concat_ws(" ", "p_brand", "p_name")).alias("title")
    fixture = p.where("p_type = 'ECONOMY'").groupBy(title).agg(F.max("p_size").alias("n"))
    fixture = fixture.select("title", F.lit("Misc").alias("category"), F.when(F.col("n") > 25, "Widgets").otherwise("Unknown").alias("subcategory"), attrs, (F.col("n") % 2 == 0).alias("is_winter_rated"))
    return [tiers.CatalogTier(catalog), tiers.RulesTier(), tiers.FixtureTier(fixture)]


def part_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.run_batch(raw_parts(spark, sf_dir), part_tiers(spark, sf_dir), WIDGETS)


def part_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    words = tokens(normalize_title(F.col("p_name")))
    sub, _ = rules.subcategory_of(normalize_title(F.col("p_name")), WIDGETS)
    p = p.withColumns({"words": words, "sub": sub})
    attrs = F.struct(*[first_token(F.col("words"), a.tokens).alias(a.name) for a in WIDGETS.attrs])
    return p.select(
        F.col("p_partkey").cast("string").alias("row_id"),
        F.when(F.col("p_partkey") % 30 == 0, "abstain").otherwise("decode").alias("expect"),
        F.coalesce(*[F.when(F.col("sub") == s, F.lit(c)) for s, c in WIDGETS.category_of().items()]).alias("category"),
        F.col("sub").alias("subcategory"),
        attrs.alias("attributes"),
        F.array_contains("words", "COLD").alias("is_winter_rated"),
    )


def part_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.joined(part_batch(spark, sf_dir), part_gold(spark, sf_dir))


# ---- normalisation and rules ----------------------------------------------------------------------------------------


@query(
    "SELECT p_partkey, upper(p_brand || ' ' || p_name) AS norm, CAST(len(string_split(upper(p_brand || ' ' || p_name), ' ')) AS BIGINT) AS n_tokens, "
    "string_split(upper(p_brand || ' ' || p_name), ' ')[1] AS first_token FROM part"
)
def norm_tokens(spark, sf_dir):
    t = part_titles(spark, sf_dir).withColumn("norm", normalize_title(F.concat(F.lit(" ("), "title", F.lit(" )  "))))
    t = t.withColumn("w", tokens(F.col("norm")))
    return t.select("p_partkey", "norm", _long(F.size("w")).alias("n_tokens"), F.get("w", F.lit(0)).alias("first_token"))


@query("SELECT c_custkey, replace(upper(trim(c_name || ' ' || c_mktsegment)), ' ', '') AS key FROM customer")
def normalize_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", normalize_key(F.concat(F.lit("\t "), F.concat_ws(" ", "c_name", "c_mktsegment"), F.lit(" "))).alias("key"))


@query(_PART_RULES + "SELECT id AS p_partkey, CASE WHEN alias IS NOT NULL THEN brand END AS brand FROM e")
def brand_finder(spark, sf_dir):
    t = part_titles(spark, sf_dir)
    return t.select("p_partkey", rules.brand_of(tokens(normalize_title(F.col("title"))), WIDGETS).alias("brand"))


@query(_PART_RULES + "SELECT id AS p_partkey, cat AS category, sub AS subcategory, colour, size, flag_token IS NOT NULL AS flag, evidence FROM e WHERE evidence IS NOT NULL")
def rules_decode(spark, sf_dir):
    d = rules.decode(part_titles(spark, sf_dir), WIDGETS).where("candidate IS NOT NULL")
    return d.select("p_partkey", "candidate.category", "candidate.subcategory", "candidate.attributes.colour", "candidate.attributes.size", F.col("candidate.is_winter_rated").alias("flag"), "candidate.evidence")


_LEGAL = Pack(taxonomy={"Legal": ("License", "Rights"), "Tone": ("Scorn", "Insult")}, phrases={"LICENSE": "License", "RESERVED": "Rights", "PATHETIC": "Scorn", "WORTHLESS": "Insult", "IDIOT": "Insult"}, attrs=())


@query(
    "SELECT n_hits, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, contains(u, 'LICENSE')::INT + contains(u, 'RESERVED')::INT + contains(u, 'PATHETIC')::INT + (contains(u, 'WORTHLESS') OR contains(u, 'IDIOT'))::INT AS n_hits "
    "FROM (SELECT doc_id, upper(text) AS u FROM documents)) GROUP BY n_hits"
)
def rules_ambiguous_abstain(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", rules.hit_count(F.upper("text"), _LEGAL).alias("n_hits"))
    return d.groupBy("n_hits").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


_PACK = next(a for a in PARTS.attrs if a.name == "pack_count")


@query(
    "SELECT event_id, try_cast(nullif(coalesce(nullif(regexp_extract(title, '\\b([0-9]{1,2})\\s*[- ]?(?:PK|PACK)\\b', 1), ''), nullif(regexp_extract(title, '\\bSET OF ([0-9]{1,2})\\b', 1), '')), '') AS INTEGER) AS pack_count "
    "FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN upper(event_type) || ' ' || k || '-PK' WHEN 1 THEN 'SET OF ' || k ELSE k || ' PACK SET OF 3' END AS title FROM (SELECT event_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS k FROM events))"
)
def pack_regex(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1))
    r = F.col("event_id") % 3
    title = F.when(r == 0, F.concat(F.upper("event_type"), F.lit(" "), "k", F.lit("-PK"))).when(r == 1, F.concat(F.lit("SET OF "), "k")).otherwise(F.concat("k", F.lit(" PACK SET OF 3")))
    return e.withColumn("title", title).select("event_id", first_number(F.col("title"), _PACK.patterns).alias("pack_count"))


@query("SELECT p_partkey, list_filter(string_split(upper(p_name || ' ' || p_type), ' '), lambda x: x IN ('SMALL', 'LARGE'))[-1] AS size FROM part")
def last_token_attr(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", first_token(tokens(normalize_title(F.concat_ws(" ", "p_name", "p_type"))), {"SMALL": "SMALL", "LARGE": "LARGE"}, last=True).alias("size"))


@query("SELECT p_partkey, CASE list_filter(string_split(upper(p_name || ' ' || p_type), ' '), lambda x: x IN ('SMALL', 'LARGE', 'RED'))[1] WHEN 'SMALL' THEN 's' WHEN 'LARGE' THEN 'l' WHEN 'RED' THEN 'r' END AS mark FROM part")
def first_token_attr(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", first_token(tokens(normalize_title(F.concat_ws(" ", "p_name", "p_type"))), {"SMALL": "s", "LARGE": "l", "RED": "r"}).alias("mark"))


def _flags(spark, sf_dir, ruleset):
    t = part_titles(spark, sf_dir).withColumn("norm", normalize_title(F.col("title"))).withColumn("w", tokens(F.col("norm")))
    sub, _ = rules.subcategory_of(F.col("norm"), WIDGETS)
    t = t.withColumns({"brand": rules.brand_of(F.col("w"), WIDGETS), "sub": sub})
    t = t.withColumn("cat", F.coalesce(*[F.when(F.col("sub") == s, F.lit(c)) for s, c in WIDGETS.category_of().items()]))
    flag = rules.flag_of(F.col("norm"), F.col("w"), F.col("cat"), F.col("brand"), WIDGETS, ruleset)
    return t.where("brand IS NOT NULL").groupBy("cat", flag.alias("cause")).agg(F.count("*").alias("n"))


@query(_PART_RULES + "SELECT cat, flag_token AS cause, count(*) AS n FROM e WHERE alias IS NOT NULL GROUP BY ALL")
def flag_guarded(spark, sf_dir):
    return _flags(spark, sf_dir, "guarded")


@query(_PART_RULES + "SELECT cat, coalesce(flag_token, CASE WHEN CAST(substr(alias, 7) AS INT) % 5 = 0 THEN 'brand-default' END) AS cause, count(*) AS n FROM e WHERE alias IS NOT NULL GROUP BY ALL")
def flag_naive(spark, sf_dir):
    return _flags(spark, sf_dir, "naive")


@query(_PART_RULES + "SELECT cat AS category, count(*) AS n FROM e WHERE evidence IS NOT NULL GROUP BY cat")
def category_totals(spark, sf_dir):
    return rules.decode(part_titles(spark, sf_dir), WIDGETS).where("candidate IS NOT NULL").groupBy("candidate.category").agg(F.count("*").alias("n"))


# ---- tiers ----------------------------------------------------------------------------------------------------------


@query(
    "SELECT l_returnflag, count(*) AS lines, count(p_partkey) AS found, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS sizes FROM lineitem LEFT JOIN (SELECT p_partkey, p_size FROM part WHERE p_type = 'PROMO') p ON l_partkey = p_partkey GROUP BY l_returnflag"
)
def catalog_tier(spark, sf_dir):
    c = table(spark, sf_dir, "part").where("p_type = 'PROMO'").select("p_partkey", "p_size")
    c = tiers.small(c)
    j = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag").join(c, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.count("p_partkey").alias("found"), _long(F.coalesce(F.sum("p_size"), F.lit(0))).alias("sizes"))


@query("WITH " + _BATCH + "SELECT row_id, state, tier, o_cat AS category, o_sub AS subcategory, coalesce(o_flag, false) AS flag FROM o")
def tier_coalesce(spark, sf_dir):
    d = F.col("decode")
    return part_batch(spark, sf_dir).select("row_id", "state", "tier", d["category"].alias("category"), d["subcategory"].alias("subcategory"), F.coalesce(d["is_winter_rated"], F.lit(False)).alias("flag"))


@query("WITH " + _BATCH + "SELECT tier, n FROM (SELECT 'catalog' AS tier, count(*) FILTER (inv_catalog) AS n FROM o UNION ALL SELECT 'model', count(*) FILTER (inv_model) FROM o) WHERE n > 0")
def tier_invalid_counts(spark, sf_dir):
    return part_batch(spark, sf_dir).select(F.explode("invalid").alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@query(
    "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_type = 'PROMO' THEN 'unknown category: ''Promo''' WHEN p_type = 'SMALL' THEN 'subcategory ''Bolts'' not in category ''Heavy''' END, CASE WHEN p_partkey % 11 = 0 THEN 'is_winter_rated must be a bool' END, "
    "CASE WHEN p_brand = 'Brand#1' THEN 'bad colour: ''green''' END, CASE WHEN p_size > 40 THEN 'bad size: ''XXL''' WHEN p_type = 'SMALL' AND p_size > 20 THEN 'size not allowed for Heavy' END], lambda x: x IS NOT NULL), '; ') AS errors FROM part"
)
def validate_errors(spark, sf_dir):
    t, n = F.col("p_type"), F.col("p_size")
    made = F.struct(
        F.when(t == "PROMO", "Promo").when(t == "SMALL", "Heavy").otherwise("Fixing").alias("category"),
        F.lit("Bolts").alias("subcategory"),
        F.struct(F.when(F.col("p_brand") == "Brand#1", "green").otherwise("red").alias("colour"), F.when(n > 40, "XXL").when(n > 20, "S").alias("size")).alias("attributes"),
        F.when(F.col("p_partkey") % 11 != 0, True).alias("is_winter_rated"),
        F.lit("").alias("evidence"),
    )
    p = table(spark, sf_dir, "part").withColumn("c", made)
    return p.select("p_partkey", F.array_join(validate.errors(F.col("c"), WIDGETS), "; ").alias("errors"))


@query("WITH " + _BATCH + "SELECT state, count(*) AS n FROM o GROUP BY state")
def bucket_counts(spark, sf_dir):
    return part_batch(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query(
    "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN trim(t) = '' THEN 'empty_title' WHEN length(trim(t)) < 4 THEN 'short_title' WHEN source = 'src3' THEN 'missing_sku' END AS reason FROM (SELECT source, regexp_replace(substr(text, 1, CAST(doc_id % 6 AS INT)), '\\s', ' ', 'g') AS t FROM documents)) GROUP BY reason"
)
def malformed_reasons(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.substring("text", F.lit(1), (F.col("doc_id") % 6).cast("int")).alias("title"), F.when(F.col("source") != "src3", F.col("source")).alias("sku"))
    return d.groupBy(tiers.malformed().alias("reason")).agg(F.count("*").alias("n"))


@query("WITH " + _BATCH + "SELECT row_id, sku, title, state AS bucket, coalesce(bad, 'no_confident_decode') AS reason FROM o WHERE state <> 'decoded'")
def reject_rows(spark, sf_dir):
    return tiers.rejects(part_batch(spark, sf_dir))


# ---- contracts ------------------------------------------------------------------------------------------------------


@query(
    "SELECT field, CAST(missing AS BIGINT) AS missing, CAST(empty AS BIGINT) AS empty FROM (SELECT 'event_type' AS field, count(*) FILTER (x IS NULL) AS missing, count(*) FILTER (x = '') AS empty FROM (SELECT CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END AS x FROM events) UNION ALL SELECT 'props', count(*) FILTER (props IS NULL), count(*) FILTER (props = '') FROM events)"
)
def schema_profile(spark, sf_dir):
    m = F.col("event_id") % 10
    e = table(spark, sf_dir, "events").select(F.when(m == 0, None).when(m == 1, "").otherwise(F.col("event_type")).alias("event_type"), "props")
    return contract.profile(e, ["event_type", "props"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return evaluate.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def dedupe_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return files.last_wins(e, "user_id", "event_id")


@query("SELECT event_id, CASE WHEN k % 7 = 0 THEN 'malformed' WHEN k % 5 = 0 THEN 'not_object' WHEN k % 3 = 0 THEN 'missing_k' ELSE 'ok' END AS status FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)")
def json_payload_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    line = F.when(F.col("k") % 7 == 0, "{oops").when(F.col("k") % 5 == 0, "[1, 2]").when(F.col("k") % 3 == 0, '{"j": 1}').otherwise(F.col("props"))
    return e.select("event_id", object_status(line, ["k"]).alias("status"))


# ---- evaluation and gates -------------------------------------------------------------------------------------------


@query("WITH " + _GOLD + "SELECT count(*) FILTER (wanted AND got AND o_flag AND g_flag) AS tp, count(*) FILTER (got AND o_flag AND NOT (wanted AND g_flag)) AS fp, count(*) FILTER (wanted AND g_flag AND NOT (got AND o_flag)) AS fn FROM j")
def flag_prf(spark, sf_dir):
    return evaluate.flag_counts(part_scored(spark, sf_dir))


class _Ratio:
    """SQL of n / d to four places by the exact value of the double, a tie to the even neighbour; 1 where d is 0."""

    def format(self, n: str, d: str) -> str:
        x = f"(({n})::DOUBLE / ({d}))"
        high = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
        k = f"floor({x} * 10000::DOUBLE)"
        off = f"(({x} * 20000::DOUBLE - (2 * {k} + 1)) + (({high} * 20000::DOUBLE - {x} * 20000::DOUBLE) + ({x} - {high}) * 20000::DOUBLE))"
        return f"CASE WHEN {d} = 0 THEN 1.0::DOUBLE ELSE ({k} + CASE WHEN {off} > 0 OR ({off} = 0 AND CAST({k} AS BIGINT) % 2 = 1) THEN 1 ELSE 0 END) / 10000::DOUBLE END"


_R4 = _Ratio()


@query(
    "WITH "
    + _GOLD
    + ", k AS (SELECT g_cat AS category, 0 AS tp, 0 AS fp, 1 AS support FROM j WHERE wanted UNION ALL SELECT g_cat, 1, 0, 0 FROM j WHERE wanted AND got AND cat_ok UNION ALL SELECT o_cat, 0, 1, 0 FROM j WHERE got AND NOT (wanted AND cat_ok)),"
    + " s AS (SELECT category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(support) AS BIGINT) AS support FROM k GROUP BY category) SELECT *, "
    + _R4.format(n="tp", d="(tp + fp)")
    + " AS prec, "
    + _R4.format(n="tp", d="support")
    + " AS rec FROM s"
)
def category_prf(spark, sf_dir):
    c = evaluate.category_counts(part_scored(spark, sf_dir))
    return c.select("*", evaluate.ratio4(F.col("tp"), F.col("tp") + F.col("fp")).alias("prec"), evaluate.ratio4(F.col("tp"), F.col("support")).alias("rec"))


@query(
    "WITH "
    + _GOLD
    + "SELECT attribute, CAST(sum(ok::INT) AS BIGINT) AS correct, count(*) AS total FROM (SELECT 'colour' AS attribute, got AND o_colour IS NOT DISTINCT FROM g_colour AS ok FROM j WHERE wanted UNION ALL SELECT 'size', got AND o_size IS NOT DISTINCT FROM g_size FROM j WHERE wanted) GROUP BY attribute"
)
def attribute_accuracy(spark, sf_dir):
    return evaluate.attribute_counts(part_scored(spark, sf_dir), WIDGETS)


@query(
    "WITH "
    + _GOLD
    + "SELECT o.tier, count(*) AS rows, count(*) FILTER (j.wanted) AS gold_rows, count(*) FILTER (j.wanted AND j.cat_ok AND j.sub_ok AND j.o_flag = j.g_flag) AS gold_correct FROM o LEFT JOIN j ON o.row_id = j.row_id WHERE o.state = 'decoded' GROUP BY o.tier"
)
def tier_scores(spark, sf_dir):
    return evaluate.tier_counts(part_batch(spark, sf_dir), part_gold(spark, sf_dir))


@query("WITH " + _GOLD + "SELECT g_cat || '/' || g_sub AS gold_label, CASE WHEN got THEN o_cat || '/' || o_sub ELSE '<' || state || '>' END AS pred_label, count(*) AS n FROM j WHERE wanted AND NOT (got AND cat_ok AND sub_ok) GROUP BY ALL")
def confusion_pairs(spark, sf_dir):
    return evaluate.confusion(part_scored(spark, sf_dir))


@query(
    "WITH "
    + _GOLD
    + ", n AS (SELECT count(*) FILTER (wanted) AS expected, count(*) FILTER (wanted AND got) AS decoded, count(*) FILTER (wanted AND got AND cat_ok) AS correct FROM j) SELECT *, "
    + _R4.format(n="correct", d="expected")
    + " AS end_to_end, "
    + _R4.format(n="correct", d="decoded")
    + " AS conditional FROM n"
)
def accuracy_e2e_vs_conditional(spark, sf_dir):
    s = evaluate.gold_summary(part_scored(spark, sf_dir)).select("expected", "decoded", F.col("category_correct").alias("correct"))
    return s.select("*", evaluate.ratio4(F.col("correct"), F.col("expected")).alias("end_to_end"), evaluate.ratio4(F.col("correct"), F.col("decoded")).alias("conditional"))


@query(
    "WITH "
    + _GOLD
    + "SELECT count(*) AS total, count(*) FILTER (wanted AND got) AS decoded, count(*) FILTER (wanted AND state = 'abstained') AS abstained, count(*) FILTER (wanted AND state = 'quarantined') AS quarantined, count(*) FILTER (NOT wanted AND got) AS unexpected_decodes, count(*) FILTER (NOT wanted AND NOT got) AS correct_abstains FROM j"
)
def gold_totals(spark, sf_dir):
    return evaluate.gold_summary(part_scored(spark, sf_dir)).select("total", "decoded", "abstained", "quarantined", "unexpected_decodes", "correct_abstains")


@query("WITH " + _BATCH + ", n AS (SELECT count(*) AS total, count(*) FILTER (state = 'decoded') AS decoded, count(*) FILTER (state = 'quarantined') AS quarantined FROM o) SELECT *, " + _R4.format(n="decoded", d="total") + " AS coverage, " + _R4.format(n="quarantined", d="total") + " AS quarantine_rate FROM n")
def coverage(spark, sf_dir):
    n = part_batch(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("state") == "decoded").alias("decoded"), F.count_if(F.col("state") == "quarantined").alias("quarantined"))
    return n.select("*", evaluate.ratio4(F.col("decoded"), F.col("total")).alias("coverage"), evaluate.ratio4(F.col("quarantined"), F.col("total")).alias("quarantine_rate"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def gold_missing(spark, sf_dir):
    return evaluate.missing_gold(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    "WITH j AS (SELECT quality, toxic, n_chars > 600 AS long, strpos(text, '|') = 0 AND strpos(text, '!!') = 0 AND strpos(text, '###') = 0 AS plain FROM documents JOIN labels USING (doc_id)) "
    "SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS gold_label, CASE WHEN plain AND long THEN 'good' WHEN plain THEN 'short' ELSE 'bad' END AS pred_label, count(*) AS n FROM j GROUP BY ALL"
)
def label_confusion(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    plain = ~(F.contains("text", F.lit("|")) | F.contains("text", F.lit("!!")) | F.contains("text", F.lit("###")))
    pred = F.when(plain & (F.col("n_chars") > 600), "good").when(plain, "short").otherwise("bad")
    return evaluate.label_pairs(d, F.when(F.col("quality") == 1, "good").otherwise("bad"), pred)


@query(
    "WITH "
    + _GOLD
    + ", n AS (SELECT (SELECT count(*) FROM o) AS total, (SELECT count(*) FILTER (state = 'decoded') FROM o) AS decoded, (SELECT count(*) FILTER (state = 'quarantined') FROM o) AS quar, count(*) FILTER (wanted AND got AND o_flag AND g_flag) AS tp, count(*) FILTER (got AND o_flag) AS flagged, count(*) FILTER (wanted) AS expected, count(*) FILTER (wanted AND got AND cat_ok) AS correct FROM j),"
    + " a AS (SELECT 'flag_precision' AS name, "
    + _R4.format(n="tp", d="flagged")
    + " AS actual, 0.97 AS threshold, '>=' AS op FROM n UNION ALL SELECT 'category_accuracy', "
    + _R4.format(n="correct", d="expected")
    + ", 0.93, '>=' FROM n UNION ALL SELECT 'coverage', "
    + _R4.format(n="decoded", d="total")
    + ", 0.80, '>=' FROM n UNION ALL SELECT 'error_rows', 0.0, 0.0, '<=' FROM n UNION ALL SELECT 'quarantine_rate', "
    + _R4.format(n="quar", d="total")
    + ", 0.10, '<=' FROM n) SELECT name, CAST(actual AS DOUBLE) AS actual, CAST(threshold AS DOUBLE) AS threshold, op, CASE op WHEN '>=' THEN actual >= threshold ELSE actual <= threshold END AS passed FROM a"
)
def gate_checks(spark, sf_dir):
    j = evaluate.joined(part_batch(spark, sf_dir), part_gold(spark, sf_dir), "right")  # all outcomes, read once
    c, w = F.col, F.coalesce("wanted", F.lit(False))
    n = j.agg(
        F.count("*").alias("total"),
        *[F.count_if(c("state") == s).alias(s) for s in ("decoded", "quarantined", "errored")],
        F.count_if(w & c("got") & c("p_flag") & c("g_flag")).alias("tp"),
        F.count_if(c("wanted").isNotNull() & c("got") & c("p_flag")).alias("flagged"),
        F.count_if(w).alias("expected"),
        F.count_if(w & c("got") & c("cat_ok")).alias("correct"),
    )
    rows = [
        ("flag_precision", evaluate.ratio4(c("tp"), c("flagged")), 0.97, ">="),
        ("category_accuracy", evaluate.ratio4(c("correct"), c("expected")), 0.93, ">="),
        ("coverage", evaluate.ratio4(c("decoded"), c("total")), 0.80, ">="),
        ("error_rows", c("errored").cast("double"), 0.0, "<="),
        ("quarantine_rate", evaluate.ratio4(c("quarantined"), c("total")), 0.10, "<="),
    ]
    made = F.array(*[F.struct(F.lit(n_).alias("name"), v.alias("actual"), F.lit(float(t)).alias("threshold"), F.lit(op).alias("op"), (v >= t if op == ">=" else v <= t).alias("passed")) for n_, v, t, op in rows])
    return n.select(F.explode(made).alias("r")).select("r.*")


# ---- digests --------------------------------------------------------------------------------------------------------

_PART_TEXT = "concat_ws('|', CAST(p_partkey AS VARCHAR), p_name, p_brand, CAST(p_size AS VARCHAR))"
_ORDER_TEXT = "concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)"


@query(f"SELECT p_partkey, sha256({_PART_TEXT}) AS digest FROM part")
def row_digests(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", row_digest(["p_partkey", "p_name", "p_brand", "p_size"]).alias("digest"))


def _tree(rows: str, by: str = "") -> str:
    """SQL of the tree digest of a table of d (and the columns by, each followed by a comma)."""
    return (
        f"WITH r AS ({rows}), a AS (SELECT {by} left(d, 5) AS p, count(*) AS n, sha256(string_agg(d, ',' ORDER BY d)) AS d FROM r GROUP BY {by} left(d, 5)), "
        f"b AS (SELECT {by} left(p, 2) AS q, sum(n) AS n, sha256(string_agg(d, ',' ORDER BY p)) AS d FROM a GROUP BY {by} left(p, 2)) "
        f"SELECT {by} CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(d, ',' ORDER BY q)) AS digest FROM b" + (f" GROUP BY {by.rstrip(', ')}" if by else "")
    )


@query(_tree(f"SELECT sha256({_PART_TEXT}) AS d FROM part"))
def rowset_digests(spark, sf_dir):
    return tree_digest(table(spark, sf_dir, "part").select(row_digest(["p_partkey", "p_name", "p_brand", "p_size"]).alias("d")))


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(_tree(f"SELECT o_orderstatus, sha256({_ORDER_TEXT}) AS d FROM orders", "o_orderstatus,"))
def group_digests(spark, sf_dir):
    return tree_digest(table(spark, sf_dir, "orders").select("o_orderstatus", row_digest(_ORDER_COLUMNS).alias("d")), ["o_orderstatus"])


@query(_tree(f"SELECT sha256({_ORDER_TEXT}) AS d FROM orders"))
def bucketed_digests(spark, sf_dir):
    return tree_digest(table(spark, sf_dir, "orders").select(row_digest(_ORDER_COLUMNS).alias("d")))


# ---- batch differences ----------------------------------------------------------------------------------------------

#: The second snapshot of orders: some keys go, some come, some rows change.
_V2 = "v2 AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END AS state, CASE WHEN o_orderkey % 7 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS pri, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS cust FROM orders)"
_DIFF = f"WITH {_V2}, v1 AS (SELECT o_orderkey AS k, o_orderstatus AS state, o_orderpriority AS pri, o_custkey AS cust FROM orders), j AS (SELECT v1.k AS k1, v2.k AS k2, v1.state AS s1, v2.state AS s2, v1.state IS DISTINCT FROM v2.state AS d_state, v1.pri IS DISTINCT FROM v2.pri AS d_pri, v1.cust IS DISTINCT FROM v2.cust AS d_cust FROM v1 FULL JOIN v2 ON v1.k = v2.k), d AS (SELECT *, CASE WHEN k1 IS NULL THEN 'added' WHEN k2 IS NULL THEN 'removed' WHEN d_state OR d_pri OR d_cust THEN 'changed' ELSE 'unchanged' END AS status FROM j) "


def _versions(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    v1 = o.select(k.alias("k"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("pri"), F.col("o_custkey").alias("cust"))
    v2 = o.select(
        F.when(k % 17 == 0, k + 100000000).otherwise(k).alias("k"),
        F.when(k % 5 == 0, "F").otherwise(F.col("o_orderstatus")).alias("state"),
        F.when(k % 7 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("pri"),
        F.when(k % 11 == 0, None).otherwise(F.col("o_custkey")).alias("cust"),
    )
    return v1, v2


def _difference(spark, sf_dir):
    v1, v2 = (v.select("k", "state", compare.fields_of(["pri", "cust"]).alias("fields")) for v in _versions(spark, sf_dir))
    return compare.diff(v1, v2, "k")


@query(_DIFF + "SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged FROM d")
def batch_diff_counts(spark, sf_dir):
    return compare.status_counts(_difference(spark, sf_dir))


@query(_DIFF + "SELECT * FROM (SELECT 'outcome' AS field, count(*) AS n FROM d WHERE status = 'changed' AND d_state UNION ALL SELECT 'pri', count(*) FROM d WHERE status = 'changed' AND d_pri UNION ALL SELECT 'cust', count(*) FROM d WHERE status = 'changed' AND d_cust) WHERE n > 0")
def batch_diff_fields(spark, sf_dir):
    return compare.field_counts(_difference(spark, sf_dir))


@query(_DIFF + "SELECT s1 || '_to_' || s2 AS transition, count(*) AS n FROM d WHERE k1 IS NOT NULL AND k2 IS NOT NULL GROUP BY 1")
def batch_transitions(spark, sf_dir):
    return compare.transition_counts(_difference(spark, sf_dir))


@query(
    _DIFF
    + "SELECT count(k1) AS baseline_total, count(*) FILTER (status <> 'added') AS baseline_identity, count(k2) AS current_total, count(*) FILTER (status <> 'removed') AS current_identity, count(*) AS union_total, count(status) AS union_identity FROM d"
)
def diff_partition_identity(spark, sf_dir):
    return compare.partition_identity(_difference(spark, sf_dir))


@query(_DIFF + "SELECT coalesce(k1, k2) AS k, status, CASE WHEN status = 'changed' THEN array_to_string(list_filter([CASE WHEN d_cust THEN 'cust' END, CASE WHEN d_state THEN 'outcome' END, CASE WHEN d_pri THEN 'pri' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS fields FROM d WHERE status <> 'unchanged'")
def batch_changed_rows(spark, sf_dir):
    d = _difference(spark, sf_dir).where("status <> 'unchanged'")
    return d.select("k", "status", F.coalesce(F.array_join(F.transform("changes", lambda c: c["field"]), ","), F.lit("")).alias("fields"))


# ---- integrity joins ------------------------------------------------------------------------------------------------


@query("SELECT side, k FROM (SELECT 'orders' AS side, o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT 'lineitem', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))")
def partition_anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    orders = registry.gaps(o, li, "k", ("orders", "")).where("side = 'orders'")
    return orders.unionByName(registry.gaps(li, o.where("o_orderstatus <> 'P'"), "k", ("lineitem", "")).where("side = 'lineitem'"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def overlap_semi_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").withColumnRenamed("l_orderkey", "o_orderkey")
    return evaluate.overlap(table(spark, sf_dir, "orders"), li, "o_orderkey")


@query(
    "SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_name IS DISTINCT FROM name THEN 's_name' END, CASE WHEN s_nationkey IS DISTINCT FROM nation THEN 's_nationkey' END], lambda x: x IS NOT NULL), ',') AS fields FROM supplier "
    "JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN s_name || '?' ELSE s_name END AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_nationkey END AS nation FROM supplier WHERE s_suppkey % 3 <> 0) ON k = s_suppkey WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 = 0"
)
def source_value_mismatch(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    other = s.where(k % 3 != 0).select("s_suppkey", F.when(k % 7 == 0, F.concat("s_name", F.lit("?"))).otherwise(F.col("s_name")).alias("s_name"), F.when(k % 5 != 0, F.col("s_nationkey")).alias("s_nationkey"))
    return registry.value_mismatches(s, other, "s_suppkey", ["s_name", "s_nationkey"]).select("s_suppkey", F.array_join("fields", ",").alias("fields"))


@query("SELECT 'R' || p_partkey AS row_id FROM part WHERE p_partkey % 19 = 0")
def gold_title_mismatch(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    raw = p.select(F.concat(F.lit("R"), k).alias("row_id"), F.col("p_name").alias("title"))
    gold = p.select(F.concat(F.lit("R"), k).alias("row_id"), F.when(k % 19 == 0, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_name")).alias("title"))
    return registry.value_mismatches(gold, raw, "row_id", ["title"]).select("row_id")


@query(f"WITH {_V2} SELECT k, state, pri FROM v2 WHERE k NOT IN (SELECT o_orderkey FROM orders)")
def append_only_insert(spark, sf_dir):
    v1, v2 = _versions(spark, sf_dir)
    return registry.appended(v2, v1, "k").select("k", "state", "pri")


@query(f"WITH {_V2} SELECT v2.k FROM v2 JOIN orders ON k = o_orderkey WHERE sha256(concat_ws('|', state, pri)) <> sha256(concat_ws('|', o_orderstatus, o_orderpriority))")
def content_conflicts(spark, sf_dir):
    v1, v2 = (v.select("k", row_digest(["state", "pri"]).alias("payload_sha256")) for v in _versions(spark, sf_dir))
    return registry.conflicts(v2, v1, "k")


@query(f"WITH {_V2}, s AS (SELECT o_orderkey AS k, 1 AS origin FROM orders UNION ALL SELECT k, 2 FROM v2 WHERE k NOT IN (SELECT o_orderkey FROM orders)) SELECT origin, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM s GROUP BY origin")
def snapshot_union(spark, sf_dir):
    v1, v2 = _versions(spark, sf_dir)
    d = row_digest(["state", "pri"]).alias("payload_sha256")
    s = registry.snapshot_after(v1.select("k", d, F.lit(1).alias("origin_batch_id")), v2.select("k", d), 2, "k")
    return s.groupBy(F.col("origin_batch_id").alias("origin")).agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query(
    "WITH m AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 31 = 0 THEN p_name || '!' ELSE p_name END AS name, CASE WHEN p_partkey % 37 = 0 THEN 'other' ELSE p_brand END AS origin FROM part WHERE p_partkey % 41 <> 0 UNION ALL SELECT p_partkey + 100000000, p_name, p_brand FROM part WHERE p_partkey % 43 = 0)"
    "SELECT count(*) FILTER (m.k IS NULL) AS missing, count(*) FILTER (p_partkey IS NULL) AS extra, count(*) FILTER (p_name <> name) AS payload, count(*) FILTER (p_brand <> origin) AS provenance FROM part FULL JOIN m ON p_partkey = m.k"
)
def reconcile_mutations(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    expected = p.select(k.alias("row_id"), F.col("p_name").alias("payload_sha256"), F.col("p_brand").alias("origin_batch_id"))
    held = p.where(k % 41 != 0).select(k.alias("row_id"), F.when(k % 31 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("payload_sha256"), F.when(k % 37 == 0, "other").otherwise(F.col("p_brand")).alias("origin_batch_id"))
    extra = p.where(k % 43 == 0).select((k + 100000000).alias("row_id"), F.col("p_name").alias("payload_sha256"), F.col("p_brand").alias("origin_batch_id"))
    return registry.mutations(expected, held.unionByName(extra))


@query("SELECT b AS batch_id, n, lag(b) OVER (ORDER BY b) AS parent_batch_id FROM (SELECT strftime(o_orderdate, '%Y-%m') AS b, count(*) AS n FROM orders GROUP BY 1)")
def lineage_prev_batch(spark, sf_dir):
    b = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("batch_id")).agg(F.count("*").alias("n"))
    return registry.with_parent(b, "batch_id")


@query("SELECT batch_id, min(k) AS first_key, count(*) AS n FROM (SELECT o_custkey AS k, strftime(min(o_orderdate), '%Y') AS batch_id FROM orders GROUP BY 1) GROUP BY batch_id")
def first_origin(spark, sf_dir):
    o = registry.first_origin(table(spark, sf_dir, "orders"), "o_custkey", F.date_format("o_orderdate", "yyyy"), "o_orderdate")
    return o.groupBy(F.col("origin_batch_id").alias("batch_id")).agg(F.min("o_custkey").alias("first_key"), F.count("*").alias("n"))


@query(
    "SELECT n_name, r_name, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers, c.best FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2 LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, max(c_acctbal) AS best FROM customer WHERE c_acctbal > 0 GROUP BY 1) c ON c.k = n_nationkey"
)
def registry_report(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"), F.max("c_acctbal").alias("best"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    n = registry.report_of(n, table(spark, sf_dir, "region").where("r_regionkey <> 2"), on="r_regionkey")
    return registry.report_of(n, s, c, on="k", zeros=("suppliers", "customers")).select("n_name", "r_name", "suppliers", "customers", "best")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey")
def latest_batch(spark, sf_dir):
    return registry.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate", "o_orderkey")


#: Decisions made of orders: most bind their own batch, some bind batch F wherever they are linked, some bind nothing.
_BOUND = "sha256('{\"batch_id\":\"' || %s || '\",\"passed\":' || CASE WHEN o_orderkey %% 13 <> 0 THEN 'true' ELSE 'false' END || ',\"report_sha256\":\"' || o_custkey || '\",\"thresholds_sha256\":\"' || o_orderpriority || '\"}')"
_DECISIONS = f"d AS (SELECT o_orderstatus AS batch, o_orderkey % 13 <> 0 AS passed, {_BOUND % "'F'"} AS bound, CASE WHEN o_orderkey % 7 = 0 THEN {_BOUND % "'F'"} WHEN o_orderkey % 11 = 0 THEN 'bad' ELSE {_BOUND % 'o_orderstatus'} END AS decision_id FROM orders)"


def _decisions(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k, F.col("o_orderstatus").alias("batch_id"), (k % 13 != 0).alias("passed"), F.col("o_custkey").cast("string").alias("report_sha256"), F.col("o_orderpriority").alias("thresholds_sha256"))
    return o.withColumn("decision_id", F.when(k % 7 == 0, registry.decision_key(F.lit("F"))).when(k % 11 == 0, "bad").otherwise(registry.decision_key(F.col("batch_id"))))


@query(f"WITH {_DECISIONS} SELECT decision_id FROM d WHERE batch <> 'F' AND decision_id = bound")
def foreign_link_scan(spark, sf_dir):
    return registry.audit_decisions(_decisions(spark, sf_dir), "F").where("reason = 'foreign'").select("decision_id")


@query(f"WITH {_DECISIONS} SELECT reason, count(*) AS n FROM (SELECT 'id_mismatch' AS reason FROM d WHERE batch = 'F' AND decision_id <> bound UNION ALL SELECT 'not_passed' FROM d WHERE batch = 'F' AND NOT passed UNION ALL SELECT 'foreign' FROM d WHERE batch <> 'F' AND decision_id = bound) GROUP BY reason")
def decision_audit(spark, sf_dir):
    return registry.audit_decisions(_decisions(spark, sf_dir), "F").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_V2} SELECT count(*) FILTER (o_orderkey IS NULL) AS added, count(*) FILTER (k IS NULL) AS removed, count(*) FILTER (k IS NOT NULL AND o_orderkey IS NOT NULL) AS unchanged, count(*) FILTER (k IS NOT NULL AND o_orderkey IS NOT NULL AND (state <> o_orderstatus OR pri <> o_orderpriority)) AS conflicts FROM orders FULL JOIN v2 ON k = o_orderkey")
def lineage_replay(spark, sf_dir):
    v1, v2 = (v.select("k", row_digest(["state", "pri"]).alias("payload_sha256")) for v in _versions(spark, sf_dir))
    return registry.lineage_counts(v1, v2, "k")


@query(
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'payload_malformed' WHEN 1 THEN 'payload_not_object' WHEN 2 THEN 'attributes_not_object' WHEN 3 THEN 'is_winter_rated_out_of_domain' ELSE '' END AS errors FROM part"
)
def product_domain_errors(spark, sf_dir):
    k = F.col("p_partkey") % 5
    stored = F.when(k == 0, "{oops").when(k == 1, "[1]").when(k == 2, '{"attributes": "x", "is_winter_rated": true}').when(k == 3, '{"attributes": {}, "is_winter_rated": 2}')
    stored = stored.otherwise(F.concat(F.lit('{"attributes": {"colour": "red"}, "is_winter_rated": false, "sku": "'), "p_partkey", F.lit('"}')))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(registry.product_errors(stored), ",").alias("errors"))


@query(f"WITH {_V2}, c AS (SELECT v2.k FROM v2 JOIN orders ON k = o_orderkey WHERE state <> o_orderstatus) SELECT k FROM c ORDER BY CAST(k AS VARCHAR) LIMIT 20")
def conflict_sample(spark, sf_dir):
    v1, v2 = _versions(spark, sf_dir)
    return registry.sample(registry.conflicts(v2, v1, "k", "state"), "k")


@query("SELECT k, side FROM (SELECT o_custkey AS k, 'both' AS side FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 9000) UNION ALL SELECT c_custkey, 'idle' FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders))")
def set_operations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    both = evaluate.overlap(c.where("c_acctbal > 9000"), o, "k").distinct().select("k", F.lit("both").alias("side"))
    return both.unionByName(registry.gaps(c, o, "k", ("idle", "unknown")).where("side = 'idle'").select("k", "side"))


# ---- untrusted rows, verdicts and answers ---------------------------------------------------------------------------

_FAULT = "CASE p_partkey % 9 WHEN 0 THEN 'malformed' WHEN 1 THEN 'not_object' WHEN 2 THEN 'missing:sku' WHEN 3 THEN 'type:is_winter_rated' WHEN 4 THEN 'empty:tier' WHEN 5 THEN 'type:attributes' WHEN 6 THEN 'unknown category: ''Toys''' WHEN 7 THEN 'bad colour: ''green''' ELSE '' END"


@query(f"SELECT p_partkey, {_FAULT} AS errors FROM part")
def decoded_row_errors(spark, sf_dir):
    k = F.col("p_partkey") % 9
    flag, tier = F.when(k == 3, "1").otherwise("true"), F.when(k == 4, "").otherwise("rules")
    attrs = F.when(k == 5, '"red"').when(k == 7, '{"colour": "green"}').otherwise('{"colour": "red"}')
    sku = F.when(k == 2, "").otherwise('"sku": "s", ')
    line = F.concat(F.lit('{"row_id": "'), "p_partkey", F.lit('", '), sku, F.lit('"category": "'), F.when(k == 6, "Toys").otherwise("Fixing"), F.lit('", "subcategory": "Bolts", "attributes": '), attrs, F.lit(', "is_winter_rated": '), flag, F.lit(', "tier": "'), tier, F.lit('", "evidence": "e", "extra": 1}'))
    line = F.when(k == 0, F.concat(line, F.lit("}{"))).when(k == 1, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)
    keys = spread(table(spark, sf_dir, "part").select("p_partkey"))
    return keys.select("p_partkey", F.array_join(bundle.decoded_errors(line, WIDGETS), ",").alias("errors"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'missing:reason' WHEN 1 THEN 'type:title' WHEN 2 THEN 'unknown bucket' WHEN 3 THEN 'malformed' ELSE '' END AS errors FROM events")
def reject_row_errors(spark, sf_dir):
    k = F.col("event_id") % 5
    title, bucket = F.when(k == 1, "null").otherwise('""'), F.when(k == 2, "lost").otherwise("abstained")
    line = F.concat(F.lit('{"row_id": "'), "event_id", F.lit('", "sku": "", "title": '), title, F.lit(', "bucket": "'), bucket, F.lit('"'), F.when(k == 0, "").otherwise(', "reason": "r"'), F.when(k == 3, "").otherwise("}"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(bundle.reject_errors(line), ",").alias("errors"))


_VERDICT = "CASE WHEN wanted AND got AND cat_ok AND sub_ok AND o_flag = g_flag THEN 'match' WHEN wanted AND got THEN 'miss' WHEN wanted THEN 'recall_miss' WHEN got THEN 'unexpected_decode' ELSE 'correct_abstention' END"


@query("WITH " + _GOLD + f"SELECT row_id, {_VERDICT} AS verdict FROM j")
def row_verdicts(spark, sf_dir):
    return evaluate.verdicts(part_batch(spark, sf_dir), part_gold(spark, sf_dir)).select("row_id", "verdict")


@query("WITH " + _GOLD + f"SELECT raw.row_id, raw.sku, raw.title, j.state, j.tier, j.expect, {_VERDICT} AS verdict FROM raw JOIN j ON raw.row_id = j.row_id WHERE raw.row_id = '42'")
def row_inspector(spark, sf_dir):
    return evaluate.inspect_row(part_batch(spark, sf_dir), part_gold(spark, sf_dir), "42").select("row_id", "sku", "title", "state", "tier", "expect", "verdict")


@query("WITH " + _GOLD + "SELECT row_id, state, CASE WHEN got THEN o_cat END AS category, CASE WHEN got THEN o_sub END AS subcategory, CASE WHEN got THEN tier END AS tier FROM j")
def gold_outcomes(spark, sf_dir):
    return evaluate.gold_outcomes(part_batch(spark, sf_dir), part_gold(spark, sf_dir)).drop("is_winter_rated")


@query("SELECT 'R' || lpad(CAST(p_partkey AS VARCHAR), 4, '0') AS row_id, p_name AS title FROM part WHERE p_partkey <= 120 AND p_partkey % 10 <> 0")
def baseline_rows(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.when(k % 10 == 0, F.concat(k, F.lit("x"))).otherwise(F.concat(F.lit("R"), F.lpad(k.cast("string"), 4, "0"))).alias("row_id"), F.col("p_name").alias("title"))
    return evaluate.up_to(p.where("row_id LIKE 'R%'"), 120)


@query("SELECT event_id, CASE WHEN event_id % 7 = 6 THEN 'Fixing' END AS category, CASE WHEN event_id % 7 = 6 THEN event_id % 2 = 0 END AS flag FROM events")
def model_responses(spark, sf_dir):
    k = F.col("event_id") % 7
    good = F.concat(F.lit('{"category": "Fixing", "subcategory": "Bolts", "attributes": {}, "is_winter_rated": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit("}"))
    answer = F.when(k == 0, "Bolts, I think").when(k == 1, '{"abstain": true}').when(k == 2, "[1]").when(k == 3, '{"category": "Fixing"}').when(k == 4, F.replace(good, F.lit('"Fixing"'), F.lit("7"))).when(k == 5, F.replace(good, F.lit("{}"), F.lit('"none"'))).otherwise(good)
    e = table(spark, sf_dir, "events").select("event_id", adapter.parsed(answer, WIDGETS).alias("c"))
    return e.select("event_id", "c.category", F.col("c.is_winter_rated").alias("flag"))
