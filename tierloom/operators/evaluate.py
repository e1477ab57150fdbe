"""Measurement of a batch against a gold set. Counts are aggregated by Spark; ratios are formed from the counts.

gold: row_id, expect ('decode' or 'abstain'), category, subcategory, attributes (the pack's struct), is_winter_rated.
A ratio of nothing is 1. Gold rows that were rejected stay in every denominator, so an abstention is a miss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import sha256_json
from ..packs import Pack

EVALUATION_VERSION = "2"


class EvaluationError(ValueError):
    """An input artifact breaks the evaluation's contract."""

    def __init__(self, message: str, **details) -> None:
        super().__init__(message)
        self.details = details


def round4(x: Column) -> Column:
    """A non-negative double to four places as r4() rounds it: by its exact value, a tie to the even neighbour.

    x * 20000 is split into a product and its error, which decide whether x lies above or below the middle of two neighbours.
    """
    k, p, c = F.floor(x * 10000), x * 20000, x * 134217729.0
    high = c - (c - x)
    off = (p - (2 * k + 1)) + ((high * 20000 - p) + (x - high) * 20000)
    return (k + F.when((off > 0) | ((off == 0) & (k % 2 == 1)), 1).otherwise(0)) / 10000


def ratio4(num: Column, den: Column) -> Column:
    """num / den to four places; 1 where den is 0."""
    return F.when(den == 0, 1.0).otherwise(round4(num.cast("double") / F.when(den == 0, 1).otherwise(den)))


def r4(num: int, den: int) -> float:
    """ratio4 on the driver."""
    return round(num / den, 4) if den else 1.0


def joined(outcomes: DataFrame, gold: DataFrame, how: str = "left") -> DataFrame:
    """gold with each row's outcome: state, tier, decode (nulls where the batch lacks the row). how: right keeps all outcomes instead."""
    g = gold.select("row_id", "expect", *[F.col(c).alias(f"g_{c}") for c in ("category", "subcategory", "attributes", "is_winter_rated")])
    j = g.join(outcomes.select("row_id", "state", "tier", "decode"), "row_id", how)
    d = F.col("decode")
    return j.withColumns(
        {
            "wanted": F.col("expect") == "decode",
            "got": F.coalesce(F.col("state") == "decoded", F.lit(False)),
            "cat_ok": F.coalesce(d["category"] == F.col("g_category"), F.lit(False)),
            "sub_ok": F.coalesce(d["subcategory"] == F.col("g_subcategory"), F.lit(False)),
            "p_flag": F.coalesce(d["is_winter_rated"], F.lit(False)),
            "g_flag": F.coalesce("g_is_winter_rated", F.lit(False)),
        }
    )


def flag_counts(j: DataFrame) -> DataFrame:
    """tp, fp, fn of the flag. An unexpected decode with the flag is a false positive, a rejected positive a miss."""
    w, p, g = F.col("wanted"), F.col("p_flag") & F.col("got"), F.col("g_flag")
    return j.agg(F.count_if(w & p & g).alias("tp"), F.count_if((w & p & ~g) | (~w & p)).alias("fp"), F.count_if(w & ~p & g).alias("fn"))


def category_counts(j: DataFrame) -> DataFrame:
    """category, tp, fp, support. A wrong decode is a false positive of the category it was given."""
    pred, gold = F.col("decode")["category"], F.col("g_category")
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    rows = F.array(
        F.struct(F.when(F.col("wanted"), gold).alias("category"), zero.alias("tp"), zero.alias("fp"), one.alias("support")),
        F.struct(F.when(F.col("wanted") & F.col("got") & F.col("cat_ok"), gold).alias("category"), one.alias("tp"), zero.alias("fp"), zero.alias("support")),
        F.struct(F.when(F.col("got") & (~F.col("wanted") | ~F.col("cat_ok")), pred).alias("category"), zero.alias("tp"), one.alias("fp"), zero.alias("support")),
    )
    each = j.select(F.explode(rows).alias("r")).select("r.*").where("category IS NOT NULL")
    return each.groupBy("category").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("support").alias("support"))


def attribute_counts(j: DataFrame, pack: Pack) -> DataFrame:
    """attribute, correct, total: exact matches; absent in both is correct, a rejected row is not."""
    rows = [F.struct(F.lit(a.name).alias("attribute"), (F.col("got") & F.col("decode")["attributes"][a.name].eqNullSafe(F.col("g_attributes")[a.name])).cast("long").alias("ok")) for a in pack.attrs]
    each = j.where("wanted").select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return each.groupBy("attribute").agg(F.sum("ok").alias("correct"), F.count("*").alias("total"))


def tier_counts(outcomes: DataFrame, gold: DataFrame) -> DataFrame:
    """tier, rows, gold_rows, gold_correct of decoded rows: one join, one aggregate."""
    j = joined(outcomes.where("state = 'decoded'"), gold, "right")
    wanted = F.coalesce("wanted", F.lit(False))
    right = wanted & F.col("cat_ok") & F.col("sub_ok") & (F.col("p_flag") == F.col("g_flag"))
    return j.groupBy("tier").agg(F.count("*").alias("rows"), F.count_if(wanted).alias("gold_rows"), F.count_if(right).alias("gold_correct"))


def label_pairs(df: DataFrame, gold: Column, pred: Column) -> DataFrame:
    """gold_label, pred_label, n."""
    return df.groupBy(gold.alias("gold_label"), pred.alias("pred_label")).agg(F.count("*").alias("n"))


def confusion(j: DataFrame) -> DataFrame:
    """gold_label, pred_label, n of wanted rows that were rejected or labelled otherwise."""
    d = F.col("decode")
    pred = F.when(F.col("got"), F.concat_ws("/", d["category"], d["subcategory"])).otherwise(F.concat(F.lit("<"), F.col("state"), F.lit(">")))
    wrong = j.where(F.col("wanted") & ~(F.col("got") & F.col("cat_ok") & F.col("sub_ok")))
    return label_pairs(wrong, F.concat_ws("/", "g_category", "g_subcategory"), pred)


def verdicts(outcomes: DataFrame, gold: DataFrame) -> DataFrame:
    """joined() with verdict: match, miss, recall_miss, correct_abstention or unexpected_decode."""
    w, g = F.col("wanted"), F.col("got")
    hit = F.col("cat_ok") & F.col("sub_ok") & (F.col("p_flag") == F.col("g_flag"))
    verdict = F.when(w & g & hit, "match").when(w & g, "miss").when(w, "recall_miss").when(g, "unexpected_decode").otherwise("correct_abstention")
    return joined(outcomes, gold).withColumn("verdict", verdict)


def inspect_row(outcomes: DataFrame, gold: DataFrame, row_id: str) -> DataFrame:
    """One row: row_id, sku, title, state, tier, decode, reason and the gold set's verdict (null: not a gold row)."""
    own = outcomes.where(F.col("row_id") == row_id)
    seen = verdicts(own, gold.where(F.col("row_id") == row_id)).select("row_id", "expect", "verdict")
    return own.join(seen, "row_id", "left").select("row_id", "sku", "title", "state", "tier", "decode", "reason", "expect", "verdict")


def gold_outcomes(outcomes: DataFrame, gold: DataFrame) -> DataFrame:
    """row_id, state, category, subcategory, is_winter_rated, tier of every gold row: a snapshot to hold later runs against."""
    d = F.when(F.col("state") == "decoded", F.col("decode"))
    return gold.select("row_id").join(outcomes, "row_id").select("row_id", "state", *[d[k].alias(k) for k in ("category", "subcategory", "is_winter_rated")], F.when(F.col("state") == "decoded", F.col("tier")).alias("tier"))


def missing_gold(gold: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    """The keys of gold rows that rows lack."""
    return gold.select(key).join(rows.select(key), key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """The keys that stand on both sides, each once per row of a."""
    return a.select(key).join(b.select(key), key, "left_semi")


def up_to(df: DataFrame, n: int, key: str = "row_id") -> DataFrame:
    """Rows whose key is a letter and a number of n at most."""
    return df.where(F.substring(key, 2, 18).try_cast("long") <= n)


def gold_summary(j: DataFrame) -> DataFrame:
    """Totals of the gold set's outcomes; errored rows count with the abstained."""
    w, g = F.col("wanted"), F.col("got")
    return j.agg(
        F.count("*").alias("total"),
        F.count_if(w).alias("expected"),
        F.count_if(w & g).alias("decoded"),
        F.count_if(w & g & F.col("cat_ok")).alias("category_correct"),
        F.count_if(w & ~g & (F.col("state") != "quarantined")).alias("abstained"),
        F.count_if(w & (F.col("state") == "quarantined")).alias("quarantined"),
        F.count_if(~w & g).alias("unexpected_decodes"),
        F.count_if(~w & ~g).alias("correct_abstains"),
        F.count_if(F.col("state").isNull()).alias("missing"),
    )


def duplicates(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Keys that stand more than once (or are missing), with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull() | (F.col(key).cast("string") == ""))


def evaluate(outcomes: DataFrame, gold: DataFrame, manifest: dict, pack: Pack, gold_sha256: str = "") -> dict:
    """The evaluation report. Raises EvaluationError where artifacts do not fit together."""
    if manifest["counts"]["total"] <= 0:
        raise EvaluationError("manifest total must be positive")
    if not manifest.get("schema", {}).get("passed", True):
        raise EvaluationError("manifest schema contract did not pass")
    for name, df in (("gold", gold), ("outcomes", outcomes)):
        if (twice := duplicates(df).first()) is not None:
            raise EvaluationError(f"duplicate row_id {twice['row_id']!r} in {name}", artifact=name)
    bad = gold.where(~F.coalesce(F.col("expect").isin("decode", "abstain"), F.lit(False)) | ((F.col("expect") == "decode") & F.col("is_winter_rated").isNull())).first()
    if bad is not None:
        raise EvaluationError(f"gold row {bad['row_id']} breaks the contract", artifact="gold", row_id=bad["row_id"])
    j = joined(outcomes, gold).persist()
    try:
        summary, flag = gold_summary(j).first().asDict(), flag_counts(j).first()
        if not summary["total"]:
            raise EvaluationError("gold set must not be empty")
        if summary["missing"]:
            raise EvaluationError("gold rows missing from the batch", artifact="gold")
        cats, attrs, tiers, pairs = category_counts(j).collect(), attribute_counts(j, pack).collect(), tier_counts(outcomes, gold).collect(), confusion(j).collect()
    finally:
        j.unpersist()
    categories = {}
    for r in sorted(cats, key=lambda r: r["category"]):
        p, q = r4(r["tp"], r["tp"] + r["fp"]), r4(r["tp"], r["support"])
        categories[r["category"]] = {"precision": p, "recall": q, "f1": round(2 * p * q / (p + q), 4) if p + q else 0.0, "support": r["support"]}
    end, given = r4(summary["category_correct"], summary["expected"]), r4(summary["category_correct"], summary["decoded"])
    total = manifest["counts"]
    report = {
        "evaluation_version": EVALUATION_VERSION,
        "batch_id": manifest["batch_id"],
        **{k: manifest.get(k) for k in ("decoded_sha256", "rejects_sha256")},
        "manifest_sha256": sha256_json(manifest),
        "gold_sha256": gold_sha256,
        "coverage": r4(total["decoded"], total["total"]),
        "counts": total,
        "tier_invalid": manifest.get("tier_invalid", {}),
        "flag": {"tp": flag["tp"], "fp": flag["fp"], "fn": flag["fn"], "precision": r4(flag["tp"], flag["tp"] + flag["fp"]), "recall": r4(flag["tp"], flag["tp"] + flag["fn"])},
        "category_accuracy": end,
        "conditional_category_accuracy": given,
        "categories": categories,
        "attributes": {r["attribute"]: {"correct": r["correct"], "total": r["total"], "accuracy": r4(r["correct"], r["total"])} for r in sorted(attrs, key=lambda r: r["attribute"])},
        "tiers": {r["tier"]: {"rows": r["rows"], "gold_rows": r["gold_rows"], "gold_correct": r["gold_correct"]} for r in sorted(tiers, key=lambda r: r["tier"])},
        "confusion_pairs": sorted(([r["gold_label"], r["pred_label"], r["n"]] for r in pairs), key=lambda x: (-x[2], x[0], x[1])),
        "gold": {k: summary[k] for k in ("total", "decoded", "abstained", "quarantined", "unexpected_decodes", "correct_abstains")},
    }
    report["evaluation_input_sha256"] = sha256_json({k: report[k] for k in ("evaluation_version", "manifest_sha256", "decoded_sha256", "rejects_sha256", "gold_sha256")})
    return report


def markdown(report: dict) -> str:
    """The report for readers."""
    f = report["flag"]
    out = [f"# Evaluation of batch {report['batch_id'][:12]}", "", f"Coverage {report['coverage']:.2%}", "", f"Flag: precision {f['precision']:.4f}, recall {f['recall']:.4f} (tp {f['tp']}, fp {f['fp']}, fn {f['fn']})", ""]
    out += [f"Category accuracy: end to end {report['category_accuracy']:.4f}, of decoded rows {report['conditional_category_accuracy']:.4f}", "", "| category | precision | recall | f1 | support |", "|---|---|---|---|---|"]
    out += [f"| {c} | {s['precision']} | {s['recall']} | {s['f1']} | {s['support']} |" for c, s in report["categories"].items()]
    out += ["", "| attribute | accuracy | rows |", "|---|---|---|"] + [f"| {a} | {s['accuracy']} | {s['total']} |" for a, s in report["attributes"].items()]
    out += ["", *[f"- {g} as {p}: {n}" for g, p, n in report["confusion_pairs"]]]
    return "\n".join(out) + "\n"
