import duckdb
import pytest

from tierloom.plans import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def rows(p):
    cols = sorted(p.columns)
    return cols, sorted(tuple("" if x is None or x != x else repr(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in p[cols].astype(object).where(p[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_equals_sql(spark, duck, name):
    assert rows(q.QUERIES[name](spark, DIR).toPandas()) == rows(duck.execute(q.SQL[name]).fetchdf())


def test_tree_digest_ignores_partitioning_and_counts_repeats(spark):
    from tierloom.functions.digest import row_digest, set_digest, tree_digest

    o = spark.read.parquet(f"{DIR}/orders.parquet")
    d = o.select(row_digest(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).alias("d"))
    assert q.bucketed_digests(spark, DIR).first() == tree_digest(d.repartition(7)).first()
    assert set_digest(o, ["o_orderkey"]) != set_digest(o.unionByName(o.limit(1)), ["o_orderkey"])
    assert tree_digest(d.limit(0)).first()["rows"] == 0


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(q.SQL)


def test_ratios_round_as_reports_do(spark):
    from pyspark.sql import functions as F

    from tierloom.operators.evaluate import r4, ratio4

    pairs = [(n, d) for d in (0, 1, 3, 7, 32, 64, 160, 800, 4000, 20000, 12345) for n in range(0, min(d, 700) + 1, 1)]
    pairs += [(2 * k + 1, 20000) for k in range(3000)]
    got = spark.createDataFrame(pairs, "n long, d long").select("n", "d", ratio4(F.col("n"), F.col("d")).alias("r")).collect()
    assert [(x.n, x.d, x.r) for x in got if x.r != r4(x.n, x.d)] == []
