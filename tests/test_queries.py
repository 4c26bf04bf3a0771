"""Every registered query with SQL, beside that SQL; goldens of the survey's fixtures."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, ordered
from conftest import GOLDEN_DIR, SF_DIR
from tabscope.operators import evaluate as E, profile as P, series as S

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = db.execute(ORACLES[name])
    expected = ordered([d[0] for d in result.description], result.fetchall())
    assert ordered(df.columns, df.collect()) == expected


def golden(spark, text, **tables):
    return spark.sql(text, **{t: spark.read.parquet(f"{GOLDEN_DIR}/{t}.parquet") for t in tables["names"]})


def test_survey_goldens(spark):
    part = """SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
      CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_nationkey, 5 AS c_const FROM {customer}"""
    dirty = golden(spark, f"{part} UNION ALL {part} WHERE c_custkey % 10 = 0", names=["customer"])
    card = P.scorecard(dirty).first()
    assert (card.n_rows, card.complete_rows, card.distinct_rows) == (1650, 1284, 1500)
    top = {r.value: r["count"] for r in P.top_values(dirty, ["c_mktsegment"]).collect()}
    assert top == {"FURNITURE": 314, "BUILDING": 310, "MACHINERY": 295, "AUTOMOBILE": 292, "HOUSEHOLD": 288}

    scored = golden(
        spark,
        """SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
          CAST((l_partkey * 37 + l_linenumber * 11 + CASE WHEN l_returnflag = 'R' THEN 13 ELSE 0 END) % 101 AS DOUBLE)
            / CAST(101 AS DOUBLE) AS score,
          CASE WHEN l_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM {lineitem}""",
        names=["lineitem"],
    ).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    auc = {r.split: r.auc for r in E.roc_auc(E.ordered_scores(scored)).collect()}
    assert auc == pytest.approx({"train": 0.4979148901, "test": 0.5019552023}, abs=1e-9)
    cells = {(r.split, r.y, r.pred): r["count"] for r in E.class_counts(scored).collect()}
    assert [cells["train", y, p] for y in (0, 1) for p in (0, 1)] == [14071, 13887, 7221, 6921]
    assert [cells["test", y, p] for y in (0, 1) for p in (0, 1)] == [6067, 5929, 2977, 2927]

    sales = spark.read.parquet(f"{GOLDEN_DIR}/orders.parquet").filter(
        "NOT (o_orderdate >= '1997-03-01' AND o_orderdate < '1997-05-01')"
    )
    monthly = S.monthly_totals(sales, "o_orderdate", "o_totalprice")
    assert sales.count() == 14628
    assert monthly.count() == 80 and monthly.filter("y = 0").count() == 2
