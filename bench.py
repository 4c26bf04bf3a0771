"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``comparison`` times the same quality report made metric by metric, each with
its own jobs, as a literal reading of the original does it.
"""

from __future__ import annotations

import json
import os
import time
from itertools import product

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscope.catalog.inputs import derived, table
from tabscope.catalog.modelling import KEY, ROLES
from tabscope.operators import evaluate as E, models as M, profile as P, series as S, splitting as X
from tabscope.plans.churn_report import prepare
from tabscope.plans.quality_report import quality_report, report_row
from tabscope.session import get_session
from tabscope.workspace import materialize

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def consume(df: DataFrame) -> None:
    """Compute every row and column without bringing them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def report(df: DataFrame) -> None:
    consume(report_row(quality_report(df)))


def literal_report(df: DataFrame) -> None:
    """One job per figure: two counts per percentage, one job per pair and per text column."""
    df.dropna().count(), df.count()
    df.drop_duplicates().count(), df.count()
    df.count()
    frame = df.toPandas()
    frame.describe()
    frame.select_dtypes("number").apply(lambda c: c.value_counts(bins=10))
    numbers = [n for n, t in df.dtypes if t in ("bigint", "int", "double")]
    for a, b in product(numbers, numbers):
        df.corr(a, b)
    for name, kind in df.dtypes:
        if kind == "string":
            df.groupBy(name).count().orderBy(F.col("count").desc()).take(5)


def scored(spark: SparkSession) -> DataFrame:
    lines = table(spark, SF_DIR, "lineitem")
    return lines.select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") >= 0.05).cast("int").alias("pred"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("score"),
        F.when(F.col("l_shipdate") < "1999-01-01", "train").otherwise("test").alias("split"),
    )


def queries(spark: SparkSession) -> dict:
    orders, lines = table(spark, SF_DIR, "orders"), table(spark, SF_DIR, "lineitem")

    def forecast():
        monthly = S.monthly_totals(orders, "o_orderdate", "o_totalprice", ["o_orderstatus"])
        fitted = S.fit_trend_seasonal(monthly, ["o_orderstatus"])
        consume(S.forecast_trend_seasonal(fitted, 12, ["o_orderstatus"]))

    def curve():
        ordered = E.ordered_scores(scored(spark))
        consume(E.roc_curve(ordered))
        consume(E.roc_auc(ordered))

    churn = materialize(X.train_test_split(prepare(derived(spark, SF_DIR, "churn"), "Churn", KEY)[0], KEY), "churn")
    train = churn.filter("split = 'train'")
    fitted = M.model_pipeline(ROLES, "Churn", "lr").fit(train)
    # gaps in ten numeric columns
    wide = lines.select(
        *[F.when(F.col("l_linenumber") != i % 7, F.col(c) * (1 + i)).alias(f"{c}_{i}") for i in range(10) for c in ("l_quantity", "l_discount", "l_tax")]
    )

    return {
        "quality_report_orders": lambda: report(orders),
        "quality_report_lineitem": lambda: report(lines),
        "scorecard": lambda: consume(P.scorecard(lines)),
        "uniqueness_by_digest": lambda: consume(P.uniqueness(lines, by="digest")),
        "numeric_summary": lambda: consume(P.numeric_summary(lines)),
        "histogram": lambda: consume(P.histogram(lines)),
        "correlation": lambda: consume(P.correlation(lines)),
        "top_values": lambda: consume(P.top_values(orders)),
        "full_summary": lambda: consume(P.full_summary(orders)),
        "class_metrics": lambda: consume(E.class_metrics(E.class_counts(scored(spark)))),
        "roc_curve_and_auc": curve,
        "stratified_folds": lambda: consume(X.stratified_folds(orders, "o_orderstatus", ["o_orderkey"])),
        "exact_split": lambda: consume(X.train_test_split(orders, ["o_orderkey"], exact=True)),
        "monthly_forecast": forecast,
        "correlation_wide_with_gaps": lambda: consume(P.correlation(wide)),
        "fit_logistic": lambda: M.model_pipeline(ROLES, "Churn", "lr").fit(train),
        "fit_tree": lambda: M.model_pipeline(ROLES, "Churn", "dt").fit(train),
        "score_batch": lambda: consume(M.score(fitted, churn.drop("Churn"), KEY)),
        "cross_validation_six_folds": lambda: consume(
            M.cross_validate(churn, M.model_pipeline(ROLES, "Churn", "dt", unseen="keep"), "Churn", KEY, repeats=1)
        ),
    }


def timed(job) -> float:
    best = float("inf")
    for _ in range(REPEATS):
        begun = time.perf_counter()
        job()
        best = min(best, time.perf_counter() - begun)
    return round(best, 3)


def main() -> None:
    spark = get_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: timed(job) for name, job in queries(spark).items()}
    comparison = {}
    for name in ("orders", "lineitem"):
        df = table(spark, SF_DIR, name)
        comparison[f"literal_report_{name}"] = timed(lambda df=df: literal_report(df))
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "comparison": comparison,
                "sf": SF_DIR.rstrip("/").split("/sf")[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
