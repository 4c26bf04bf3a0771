"""Queries over sources, landing and run history.

Files are written below the session's shared folder from the given tables and
read back, so the results equal those of the tables themselves.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabscope.catalog.inputs import DIRTY_SQL, derived, sql_of, table
from tabscope.catalog.evaluation import ORACLES as EVALUATION_SQL
from tabscope.operators import cleaning as C, profile as P, series as S
from tabscope.plans.churn_report import evaluation_row, record_run
from tabscope.plans.quality_report import quality_run
from tabscope.sources import history as H, landing as L, tables as T
from tabscope.workspace import new_path


def _as_csv(df, label):
    path = new_path(df.sparkSession, label)
    L.export_csv(df, path)
    return path


def csv_text_scan(spark, sf_dir):
    return T.scan_text_columns(spark, _as_csv(table(spark, sf_dir, "customer"), "csv"))


def csv_inferred_scan(spark, sf_dir):
    path = _as_csv(table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate")), "csv")
    return T.scan_inferred(spark, path)


def csv_declared_scan(spark, sf_dir):
    """Orders in the shape of the housing sales table."""
    sales = table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("datesold"),
        F.col("o_custkey").alias("postcode"),
        F.round("o_totalprice").cast("bigint").alias("price"),
        F.col("o_orderpriority").alias("propertyType"),
        F.month("o_orderdate").alias("bedrooms"),
    )
    return T.scan_declared(spark, _as_csv(sales, "csv"), T.SALES_SCHEMA)


def csv_scan_with_missing(spark, sf_dir):
    """Quotes and commas inside names, tokens with and without blanks, infinity, 19-digit keys, a text among numbers."""
    path = new_path(spark, "csv")
    messy = derived(spark, sf_dir, "messy_customer")
    plain = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    messy.write.csv(path, header=True, escape='"', **plain)
    return T.scan_with_missing(spark, path)


def frame_with_inferred_types(spark, sf_dir):
    """A frame of per-segment totals, as a table again."""
    totals = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count("*").alias("customers"), F.max("c_acctbal").alias("highest")
    )
    return T.from_frame(spark, totals.toPandas())


def collection_scan(spark, sf_dir):
    stored = new_path(spark, "collection")
    L.land_once(table(spark, sf_dir, "supplier").withColumn("_id", F.md5("s_name")), stored)
    return T.scan_collection(spark, stored)


def landing_once(spark, sf_dir):
    """The second landing on the same place changes nothing."""
    stored = new_path(spark, "landing")
    customer = table(spark, sf_dir, "customer")
    L.land_once(customer, stored)
    L.land_once(customer.filter("c_acctbal < 0"), stored)
    return spark.read.parquet(stored)


def csv_export(spark, sf_dir):
    """An export replaces the earlier one."""
    path = new_path(spark, "export")
    monthly = S.monthly_totals(derived(spark, sf_dir, "gappy_sales"), "datesold", "price", ["series"])
    L.export_csv(monthly.limit(1), path)
    L.export_csv(C.stringify(monthly.withColumn("y", F.round("y", 2)), ["ds"]), path)
    back = T.scan_inferred(spark, path)
    return back.select("series", F.col("ds").cast("date").alias("ds"), F.round(F.col("y").cast("double"), 2).alias("y"))


def landing_after_failure(spark, sf_dir):
    """A first landing that fails in one row leaves nothing; the next one stores the table."""
    stored = new_path(spark, "landing")
    customer = table(spark, sf_dir, "customer")
    worst = customer.agg(F.max("c_custkey")).first()[0]
    broken = customer.withColumn("c_name", F.when(F.col("c_custkey") == worst, F.raise_error(F.lit("broken row"))).otherwise(F.col("c_name")))
    try:
        L.land_once(broken, stored)
    except PySparkException:
        L.land_once(customer, stored)
    return spark.read.parquet(stored)


def csv_ragged_lines(spark, sf_dir):
    """Whole lines, and lines with a field too many or too few, of one file."""
    path = new_path(spark, "csv")
    lines = derived(spark, sf_dir, "ragged_lines")
    spark.createDataFrame([("key,name,segment",)], "line string").unionByName(lines).coalesce(1).write.text(path)
    whole, others = T.split_lines(spark, path)
    text = F.concat_ws(",", "key", F.concat(F.lit('"'), "name", F.lit('"')), "segment").alias("line")
    return whole.select(F.lit(3).cast("long").alias("fields"), text).unionByName(others.select(F.col("fields").cast("long"), "line"))


def _quality_run(spark, sf_dir, name, path):
    """All eight metrics of a table that has been a file and was landed once."""
    source = derived(spark, sf_dir, name) if name == "dirty_customer" else table(spark, sf_dir, name)
    typed = T.scan_declared(spark, _as_csv(source, "csv"), source.schema)
    return quality_run(typed, new_path(spark, "landing"), path, name, "csv")


def _run_columns():
    return [
        "data.shape.n_rows",
        "data.complete",
        "data.unique",
        F.size("data.num_dist").alias("bins"),
        F.size("data.corr").alias("pairs"),
        F.size("data.cat_dist").alias("top_values"),
        F.size("data.describe").alias("summaries"),
        F.size("data.schema").alias("columns"),
        F.round(F.aggregate("data.describe", F.lit(0.0), lambda a, x: a + F.coalesce(x["mean"], F.lit(0.0))), 4).alias("means"),
        F.aggregate("data.cat_dist", F.lit(0).cast("bigint"), lambda a, x: a + x["count"]).alias("top_counts"),
    ]


def quality_history(spark, sf_dir):
    path = new_path(spark, "history")
    for name in ("dirty_customer", "supplier"):
        _quality_run(spark, sf_dir, name, path)
    return H.list_runs(spark, path).select("fileName", *_run_columns(), (F.length("_id") == 36).alias("has_id"))


def quality_history_lookup(spark, sf_dir):
    path = new_path(spark, "history")
    _quality_run(spark, sf_dir, "supplier", path)
    wanted = _quality_run(spark, sf_dir, "dirty_customer", path)
    return H.find_run(spark, path, wanted, ["data"]).select(*_run_columns())


def churn_run_recorded(spark, sf_dir):
    """The first run: nothing listed before it, then the run in the history and in the export that is read back."""
    path, export = new_path(spark, "history"), new_path(spark, "export")
    row, _, _ = evaluation_row(derived(spark, sf_dir, "scored"), "rule", 0.5, [("threshold", "1.25")])
    earlier = record_run(row, path, export).count()
    flat = T.scan_inferred(spark, export)
    metrics = ["training_accuracy", "testing_accuracy", "training_roc_score", "testing_roc_score"]
    return flat.select(F.lit(earlier).alias("earlier"), "model_name", "cross_validation", *[F.round(m, 9).alias(m) for m in metrics])


def evaluation_history_flat(spark, sf_dir):
    path = new_path(spark, "history")
    row, _, _ = evaluation_row(derived(spark, sf_dir, "scored"), "rule", 0.5, [("threshold", "1.25")])
    H.append_run(row, path)
    flat = H.flatten_runs(spark, path)
    metrics = ["training_accuracy", "testing_accuracy", "training_roc_score", "testing_roc_score"]
    return flat.select("model_name", "cross_validation", *[F.round(m, 9).alias(m) for m in metrics])


QUERIES = {
    f.__name__: f
    for f in [
        csv_text_scan, csv_inferred_scan, csv_declared_scan, csv_scan_with_missing, frame_with_inferred_types,
        collection_scan, landing_once, landing_after_failure, csv_ragged_lines, csv_export, quality_history, quality_history_lookup, evaluation_history_flat,
        churn_run_recorded,
    ]
}

_COUNTS = """SELECT COUNT(*) AS n_rows, ROUND(CAST(COUNT(*) FILTER (WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL) AS DOUBLE) / COUNT(*) * 100, 2) AS complete,
  ROUND(CAST((SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty)) AS DOUBLE) / COUNT(*) * 100, 2) AS "unique" FROM dirty"""


def _top(column: str, source: str) -> str:
    return f"(SELECT COALESCE(SUM(n), 0) AS n, COUNT(*) AS k FROM (SELECT COUNT(*) AS n FROM {source} GROUP BY {column} ORDER BY 1 DESC LIMIT 5))"


def _run_sql(counts: str, source: str, numbers: list[str], texts: list[str]) -> str:
    tops = [_top(t, source) for t in texts]
    means = " + ".join(f"AVG(CAST({c} AS DOUBLE))" for c in numbers)
    return f"""SELECT c.*, {10 * len(numbers)} AS bins, {len(numbers) ** 2} AS pairs,
  CAST({' + '.join(f'(SELECT k FROM {t})' for t in tops)} AS INTEGER) AS top_values, {len(numbers)} AS summaries, {len(numbers) + len(texts)} AS columns,
  (SELECT ROUND({means}, 4) FROM {source}) AS means, CAST({' + '.join(f'(SELECT n FROM {t})' for t in tops)} AS BIGINT) AS top_counts FROM ({counts}) AS c"""


_DIRTY_RUN = _run_sql(_COUNTS, "dirty", ["c_custkey", "c_acctbal", "c_nationkey", "c_const"], ["c_name", "c_mktsegment"])
_SUPPLIER_RUN = _run_sql(
    'SELECT COUNT(*) AS n_rows, CAST(100 AS DOUBLE) AS complete, CAST(100 AS DOUBLE) AS "unique" FROM supplier', "supplier",
    ["s_suppkey", "s_nationkey", "s_acctbal"], ["s_name"],
)

ORACLES = {
    "csv_text_scan": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
  CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer""",
    "csv_inferred_scan": """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, o_totalprice,
  CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders""",
    "csv_declared_scan": """SELECT CAST(o_orderdate AS DATE) AS datesold, o_custkey AS postcode, CAST(ROUND(o_totalprice) AS BIGINT) AS price,
  o_orderpriority AS propertyType, CAST(MONTH(o_orderdate) AS INTEGER) AS bedrooms FROM orders""",
    "csv_scan_with_missing": f"""SELECT c_custkey, name, NULLIF(token, 'NA') AS token, big,
  CAST(NULLIF(amount, 'NA') AS DOUBLE) AS amount, NULLIF(mixed, 'NA') AS mixed FROM ({sql_of('messy_customer')})""",
    "frame_with_inferred_types": "SELECT c_mktsegment, COUNT(*) AS customers, MAX(c_acctbal) AS highest FROM customer GROUP BY c_mktsegment",
    "collection_scan": "SELECT * FROM supplier",
    "landing_once": "SELECT * FROM customer",
    "csv_export": f"""WITH sales AS ({sql_of('gappy_sales')}),
ranges AS (SELECT series, date_trunc('month', MIN(datesold)) AS a, date_trunc('month', MAX(datesold)) AS b FROM sales GROUP BY series),
spine AS (SELECT series, CAST(UNNEST(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM ranges),
sums AS (SELECT series, CAST(date_trunc('month', datesold) AS DATE) AS m, SUM(price) AS y FROM sales GROUP BY 1, 2)
SELECT series, last_day(m) AS ds, ROUND(COALESCE(y, 0), 2) AS y FROM spine LEFT JOIN sums USING (series, m)""",
    "quality_history": f"""WITH {DIRTY_SQL}
SELECT 'dirty_customer' AS "fileName", *, TRUE AS has_id FROM ({_DIRTY_RUN})
UNION ALL SELECT 'supplier', *, TRUE FROM ({_SUPPLIER_RUN})""",
    "quality_history_lookup": f"WITH {DIRTY_SQL} {_DIRTY_RUN}",
    "landing_after_failure": "SELECT * FROM customer",
    "csv_ragged_lines": f"""SELECT CAST(fields AS BIGINT) AS fields, line FROM (
  SELECT line, len(string_split(regexp_replace(line, '"[^"]*"', '', 'g'), ',')) AS fields FROM ({sql_of('ragged_lines')}))""",
    "churn_run_recorded": f"""SELECT CAST(0 AS BIGINT) AS earlier, model_name, cross_validation, training_accuracy, testing_accuracy, training_roc_score, testing_roc_score
FROM ({EVALUATION_SQL['evaluation_report']})""",
    "evaluation_history_flat": f"""SELECT model_name, cross_validation, training_accuracy, testing_accuracy, training_roc_score, testing_roc_score
FROM ({EVALUATION_SQL['evaluation_report']})""",
}
