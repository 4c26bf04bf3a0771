"""Queries over the profiling and cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog.inputs import DIRTY_SQL, derived, sql_of, table
from tabscope.functions.columns import is_complete, melt
from tabscope.functions.numbers import percent, round_percent
from tabscope.operators import cleaning as C, profile as P
from tabscope.plans.quality_report import quality_report, report_row


def _dirty(spark, sf_dir):
    return derived(spark, sf_dir, "dirty_customer")


def _rounded(df, columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def scorecard(spark, sf_dir):
    return P.scorecard(_dirty(spark, sf_dir))


def shape_and_schema(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    rows = P.shape(customer).select("n_rows").scalar()
    return P.schema_listing(customer).select("position", "name", "type", rows.alias("n_rows"))


def completeness(spark, sf_dir):
    return P.completeness(_dirty(spark, sf_dir))


def completeness_unrounded(spark, sf_dir):
    return P.completeness(_dirty(spark, sf_dir), rounded=False).withColumn("complete", F.round("complete", 9))


def uniqueness(spark, sf_dir):
    return P.uniqueness(_dirty(spark, sf_dir))


def uniqueness_by_digest(spark, sf_dir):
    return P.uniqueness(_dirty(spark, sf_dir), by="digest")


_SUMMARY = ["mean", "std", "min", "p25", "p50", "p75", "max"]


def numeric_summary(spark, sf_dir):
    return _rounded(P.numeric_summary(_dirty(spark, sf_dir)), _SUMMARY)


def numeric_summary_with_dates(spark, sf_dir):
    return _rounded(P.numeric_summary(table(spark, sf_dir, "orders")), _SUMMARY, 3)


def numeric_summary_lineitem(spark, sf_dir):
    return _rounded(P.numeric_summary(table(spark, sf_dir, "lineitem")), _SUMMARY, 3)


def text_summary(spark, sf_dir):
    return P.text_summary(_dirty(spark, sf_dir), ["c_name", "c_mktsegment"])


def full_summary(spark, sf_dir):
    wide = P.full_summary(_dirty(spark, sf_dir))
    long = melt(wide, [c for c in wide.columns if c != "summary"], value="text", ids=["summary"])
    number = F.round(F.col("text").try_cast("double"), 6)
    return long.select("summary", "column", number.alias("number"), F.when(number.isNull(), F.col("text")).alias("text"))


def histogram(spark, sf_dir):
    return _rounded(P.histogram(_dirty(spark, sf_dir)), ["low", "high"])


def histogram_with_dates(spark, sf_dir):
    return _rounded(P.histogram(table(spark, sf_dir, "orders")), ["low", "high"], 3)


def correlation(spark, sf_dir):
    return _rounded(P.correlation(_dirty(spark, sf_dir)), ["corr"])


def correlation_missing_as_zero(spark, sf_dir):
    return _rounded(P.correlation(_dirty(spark, sf_dir), missing="zero"), ["corr"])


def correlation_lineitem(spark, sf_dir):
    return _rounded(P.correlation(table(spark, sf_dir, "lineitem")), ["corr"])


def _outlier_lines(spark, sf_dir):
    return derived(spark, sf_dir, "outlier_lines")


def correlation_with_outlier(spark, sf_dir):
    """Gaps on different rows; an outlier and a far offset in rows that not all pairs share."""
    return _rounded(P.correlation(_outlier_lines(spark, sf_dir)), ["corr"])


def top_values(spark, sf_dir):
    return P.top_values(_dirty(spark, sf_dir), ["c_name", "c_mktsegment"])


def category_counts(spark, sf_dir):
    return P.category_counts(_dirty(spark, sf_dir), "c_mktsegment")


def metric_selection(spark, sf_dir):
    metrics = {"shape": True, "complete": True, "unique": True, "corr": False}
    row = report_row(quality_report(_dirty(spark, sf_dir), metrics))
    return row.select("data.shape.n_rows", "data.shape.n_columns", "data.complete", "data.unique")


def quality_report_sizes(spark, sf_dir):
    """The whole report as one row, reduced to the sizes of its parts."""
    row = report_row(quality_report(_dirty(spark, sf_dir), missing="zero"))
    return row.select(
        "data.shape.n_rows",
        "data.complete",
        "data.unique",
        F.size("data.num_dist").alias("bins"),
        F.aggregate("data.num_dist", F.lit(0).cast("bigint"), lambda a, x: a + x["count"]).alias("binned"),
        F.size("data.corr").alias("pairs"),
        F.size("data.cat_dist").alias("top_values"),
        F.size("data.describe").alias("summaries"),
        F.size("data.schema").alias("columns"),
    )


def column_projection(spark, sf_dir):
    return derived(spark, sf_dir, "gappy_sales").select("datesold", "price")


def date_from_text(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("text"))
    return orders.select("o_orderkey", C.date_from_text(F.col("text")).alias("datesold"))


def numeric_coercion(spark, sf_dir):
    return C.coerce_numbers(derived(spark, sf_dir, "text_numbers"), ["amount"])


def drop_where_zero(spark, sf_dir):
    return C.drop_where_zero(derived(spark, sf_dir, "churn"), "tenure").select("c_custkey", "tenure", "Churn")


def mean_imputation(spark, sf_dir):
    filled = C.impute_mean(_dirty(spark, sf_dir), ["c_acctbal"])
    return filled.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


def drop_incomplete(spark, sf_dir):
    return C.drop_incomplete(_dirty(spark, sf_dir))


def drop_copies(spark, sf_dir):
    return C.drop_copies(_dirty(spark, sf_dir))


def feature_label_split(spark, sf_dir):
    churn = derived(spark, sf_dir, "churn")
    features, label = C.split_label(churn, "Churn")
    counts = label.groupBy("Churn").agg(F.count("*").alias("labels"))
    wide = features.agg(F.count("*").alias("feature_rows")).withColumn("feature_columns", F.lit(len(features.columns)))
    return counts.withColumn("feature_rows", wide.select("feature_rows").scalar()).withColumn(
        "feature_columns", wide.select("feature_columns").scalar()
    )


def column_roles(spark, sf_dir):
    """Distinct values per feature, beside the role the column got."""
    churn = derived(spark, sf_dir, "churn").drop("c_custkey")
    roles = C.assign_roles(churn, "Churn", ["tenure", "MonthlyCharges", "TotalCharges"])
    role = {**{c: "numeric" for c in roles.numeric}, **{c: "categorical" for c in roles.categorical}}
    texts = churn.select(*[F.col(c).cast("string").alias(c) for c in role])
    counted = melt(texts, list(role)).groupBy("column", "value").count()
    named = F.create_map(*[F.lit(x) for pair in role.items() for x in pair])[F.col("column")]
    return counted.groupBy("column").agg(F.count("*").alias("distinct_values")).withColumn("role", named)


def columns_by_type(spark, sf_dir):
    """Non-missing cells per column, with the kind chosen from its type."""
    dirty = _dirty(spark, sf_dir)
    kinds = C.columns_by_type(dirty)
    kind = {c: k for k, names in kinds.items() for c in names}
    cells = P.without_nan(dirty).agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.count(F.col(c)).alias("present"))
                for c, k in kind.items()
            ]
        ).alias("cells")
    )
    return cells.select(F.inline("cells"))


def rounded_percentages(spark, sf_dir):
    dirty = _dirty(spark, sf_dir)
    share = percent(F.count_if(is_complete(dirty)), F.count("*"))
    return dirty.groupBy("c_nationkey").agg(round_percent(share).alias("complete"))


def stamped_strings(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate")
    )
    return C.stamp(C.stringify(orders, ["o_orderkey", "o_orderdate"])).select(
        "o_orderkey", "o_orderdate", F.col("date").isNotNull().alias("stamped")
    )


QUERIES = {
    f.__name__: f
    for f in [
        scorecard, shape_and_schema, completeness, completeness_unrounded, uniqueness, uniqueness_by_digest,
        numeric_summary, numeric_summary_with_dates, numeric_summary_lineitem, text_summary, full_summary,
        histogram, histogram_with_dates, correlation, correlation_missing_as_zero, correlation_lineitem,
        correlation_with_outlier, top_values, category_counts, metric_selection, quality_report_sizes,
        column_projection, date_from_text, numeric_coercion, drop_where_zero, mean_imputation, drop_incomplete,
        drop_copies, feature_label_split, column_roles, columns_by_type, rounded_percentages, stamped_strings,
    ]
}

_PRESENT = "c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL"
_COUNTS = f"""counts AS (
  SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE {_PRESENT}) AS complete_rows,
    (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty)) AS distinct_rows
  FROM dirty)"""
_COMPLETE = "CAST(complete_rows AS DOUBLE) / CAST(n_rows AS DOUBLE) * 100"
_UNIQUE = "CAST(distinct_rows AS DOUBLE) / CAST(n_rows AS DOUBLE) * 100"

_DIRTY_NUMBERS = ["c_custkey", "c_acctbal", "c_nationkey", "c_const"]
_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _long(columns: list[str], source: str) -> str:
    parts = [f"SELECT '{name}' AS \"column\", CAST({cell} AS DOUBLE) AS v FROM {source}" for name, cell in columns]
    return "long AS (" + " UNION ALL ".join(parts) + ")"


def _summary_sql(columns, source, places, head="", times=()) -> str:
    time_list = ", ".join(f"'{t}'" for t in times) or "''"
    return f"""WITH {head}{_long(columns, source)}
SELECT "column", COUNT(v) AS count, ROUND(AVG(v), {places}) AS mean,
  CASE WHEN "column" IN ({time_list}) THEN NULL ELSE ROUND(STDDEV_SAMP(v), {places}) END AS std,
  ROUND(MIN(v), {places}) AS min, ROUND(QUANTILE_CONT(v, 0.25), {places}) AS p25,
  ROUND(QUANTILE_CONT(v, 0.5), {places}) AS p50, ROUND(QUANTILE_CONT(v, 0.75), {places}) AS p75,
  ROUND(MAX(v), {places}) AS max
FROM long GROUP BY "column" """


def _histogram_sql(columns, source, places, head="") -> str:
    return f"""WITH {head}{_long(columns, source)},
edges AS (
  SELECT "column", CASE WHEN MIN(v) = MAX(v) THEN MIN(v) - 0.5 ELSE MIN(v) END AS lo,
    CASE WHEN MIN(v) = MAX(v) THEN MAX(v) + 0.5 ELSE MAX(v) END AS hi
  FROM long GROUP BY "column"),
grid AS (SELECT e.*, b.bin FROM edges AS e, (SELECT UNNEST(range(10)) AS bin) AS b),
binned AS (
  SELECT l."column", LEAST(FLOOR((v - lo) / (hi - lo) * 10), 9) AS bin, COUNT(*) AS n
  FROM long AS l JOIN edges AS e ON l."column" = e."column" WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT g."column", CAST(g.bin AS INTEGER) AS bin, ROUND(lo + (hi - lo) / 10 * g.bin, {places}) AS low,
  ROUND(lo + (hi - lo) / 10 * (g.bin + 1), {places}) AS high, COALESCE(n, 0) AS count
FROM grid AS g LEFT JOIN binned AS b ON g."column" = b."column" AND g.bin = b.bin"""


def _correlation_sql(names, source, head="", zero=False) -> str:
    def cell(name):
        return f"COALESCE(CAST({name} AS DOUBLE), 0)" if zero else f"CAST({name} AS DOUBLE)"

    parts = []
    for a in names:
        for b in names:
            x, y = cell(a), cell(b)
            both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
            if a == b:
                value = f"CASE WHEN STDDEV_POP({x}) > 0 THEN 1.0 END"
            else:
                spread = f"(STDDEV_POP({x}) FILTER (WHERE {both}) * STDDEV_POP({y}) FILTER (WHERE {both}))"
                value = f"COVAR_POP({x}, {y}) / NULLIF({spread}, 0)"
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, ROUND(CAST({value} AS DOUBLE), 6) AS corr FROM {source}")
    return f"{'WITH ' + head if head else ''}" + " UNION ALL ".join(parts)


_DIRTY_MEASURES = [(c, c) for c in _DIRTY_NUMBERS]
_ORDER_MEASURES = [("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("o_totalprice", "o_totalprice"), ("o_orderdate", "epoch(o_orderdate)")]
_TEXTS = """texts AS (
  SELECT 'c_name' AS "column", c_name AS value, COUNT(*) AS n FROM dirty GROUP BY c_name
  UNION ALL SELECT 'c_mktsegment', c_mktsegment, COUNT(*) FROM dirty GROUP BY c_mktsegment)"""

_FULL = " UNION ALL ".join(
    f"""SELECT '{stat}' AS summary, '{c}' AS "column", ROUND(CAST({value} AS DOUBLE), 6) AS number, {text} AS text FROM dirty"""
    for c in _DIRTY_NUMBERS + ["c_name", "c_mktsegment"]
    for stat, value, text in (
        [("count", f"COUNT({c})", "NULL"), ("mean", f"AVG({c})", "NULL"), ("stddev", f"STDDEV_SAMP({c})", "NULL"), ("min", f"MIN({c})", "NULL"), ("max", f"MAX({c})", "NULL")]
        if c in _DIRTY_NUMBERS
        else [("count", f"COUNT({c})", "NULL"), ("mean", "MAX(NULL)", "NULL"), ("stddev", "MAX(NULL)", "NULL"), ("min", "NULL", f"MIN({c})"), ("max", "NULL", f"MAX({c})")]
    )
)

_CUSTOMER_TYPES = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]

ORACLES = {
    "scorecard": f"""WITH {DIRTY_SQL}, {_COUNTS}
SELECT n_rows, 6 AS n_columns, complete_rows, distinct_rows, ROUND({_COMPLETE}, 2) AS complete, ROUND({_UNIQUE}, 2) AS "unique" FROM counts""",
    "shape_and_schema": " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS name, '{t}' AS type, COUNT(*) AS n_rows FROM customer" for i, (n, t) in enumerate(_CUSTOMER_TYPES)
    ),
    "completeness": f"""WITH {DIRTY_SQL}, {_COUNTS} SELECT n_rows, complete_rows, ROUND({_COMPLETE}, 2) AS complete FROM counts""",
    "completeness_unrounded": f"""WITH {DIRTY_SQL}, {_COUNTS} SELECT n_rows, complete_rows, ROUND({_COMPLETE}, 9) AS complete FROM counts""",
    "uniqueness": f"""WITH {DIRTY_SQL}, {_COUNTS} SELECT n_rows, distinct_rows, ROUND({_UNIQUE}, 2) AS "unique" FROM counts""",
    "uniqueness_by_digest": f"""WITH {DIRTY_SQL}, {_COUNTS} SELECT n_rows, distinct_rows, ROUND({_UNIQUE}, 2) AS "unique" FROM counts""",
    "numeric_summary": _summary_sql(_DIRTY_MEASURES, "dirty", 6, DIRTY_SQL + ", "),
    "numeric_summary_with_dates": _summary_sql(_ORDER_MEASURES, "orders", 3, times=["o_orderdate"]),
    "numeric_summary_lineitem": _summary_sql(
        [(c, c) for c in _LINE_NUMBERS] + [("l_shipdate", "epoch(l_shipdate)")], "lineitem", 3, times=["l_shipdate"]
    ),
    "text_summary": f"""WITH {DIRTY_SQL}, {_TEXTS}
SELECT "column", CAST(SUM(n) AS BIGINT) AS count, COUNT(*) AS "unique",
  FIRST(value ORDER BY n DESC, value) AS top, MAX(n) AS freq
FROM texts WHERE value IS NOT NULL GROUP BY "column" """,
    "full_summary": f"WITH {DIRTY_SQL} {_FULL}",
    "histogram": _histogram_sql(_DIRTY_MEASURES, "dirty", 6, DIRTY_SQL + ", "),
    "histogram_with_dates": _histogram_sql(_ORDER_MEASURES, "orders", 3),
    "correlation": _correlation_sql(_DIRTY_NUMBERS, "dirty", DIRTY_SQL + " "),
    "correlation_missing_as_zero": _correlation_sql(_DIRTY_NUMBERS, "dirty", DIRTY_SQL + " ", zero=True),
    "correlation_lineitem": _correlation_sql(_LINE_NUMBERS, "lineitem"),
    "correlation_with_outlier": _correlation_sql(["quantity", "price", "tax", "far"], "lines", f"lines AS ({sql_of('outlier_lines')}) "),
    "top_values": f"""WITH {DIRTY_SQL}, {_TEXTS}
SELECT "column", CAST(r AS INTEGER) AS rank, value, n AS count
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS LAST) AS r FROM texts) WHERE r <= 5""",
    "category_counts": f"""WITH {DIRTY_SQL} SELECT c_mktsegment, COUNT(*) AS count FROM dirty WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""",
    "metric_selection": f"""WITH {DIRTY_SQL}, {_COUNTS}
SELECT n_rows, 6 AS n_columns, ROUND({_COMPLETE}, 2) AS complete, ROUND({_UNIQUE}, 2) AS "unique" FROM counts""",
    "quality_report_sizes": f"""WITH {DIRTY_SQL}, {_COUNTS}
SELECT n_rows, ROUND({_COMPLETE}, 2) AS complete, ROUND({_UNIQUE}, 2) AS "unique", 40 AS bins,
  (SELECT COUNT(c_custkey) + COUNT(c_acctbal) + COUNT(c_nationkey) + COUNT(c_const) FROM dirty) AS binned,
  16 AS pairs,
  CAST((SELECT LEAST(COUNT(*), 5) FROM (SELECT DISTINCT c_name FROM dirty))
     + (SELECT LEAST(COUNT(*), 5) FROM (SELECT DISTINCT c_mktsegment FROM dirty)) AS INTEGER) AS top_values,
  4 AS summaries, 6 AS columns
FROM counts""",
    "column_projection": f"SELECT datesold, price FROM ({sql_of('gappy_sales')})",
    "date_from_text": "SELECT o_orderkey, CAST(split_part(CAST(o_orderdate AS VARCHAR), ' ', 1) AS DATE) AS datesold FROM orders",
    "numeric_coercion": f"SELECT c_custkey, TRY_CAST(NULLIF(trim(amount), '1d') AS DOUBLE) AS amount FROM ({sql_of('text_numbers')})",
    "drop_where_zero": f"SELECT c_custkey, CAST(tenure AS INTEGER) AS tenure, Churn FROM ({sql_of('churn')}) WHERE tenure <> 0 OR tenure IS NULL",
    "mean_imputation": f"""WITH {DIRTY_SQL}
SELECT c_custkey, ROUND(COALESCE(c_acctbal, (SELECT AVG(c_acctbal) FROM dirty)), 6) AS c_acctbal FROM dirty""",
    "drop_incomplete": f"WITH {DIRTY_SQL} SELECT * FROM dirty WHERE {_PRESENT}",
    "drop_copies": f"WITH {DIRTY_SQL} SELECT DISTINCT * FROM dirty",
    "feature_label_split": f"""WITH c AS ({sql_of('churn')})
SELECT Churn, COUNT(*) AS labels, (SELECT COUNT(*) FROM c) AS feature_rows, 7 AS feature_columns FROM c GROUP BY Churn""",
    "column_roles": f"WITH c AS ({sql_of('churn')}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS distinct_values, '{r}' AS role FROM c"
        for c, r in [("Segment", "categorical"), ("Region", "categorical"), ("UrgentBuyer", "categorical"), ("tenure", "numeric"), ("MonthlyCharges", "numeric"), ("TotalCharges", "numeric")]
    ),
    "columns_by_type": f"WITH {DIRTY_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{'numeric' if c in _DIRTY_NUMBERS else 'categorical'}' AS kind, COUNT({c}) AS present FROM dirty"
        for c in _DIRTY_NUMBERS + ["c_name", "c_mktsegment"]
    ),
    "rounded_percentages": f"""WITH {DIRTY_SQL}
SELECT c_nationkey, ROUND(CAST(COUNT(*) FILTER (WHERE {_PRESENT}) AS DOUBLE) / COUNT(*) * 100, 2) AS complete FROM dirty GROUP BY c_nationkey""",
    "stamped_strings": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, TRUE AS stamped FROM orders",
}
