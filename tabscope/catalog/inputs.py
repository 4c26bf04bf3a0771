"""Input tables of the registered queries.

The given tables hold no missing values and no copies, so the derived inputs add
them. Each derived input is one SQL text that runs unchanged on Spark and on the
checking engine.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

_CUSTOMER_COLUMNS = """c_custkey, c_name,
  CASE WHEN c_nationkey = 7 THEN NULL
       WHEN c_nationkey = 9 THEN CAST('NaN' AS DOUBLE)
       ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_nationkey IN (3, 11) THEN NULL ELSE c_mktsegment END AS c_mktsegment,
  c_nationkey, 5 AS c_const"""

DERIVED = {
    # nulls, NaN, copies and a constant column
    "dirty_customer": f"""
SELECT {_CUSTOMER_COLUMNS} FROM {{customer}}
UNION ALL
SELECT {_CUSTOMER_COLUMNS} FROM {{customer}} WHERE c_acctbal < 1000""",
    # blank and malformed numbers
    "text_numbers": """
SELECT c_custkey,
  CASE WHEN c_nationkey = 4 THEN ' '
       WHEN c_nationkey = 5 THEN '1d'
       WHEN c_nationkey = 6 THEN 'NA'
       ELSE CAST(c_acctbal AS STRING) END AS amount
FROM {customer}""",
    # a file's usual troubles, all columns as they are written
    "messy_customer": """
SELECT c_custkey,
  CASE WHEN c_nationkey = 1 THEN c_name || ' "Jim", Jr.' ELSE c_name END AS name,
  CASE WHEN c_nationkey = 2 THEN ' NA ' WHEN c_nationkey = 3 THEN 'NA' ELSE c_mktsegment END AS token,
  CAST(9223372036854770000 + c_custkey % 1000 AS BIGINT) AS big,
  CASE WHEN c_nationkey = 5 THEN 'inf' WHEN c_nationkey = 6 THEN 'NA' ELSE CAST(c_acctbal AS STRING) END AS amount,
  CASE WHEN c_nationkey = 4 THEN ' ' WHEN c_nationkey = 5 THEN '1d' WHEN c_nationkey = 6 THEN 'NA'
       ELSE CAST(c_custkey AS STRING) END AS mixed
FROM {customer}""",
    # lines of a file with three columns: a separator inside quotes, a field too many, a field too few
    "ragged_lines": """
SELECT CASE WHEN c_nationkey = 1 THEN CAST(c_custkey AS STRING) || ',"' || c_name || '",' || c_mktsegment || ',extra'
            WHEN c_nationkey = 2 THEN CAST(c_custkey AS STRING) || ',"' || c_name || ', Jr."'
            WHEN c_nationkey = 3 THEN CAST(c_custkey AS STRING) || ',"' || c_name || ', Jr.",' || c_mktsegment
            ELSE CAST(c_custkey AS STRING) || ',"' || c_name || '",' || c_mktsegment END AS line
FROM {customer}""",
    # measures with gaps, one row far out, and an offset that only some rows have
    "outlier_lines": """
SELECT CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS quantity,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS price, l_tax AS tax,
  CASE WHEN l_linenumber = 1 THEN 1000000 + l_discount * 100 WHEN l_linenumber = 4 THEN l_discount END AS far
FROM {lineitem}
UNION ALL
SELECT CAST(1e12 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(1e9 AS DOUBLE), CAST(NULL AS DOUBLE) FROM {region} WHERE r_regionkey = 0""",
    # two months without any sale
    "gappy_sales": """
SELECT CAST(o_orderdate AS DATE) AS datesold, o_totalprice AS price, o_orderstatus AS series
FROM {orders}
WHERE NOT (o_orderdate >= TIMESTAMP '1997-03-01 00:00:00'
       AND o_orderdate <  TIMESTAMP '1997-05-01 00:00:00')""",
    # label, prediction and tied scores in two splits
    "scored": """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  CASE WHEN l_quantity * l_discount >= 1.25 THEN 1 ELSE 0 END AS pred,
  l_quantity * l_discount / 5 AS score,
  CASE WHEN l_shipdate < TIMESTAMP '1999-01-01 00:00:00' THEN 'train' ELSE 'test' END AS split
FROM {lineitem}""",
    # three classes, a score for each of them with ties, and a prediction that is often right
    "scored_classes": """
SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
  CASE WHEN l_partkey % 3 = 0 THEN 1 WHEN l_returnflag = 'A' THEN 0 ELSE 2 END AS pred,
  CAST((l_partkey * 37 + CASE WHEN l_returnflag = 'A' THEN 13 ELSE 0 END) % 101 AS DOUBLE) AS s0,
  CAST((l_suppkey * 11 + CASE WHEN l_returnflag = 'N' THEN 9 ELSE 0 END) % 53 AS DOUBLE) AS s1,
  l_quantity * l_discount AS s2,
  CASE WHEN l_shipdate < TIMESTAMP '1999-01-01 00:00:00' THEN 'train' ELSE 'test' END AS split
FROM {lineitem}""",
    # order histories as a churn table; customers without orders have no tenure and blank charges
    "churn": """
SELECT c_custkey, c_mktsegment AS Segment, r_name AS Region,
  CASE WHEN urgent * 4 > n THEN 1 ELSE 0 END AS UrgentBuyer,
  COALESCE((YEAR(last_day_seen) - YEAR(first_day_seen)) * 12 + MONTH(last_day_seen) - MONTH(first_day_seen), 0) AS tenure,
  COALESCE(total / n, 0) AS MonthlyCharges,
  CASE WHEN n IS NULL THEN ' ' ELSE CAST(total AS STRING) END AS TotalCharges,
  CASE WHEN last_day_seen >= TIMESTAMP '2001-01-01 00:00:00' THEN 'No' ELSE 'Yes' END AS Churn
FROM {customer}
JOIN {nation} ON c_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
LEFT JOIN (
  SELECT o_custkey, COUNT(*) AS n, CAST(ROUND(SUM(o_totalprice)) AS BIGINT) AS total,
    MIN(o_orderdate) AS first_day_seen, MAX(o_orderdate) AS last_day_seen,
    SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent
  FROM {orders} GROUP BY o_custkey) AS per_customer ON o_custkey = c_custkey""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tables_in(text: str) -> list[str]:
    return sorted({field for _, field, _, _ in Formatter().parse(text) if field})


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = DERIVED[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _tables_in(text)})


def sql_of(name: str) -> str:
    """The derived input as a subquery for the checking engine."""
    text = DERIVED[name]
    return text.format(**{t: t for t in _tables_in(text)}).strip()


DIRTY_SQL = f"""dirty AS (
  SELECT c_custkey, c_name, CASE WHEN isnan(c_acctbal) THEN NULL ELSE c_acctbal END AS c_acctbal,
    c_mktsegment, c_nationkey, c_const
  FROM ({sql_of('dirty_customer')}))"""


def position_sql(seed: str, *keys: str) -> str:
    """The row position of ``functions.hashing`` in the checking engine."""
    marked = [f"COALESCE('|' || CAST(length(CAST({k} AS VARCHAR)) AS VARCHAR) || ':' || CAST({k} AS VARCHAR), '|')" for k in keys]
    text = " || ".join([f"'{seed}'", *marked])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"
