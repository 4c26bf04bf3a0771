import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope import workspace
from tabscope.sources import history as H, landing as L, tables as T

TEXT = """id,amount,flag,city,n
1,2.5,True,Oslo,1
2,NA,False,"Rome, Italy",2
3, 7 ,,null,
4,N/A,True,NaN,4
"""


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "input.csv"
    path.write_text(TEXT)
    return str(path)


def test_text_and_inferred_scans(spark, csv):
    assert {t for _, t in T.scan_text_columns(spark, csv).dtypes} == {"string"}
    assert dict(T.scan_inferred(spark, csv).dtypes)["id"] == "int"
    assert T.column_names(T.scan_text_columns(spark, csv)) == ["id", "amount", "flag", "city", "n"]


def test_scan_with_missing(spark, csv):
    df = T.scan_with_missing(spark, csv)
    assert dict(df.dtypes) == {"id": "bigint", "amount": "double", "flag": "boolean", "city": "string", "n": "bigint"}
    rows = {r.id: r for r in df.collect()}
    assert [rows[i].amount for i in (1, 2, 3, 4)] == [2.5, None, 7.0, None]
    assert rows[3].city is None and rows[4].city is None and rows[2].city == "Rome, Italy"


MESSY = """id,name,sex,big,v
1,"Smith ""Jim"", Jr.",male,9223372036854775000,inf
2, NA ,female,-5,2
3,NA,"a\\b",17,-Infinity
"""


def test_scan_equals_a_frame_reader(spark, tmp_path):
    path = tmp_path / "messy.csv"
    path.write_text(MESSY)
    frame = pd.read_csv(path)
    df = T.scan_with_missing(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "sex": "string", "big": "bigint", "v": "double"}
    expected = [tuple(None if pd.isna(x) else x for x in row) for row in frame.itertuples(index=False)]
    assert [tuple(r) for r in df.orderBy("id").collect()] == expected


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('id,t\n1,"a\nb"\n2,c\n')
    assert [r.t for r in T.scan_with_missing(spark, str(path), multi_line=True).orderBy("id").collect()] == ["a\nb", "c"]


def test_history_before_the_first_run(spark, tmp_path):
    path = str(tmp_path / "none")
    assert H.list_runs(spark, path).count() == 0 and H.flatten_runs(spark, path).count() == 0
    assert H.find_run(spark, path, "x", ["data"]).count() == 0


def test_declared_frame(spark):
    frame = pd.DataFrame({"datesold": [pd.Timestamp("2020-01-02").date()], "postcode": [7], "price": [10], "propertyType": ["unit"], "bedrooms": [2]})
    assert T.from_frame(spark, frame, T.SALES_SCHEMA).schema == T.SALES_SCHEMA
    assert dict(T.from_frame(spark, frame[["price"]]).dtypes) == {"price": "bigint"}


def test_landing_is_write_once(spark, tmp_path):
    path = str(tmp_path / "landed")
    L.land_once(spark.range(3), path)
    L.land_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        L.land_once(spark.range(1).select(F.raise_error(F.lit("broken")).alias("x")), str(tmp_path / "other"))


def test_export_replaces(spark, tmp_path):
    path = str(tmp_path / "export")
    L.export_csv(spark.range(5), path)
    L.export_csv(spark.range(2), path)
    assert spark.read.csv(path, header=True).count() == 2


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    first = H.append_run(spark.range(1).select(F.lit("a").alias("fileName")), path)
    before = H.list_runs(spark, path)
    assert before.count() == 1
    second = H.append_run(spark.range(1).select(F.lit("b").alias("fileName")), path)
    assert first != second
    assert {r.fileName for r in H.list_runs(spark, path).collect()} == {"a", "b"}
    assert H.find_run(spark, path, second, ["fileName"]).first().fileName == "b"
    assert H.find_run(spark, path, "missing").count() == 0


def test_workspace(spark):
    stored = workspace.materialize(spark.range(4))
    assert stored.count() == 4 and stored.dtypes == spark.range(4).dtypes
    assert workspace.shared_folder(spark)


def test_failed_landing_is_repaired(spark, tmp_path):
    """The first landing fails in one row, some parts written; the next stores all of its rows."""
    path = str(tmp_path / "landed")
    broken = spark.range(0, 100, 1, 8).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        L.land_once(broken, path)
    assert not L.is_landed(spark, path) and list(tmp_path.iterdir()) == []
    assert L.land_once(spark.range(100), path) and L.is_landed(spark, path)
    assert not L.land_once(spark.range(5), path)
    assert spark.read.parquet(path).count() == 100
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["landed"]


def test_landing_over_what_another_tool_left(spark, tmp_path):
    path = tmp_path / "landed"
    spark.range(3).write.parquet(str(path))
    (path / "_SUCCESS").unlink()
    assert L.land_once(spark.range(9), str(path) + "/")
    assert spark.read.parquet(str(path)).count() == 9
    aside = [p for p in tmp_path.iterdir() if ".incomplete-" in p.name and not p.name.startswith(".")]
    assert len(aside) == 1 and spark.read.parquet(str(aside[0])).count() == 3


def test_two_landings_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "landed")
    with ThreadPoolExecutor(4) as pool:
        stored = list(pool.map(lambda n: L.land_once(spark.range(n), path), [10, 20, 30, 40]))
    assert sum(stored) == 1
    assert spark.read.parquet(path).count() == [10, 20, 30, 40][stored.index(True)]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["landed"]


RAGGED = ["a,b,c", "1,2,3", "4,5", "6,7,8,9", "", '"x, ""y""",2,"p,q"', '"one, two",3', "7,8,9", ""]


def test_ragged_lines_are_reported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text("\n".join(RAGGED))
    (tmp_path / "in" / "two.csv").write_text("a,b,c\n,,\n1,2,3,4,5\n")
    path = str(tmp_path / "in")
    rows, others = T.split_lines(spark, path)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("1", "2", "3"), ('x, "y"', "2", "p,q"), ("7", "8", "9"), (None, None, None)], key=str)
    assert rows.select("b").count() == 4 and rows.select(F.count("a")).first()[0] == 3
    found = sorted((r.file.rsplit("/", 1)[-1], r.place, r.fields, r.expected, r.line) for r in others.collect())
    assert found == [
        ("one.csv", 1, 2, 3, "4,5"),
        ("one.csv", 2, 4, 3, "6,7,8,9"),
        ("one.csv", 4, 2, 3, '"one, two",3'),
        ("two.csv", 1, 5, 3, "1,2,3,4,5"),
    ]
    with pytest.raises(ValueError, match="expected 3 fields, saw 4 .*one.csv"):
        T.scan_with_missing(spark, path)
    assert T.scan_with_missing(spark, path, ragged="drop").count() == rows.count() == 4


def test_short_lines_are_filled_up_as_by_a_frame_reader(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("a,b,c\n1,2,3\n4,5\n")
    frame = pd.read_csv(path)
    got = [tuple(r) for r in T.scan_with_missing(spark, str(path)).orderBy("a").collect()]
    assert got == [tuple(None if pd.isna(x) else x for x in row) for row in frame.itertuples(index=False)]
    path.write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(pd.errors.ParserError):
        pd.read_csv(path)
    with pytest.raises(ValueError, match="expected 2 fields, saw 3"):
        T.scan_with_missing(spark, str(path))
