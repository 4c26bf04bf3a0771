import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import joining, ordering as O, splitting as S


def test_running_totals_match_a_plain_window(spark):
    chance = np.random.default_rng(5)
    frame = pd.DataFrame({"g": chance.integers(0, 3, 3000), "o": chance.permutation(3000), "n": chance.integers(0, 9, 3000)})
    df = spark.createDataFrame(frame)
    got = O.running_totals(df, ["g"], "o", ["n"], descending=True, look_ahead=["n"]).toPandas()
    frame = frame.sort_values("o", ascending=False)
    frame["before_n"] = frame.groupby("g")["n"].cumsum() - frame["n"]
    frame["all_n"] = frame.groupby("g")["n"].transform("sum")
    frame["next_n"] = frame.groupby("g")["n"].shift(-1)
    merged = got.merge(frame, on=["g", "o"], suffixes=("", "_x"))
    assert len(merged) == 3000
    for c in ("before_n", "all_n"):
        assert (merged[c] == merged[f"{c}_x"]).all()
    assert (merged["next_n"].fillna(-1) == merged["next_n_x"].fillna(-1)).all()


SHAPES = {
    "uniform": lambda c: c.uniform(size=5000),
    "one value is a third": lambda c: np.where(c.uniform(size=5000) < 0.34, 7.0, c.normal(size=5000)),
    "outliers": lambda c: np.concatenate([c.normal(size=4990), 10.0 ** np.arange(200, 210)]),
    "infinite": lambda c: np.concatenate([[-np.inf], c.normal(size=4998), [np.inf]]),
    "constant": lambda c: np.full(5000, 2.5),
    "few": lambda c: np.array([3.0, 1.0]),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("tuning", [{}, {"zooms": 1, "listed_rows": 5}, {"zooms": 0, "listed_rows": 5}, {"listed_rows": 10}])
def test_percentiles_match_numpy(spark, shape, tuning):
    values = SHAPES[shape](np.random.default_rng(2))
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(4)
    wanted = [0.1, 0.25, 0.5, 0.75] if shape == "infinite" else [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    spans = {"v": (len(values), float(values.min()), float(values.max()))}
    got = O.exact_percentiles(df, spans, wanted, **tuning)["v"]
    assert got == pytest.approx(list(np.percentile(values, [100 * p for p in wanted])), rel=1e-12)


@pytest.fixture(scope="module")
def keyed(spark):
    # one label holds most rows, one key a third of all rows
    rows = [(i, "big" if i % 10 else "small") for i in range(2000)] + [(5000, "big")] * 1000
    return spark.createDataFrame(rows, "k long, label string")


def test_folds_are_balanced_and_stable(spark, keyed):
    unique = keyed.filter("k < 5000")
    folded = S.stratified_folds(unique, "label", ["k"], 6)
    sizes = folded.groupBy("label", "fold").count().collect()
    for label in ("big", "small"):
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 6 and max(counts) - min(counts) <= 1
    again = S.stratified_folds(unique.repartition(7, "label"), "label", ["k"], 6)
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, again.collect()))
    other = S.stratified_folds(unique, "label", ["k"], 6, repeat=1)
    assert sorted(map(tuple, folded.collect())) != sorted(map(tuple, other.collect()))


def test_copies_of_a_key_stay_in_one_fold(keyed):
    folded = S.stratified_folds(keyed, "label", ["k"], 3)
    assert folded.count() == 3000
    assert folded.filter("k = 5000").select("fold").distinct().count() == 1


def test_tiny_groups_get_folds(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "k long, label string")
    folds = {r.k: r.fold for r in S.stratified_folds(df, "label", ["k"], 6).collect()}
    assert len(folds) == 3 and all(0 <= f < 6 for f in folds.values())


@pytest.mark.parametrize("n", [1, 2, 10, 101])
def test_exact_split_size(spark, n):
    split = S.train_test_split(spark.range(n), ["id"], 0.3, exact=True)
    assert split.filter("split = 'test'").count() == int(np.ceil(n * 0.3))


def test_split_without_counting_is_a_projection(spark):
    df = spark.range(10000)
    split = S.train_test_split(df, ["id"])
    assert "Exchange" not in split._jdf.queryExecution().toString()
    assert 2700 < split.filter("split = 'test'").count() < 3300


def test_attach_beyond_the_broadcast_limit(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("b", 4)], "k string, v int")
    values = spark.createDataFrame([(None, "none"), ("a", "A")], "k string, w string")
    for limit in (0, 10):
        got = {(r.k, r.v, r.w) for r in joining.attach(rows, values, ["k"], "left", limit).collect()}
        assert got == {(None, 1, "none"), ("a", 2, "A"), ("a", 3, "A"), ("b", 4, None)}


def test_running_totals_over_batches_and_groups(spark):
    """Groups that end inside a batch, single rows, null keys, and rows held from batch to batch."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "7")
        chance = np.random.default_rng(6)
        rows = [(None if g == 3 else f"g{g}", float(o), int(chance.integers(0, 9)), int(o % 5)) for g in range(9) for o in range([1, 40, 2, 23, 7, 8, 14, 100, 1][g])]
        df = spark.createDataFrame(rows, "g string, o double, n long, m int")
        for descending in (False, True):
            found = {(r.g, r.o): r for r in O.running_totals(df, ["g"], "o", ["n", "m"], descending, ["m"]).collect()}
            assert len(found) == len(rows)
            for g in {r[0] for r in rows}:
                own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=descending)
                for i, (_, o, n, m) in enumerate(own):
                    r = found[g, o]
                    assert (r.before_n, r.before_m) == (sum(x[2] for x in own[:i]), sum(x[3] for x in own[:i]))
                    assert (r.all_n, r.all_m) == (sum(x[2] for x in own), sum(x[3] for x in own))
                    assert r.next_m == (own[i + 1][3] if i + 1 < len(own) else None)
    finally:
        spark.conf.set(size, before)
