import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabscope.operators import features as X, models as M
from tabscope.operators.boosting import StumpBoosting
from tabscope.operators.cleaning import Roles
from tabscope.operators.compare import compare_classifiers, compare_regressors, set_up
from tabscope.plans.churn_report import churn_report
from tabscope.plans.model_comparison import comparison_report
from tabscope.streaming.scoring import arriving_files, batch_writer, checked, score_good_records, score_stream
from pyspark.ml import classification as C, regression as R


@pytest.fixture(scope="module")
def frame():
    chance = np.random.default_rng(11)
    n = 400
    tenure = chance.integers(0, 60, n)
    contract = chance.choice(["month", "year", "two"], n, p=[0.6, 0.25, 0.15])
    signal = (tenure < 20).astype(int) + (contract == "month") + chance.normal(0, 0.4, n)
    monthly = chance.uniform(20, 120, n)
    return pd.DataFrame(
        {
            "id": np.arange(n),
            "SeniorCitizen": chance.integers(0, 2, n),
            "Contract": contract,
            "tenure": tenure,
            "MonthlyCharges": monthly,
            "TotalCharges": [" " if t == 0 else f"{t * m:.2f}" for t, m in zip(tenure, monthly)],
            "Churn": np.where(signal > 1.2, "Yes", "No"),
        }
    )


@pytest.fixture(scope="module")
def rows(spark, frame):
    return spark.createDataFrame(frame).withColumn("TotalCharges", F.col("TotalCharges").try_cast("double")).dropna()


ROLES = Roles(["tenure", "MonthlyCharges", "TotalCharges"], ["SeniorCitizen", "Contract"], [])


def test_transformer_layout(rows, frame):
    roles = Roles(["tenure"], ["Contract", "SeniorCitizen"], ["MonthlyCharges"])
    fitted = X.feature_pipeline(roles).fit(rows)
    got = {r.id: r.v for r in fitted.transform(rows).select("id", vector_to_array("features").alias("v")).collect()}
    used = frame[frame.tenure > 0]
    mean, deviation = used.tenure.mean(), used.tenure.std(ddof=0)
    for _, r in used.iterrows():
        hot = [float(r.Contract == c) for c in ("month", "two", "year")] + [float(r.SeniorCitizen == c) for c in (0, 1)]
        assert got[r.id] == pytest.approx([(r.tenure - mean) / deviation, *hot, r.MonthlyCharges])


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    out = X.PopulationScaler(inputCols=["v"], outputCols=["z"]).fit(df).transform(df)
    assert [r.z for r in out.collect()] == [0.0, 0.0]


def test_unseen_category_raises_or_is_kept(rows):
    new = rows.withColumn("Contract", F.lit("decade"))
    strict = X.feature_pipeline(Roles([], ["Contract"], [])).fit(rows)
    with pytest.raises(Exception):
        strict.transform(new).select("features").collect()
    lenient = X.feature_pipeline(Roles([], ["Contract"], []), unseen="keep").fit(rows)
    assert lenient.transform(new).select("features").first().features.size == 4


@pytest.mark.parametrize("key", ["lr", "dt", "rf", "gb", "xgb", "ada"])
def test_models_learn_and_survive_saving(spark, rows, tmp_path, key):
    small = {"rf": {"numTrees": 5}, "gb": {"maxIter": 3}, "xgb": {"maxIter": 2}, "ada": {"maxIter": 4, "storeEvery": 2}}
    fitted = M.model_pipeline(ROLES, "Churn", key, **small.get(key, {})).fit(rows)
    assert M.class_labels(fitted) == ["No", "Yes"]
    scored = M.predictions(fitted, rows, [])
    assert scored.agg(F.avg((F.col("y") == F.col("pred")).cast("int"))).first()[0] > 0.75
    assert scored.filter("score < 0 OR score > 1").count() == 0
    fitted.write().overwrite().save(str(tmp_path / key))
    again = PipelineModel.load(str(tmp_path / key))
    fields = rows.drop("Churn")
    before = {r.id: (r.label_name, r.prob) for r in M.score(fitted, fields, ["id"], "label_name").collect()}
    after = {r.id: (r.label_name, r.prob) for r in M.score(again, fields, ["id"], "label_name").collect()}
    assert before == after and all(50 <= p <= 100 for _, p in before.values())
    with pytest.raises(ValueError):
        M.classifier("svm")


def brute_boosting(x, y, rounds):
    """Boosted stumps on one column: every cut between values, both directions."""
    w, total = np.ones(len(y)), np.zeros(len(y))
    cuts = (np.unique(x)[:-1] + np.unique(x)[1:]) / 2
    votes = []
    for _ in range(rounds):
        w = w / w.sum()

        def impurity(mask):
            part = w[mask]
            p = part[y[mask] == 1].sum() / part.sum()
            return part.sum() * 2 * p * (1 - p)

        best = min(cuts, key=lambda c: impurity(x <= c) + impurity(x > c))
        pred = np.zeros(len(y))
        for side in (x <= best, x > best):
            pred[side] = float(w[side][y[side] == 1].sum() > w[side].sum() / 2)
        error = w[pred != y].sum()
        vote = math.log((1 - error) / error)
        votes.append(vote)
        w = w * np.exp(vote * (pred != y))
        total += vote * (2 * pred - 1)
    return 1 / (1 + np.exp(-total / sum(votes)))


def test_boosting_matches_brute_force(spark):
    from pyspark.ml.feature import VectorAssembler

    chance = np.random.default_rng(6)
    x = np.arange(24, dtype=float)
    y = ((x > 6) & (x < 17)).astype(float)
    y[[1, 10, 20]] = 1 - y[[1, 10, 20]]
    df = spark.createDataFrame(pd.DataFrame({"x": x, "label": y}))
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    fitted = StumpBoosting(maxIter=4, storeEvery=2).fit(df)
    got = [r.p for r in fitted.transform(df).orderBy("x").selectExpr("positive_probability AS p").collect()]
    assert got == pytest.approx(list(brute_boosting(x, y, 4)), abs=1e-9)


def brute_many_classes(x, y, classes, rounds):
    """Boosted stumps of one column for any number of classes: mean vote per class, and its softmax."""
    w, votes, total = np.ones(len(y)), [], np.zeros((len(y), classes))
    cuts = (np.unique(x)[:-1] + np.unique(x)[1:]) / 2
    one_hot = np.eye(classes)[y.astype(int)]
    for _ in range(rounds):
        w = w / w.sum()

        def impurity(mask):
            own = (w[mask][:, None] * one_hot[mask]).sum(0)
            return own.sum() - (own**2).sum() / own.sum()

        best = min(cuts, key=lambda c: impurity(x <= c) + impurity(x > c))
        pred = np.zeros(len(y))
        for side in (x <= best, x > best):
            pred[side] = (w[side][:, None] * one_hot[side]).sum(0).argmax()
        error = w[pred != y].sum()
        if error >= 1 - 1 / classes:
            break
        votes.append(math.log((1 - error) / error) + math.log(classes - 1))
        w = w * np.exp(votes[-1] * (pred != y))
        total += votes[-1] * np.where(np.eye(classes)[pred.astype(int)] == 1, 1, -1 / (classes - 1))
    mean = total / sum(votes)
    power = np.exp(mean / (classes - 1))
    return mean.argmax(1), power / power.sum(1, keepdims=True)


@pytest.mark.parametrize("classes", [3, 5])
def test_boosting_of_many_classes_matches_brute_force(spark, tmp_path, classes):
    from pyspark.ml.feature import VectorAssembler

    chance = np.random.default_rng(classes)
    x = np.arange(60, dtype=float)
    y = np.minimum(x * classes // 60, classes - 1)
    y = np.where(chance.random(60) < 0.2, chance.integers(0, classes, 60), y).astype(float)
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(pd.DataFrame({"x": x, "label": y})))
    boosting = StumpBoosting(maxIter=5, storeEvery=2)
    import tabscope.operators.boosting as B

    tree = B.DecisionTreeClassifier
    B.DecisionTreeClassifier = lambda **named: tree(maxBins=64, **named)
    try:
        fitted = boosting.fit(df)
    finally:
        B.DecisionTreeClassifier = tree
    pred, shares = brute_many_classes(x, y, classes, 5)
    fitted.write().save(str(tmp_path / "model"))
    for model in (fitted, PipelineModel.load(str(tmp_path / "model"))):
        got = model.transform(df).orderBy("x").select("prediction", vector_to_array("probability").alias("p")).collect()
        assert [r.p for r in got] == [pytest.approx(list(s), abs=1e-9) for s in shares]
        assert [r.prediction for r in got] == list(pred)


@pytest.mark.parametrize("key", ["gb", "xgb", "ada", "rf"])
def test_models_of_three_classes(spark, rows, tmp_path, key):
    small = {"rf": {"numTrees": 5}, "gb": {"maxIter": 3}, "xgb": {"maxIter": 2}, "ada": {"maxIter": 4}}
    roles = Roles(["tenure", "MonthlyCharges"], ["SeniorCitizen"], [])
    three = rows.withColumn("Stage", F.expr("CASE WHEN tenure < 20 THEN 'early' WHEN MonthlyCharges > 70 THEN 'rich' ELSE 'other' END"))
    fitted = M.model_pipeline(roles, "Stage", key, **small[key]).fit(three)
    scored = M.predictions(fitted, three, [])
    assert scored.agg(F.avg((F.col("y") == F.col("pred")).cast("int"))).first()[0] > 0.75
    fitted.write().save(str(tmp_path / key))
    fields = three.drop("Stage")
    before = {r.id: (r.name, r.prob) for r in M.score(fitted, fields, ["id"], "name").collect()}
    after = {r.id: (r.name, r.prob) for r in M.score(PipelineModel.load(str(tmp_path / key)), fields, ["id"], "name").collect()}
    assert before == after and {n for n, _ in before.values()} == {"early", "rich", "other"}
    assert all(100 / 3 <= p <= 100 for _, p in before.values())


def test_a_class_without_rows(spark, rows):
    """A class number that no training row has, as a fold may lack one."""
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=["tenure"], outputCol="features").transform(rows)
    points = points.withColumn("label", F.when(F.col("tenure") < 25, 0.0).otherwise(2.0))
    for key in ("gb", "ada"):
        out = M.classifier(key, maxIter=2).fit(points).transform(points)
        assert {r.prediction for r in out.select("prediction").distinct().collect()} == {0.0, 2.0}
        assert out.filter(F.col("label") != F.col("prediction")).count() == 0


def test_cross_validation(rows):
    estimator = M.model_pipeline(ROLES, "Churn", "dt", unseen="keep", maxDepth=3)
    scores = M.cross_validate(rows, estimator, "Churn", ["id"], folds=3, repeats=2)
    got = {(r.repeat, r.fold): r.accuracy for r in scores.collect()}
    assert set(got) == {(r, f) for r in range(2) for f in range(3)} and min(got.values()) > 0.6
    again = M.cross_validate(rows.repartition(5), estimator, "Churn", ["id"], folds=3, repeats=2)
    assert {(r.repeat, r.fold): r.accuracy for r in again.collect()} == got


def test_first_parameters():
    names = [n for n, _ in M.first_parameters(M.classifier("lr"))]
    assert len(names) == 5 and names == sorted(names)


def test_churn_report(spark, frame):
    table = spark.createDataFrame(frame)
    report = churn_report(table, "dt", ["id"], folds=2, repeats=1, maxDepth=3)
    row = report.row.first()
    assert row.model_name == "DecisionTreeClassifier" and len(row.model_params) == 5
    assert row.training_result.accuracy > 0.75 and 0.5 < row.testing_result.roc_score <= 1
    assert row.cross_validation == pytest.approx(np.mean([r.accuracy for r in report.fold_scores.collect()]))
    total = sum(c["count"] for side in (row.training_result, row.testing_result) for c in side.confusion_matrix)
    assert total == (frame.tenure > 0).sum()
    assert report.roc_curve.filter("fpr = 0 AND tpr = 0").count() >= 2


def test_set_up_imputes_and_encodes(spark, frame):
    table = frame.assign(Contract=[None if i % 7 == 0 else c for i, c in enumerate(frame.Contract)], name=[f"n{i}" for i in frame.id])
    df = spark.createDataFrame(table).withColumn("TotalCharges", F.col("TotalCharges").try_cast("double"))
    assert set_up(df, "Churn", ["id"]).hashed == []
    experiment = set_up(df, "Churn", ["id"], hashed=["name"])
    assert experiment.hashed == ["name"] and "id" not in experiment.roles.numeric
    from pyspark.ml import Pipeline

    encoded = Pipeline(stages=experiment.stages).fit(experiment.train).transform(experiment.rows)
    assert encoded.filter("TotalCharges IS NULL OR Contract IS NULL").count() == 0
    assert encoded.select("features").count() == len(frame)


def test_comparisons(spark, frame):
    df = spark.createDataFrame(frame).withColumn("TotalCharges", F.col("TotalCharges").try_cast("double"))
    pair = {"Decision Tree": C.DecisionTreeClassifier(maxDepth=3), "Always": C.DecisionTreeClassifier(maxDepth=0)}
    board = compare_classifiers(set_up(df, "Churn", ["id"]), folds=2, candidates=pair).collect()
    assert [r.model for r in board] == ["Decision Tree", "Always"] and [r.best for r in board] == [True, False]
    assert board[0].accuracy > board[1].accuracy and 0 <= board[0].auc <= 1
    three = set_up(df.drop("Churn"), "Contract", ["id"])
    wide = compare_classifiers(three, folds=2, candidates={"Tree": C.DecisionTreeClassifier(maxDepth=2)}).first()
    assert 0 <= wide.auc <= 1 and -1 <= wide.mcc <= 1 and 0 <= wide.f1 <= 1
    report = comparison_report(
        df.drop("Churn"), "MonthlyCharges", "Regression", ["id"], folds=2, candidates={"Linear": R.LinearRegression(), "Tree": R.DecisionTreeRegressor()}
    )
    values = report.leaderboard.collect()
    assert values[0].r2 >= values[1].r2 and values[0].best
    assert report.model.transform(report.experiment.rows).filter("prediction IS NOT NULL").count() == len(frame)
    winner = comparison_report(df, "Churn", "Classification", ["id"], folds=2, candidates=pair)
    scored = M.score(winner.model, winner.experiment.rows.drop("Churn"), ["id"])
    assert {r.prediction_label for r in scored.collect()} == {"No", "Yes"}


def test_features_of_every_type_and_size(spark):
    rows = [(i, i % 2 == 0, f"2020-01-{1 + i % 28:02d}", f"c{i % 27}", float(i), "y" if i % 3 else "n") for i in range(120)]
    df = spark.createDataFrame(rows, "id int, flag boolean, d string, cat string, v double, target string").withColumn("d", F.to_date("d"))
    experiment = set_up(df.withColumn("t", F.col("d").cast("timestamp")), "target", ["id"])
    roles = {r.column: r.role for r in experiment.described().collect()}
    assert roles == {"flag": "numeric", "d": "numeric", "t": "numeric", "v": "numeric", "cat": "categorical", "target": "target", "id": "key"}


def test_numeric_labels_keep_their_order(spark):
    df = spark.createDataFrame([(10, 1.5), (2, 10.0), (10, 2.5)], "label_in int, v double")
    fitted = X.label_encoder("label_in").fit(df)
    assert [int(r.label) for r in fitted.transform(df).collect()] == [1, 0, 1]
    assert list(X.label_encoder("v").fit(df).labelsArray[0]) == ["1.5", "2.5", "10.0"]


def test_leaderboard_never_picks_a_missing_metric(spark):
    from tabscope.operators.compare import leaderboard

    board = spark.createDataFrame([("a", float("nan")), ("b", 0.5), ("c", None), ("d", 0.7)], "model string, m double")
    assert [(r.model, r.best) for r in leaderboard(board, "m").collect()] == [("d", True), ("b", False), ("a", False), ("c", False)]
    assert leaderboard(board, "m", ascending=True).first().model == "b"
    assert leaderboard(board.where("model IN ('a', 'c')"), "m").where("best").count() == 0


def test_stream_equals_batch(spark, rows, tmp_path):
    fitted = M.model_pipeline(ROLES, "Churn", "lr", maxIter=5).fit(rows)
    fields = rows.drop("Churn")
    source, target, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    fields.repartition(3).write.parquet(source)

    def run():
        records = arriving_files(spark, source, fields.schema, 1)
        score_stream(fitted, records, ["id"], target, checkpoint).awaitTermination()
        return {r.id: (r.prediction_label, r.prob) for r in spark.read.parquet(target).collect()}

    batch = {r.id: (r.prediction_label, r.prob) for r in M.score(fitted, fields, ["id"]).collect()}
    assert run() == batch
    fields.limit(5).withColumn("id", F.col("id") + 10_000).write.mode("append").parquet(source)
    assert len(run()) == len(batch) + 5
    assert spark.read.parquet(target).count() == len(batch) + 5


def test_stream_sets_bad_records_aside(spark, rows, tmp_path, monkeypatch):
    """Good records are scored as in a batch; a batch that comes again adds nothing."""
    fields = rows.drop("Churn").withColumns(
        {
            "Contract": F.when(F.col("id") % 10 == 1, "decade").when(F.col("id") % 10 == 2, None).otherwise(F.col("Contract")),
            "tenure": F.when(F.col("id") % 10 == 2, None).otherwise(F.col("tenure")),
            "MonthlyCharges": F.when(F.col("id") % 10 == 3, float("nan")).when(F.col("id") % 10 == 4, float("-inf")).otherwise(F.col("MonthlyCharges")),
        }
    )
    source = str(tmp_path / "in")
    fields.repartition(3).write.parquet(source)
    good = fields.filter("id % 10 NOT IN (1, 2, 3, 4)")
    for listed in (10_000, 2):  # categories in the model, and in a table
        monkeypatch.setattr(X, "LISTED_VALUES", listed)
        fitted = M.model_pipeline(ROLES, "Churn", "dt").fit(rows)
        target, side, checkpoint = (str(tmp_path / f"{d}{listed}") for d in ("out", "side", "checkpoint"))

        def run():
            records = arriving_files(spark, source, fields.schema, 1)
            score_good_records(fitted, records, ROLES, ["id"], target, side, checkpoint).awaitTermination()
            return sorted((r.id, r.prediction_label, r.prob) for r in spark.read.parquet(target).collect())

        expected = sorted((r.id, r.prediction_label, r.prob) for r in M.score(fitted, good, ["id"]).collect())
        assert run() == expected and run() == expected
        unusable = spark.read.parquet(side)
        aside = unusable.count()
        assert aside == fields.count() - len(expected)
        said = {(r.id % 10, tuple(r.problems)) for r in unusable.collect()}
        assert said == {(1, ("Contract: not fitted",)), (2, ("tenure: no number", "Contract: not fitted")), (3, ("MonthlyCharges: no number",)), (4, ("MonthlyCharges: no number",))}
        commits = sorted(p for p in (tmp_path / f"checkpoint{listed}" / "commits").iterdir() if p.name.isdigit())
        assert [p.name for p in commits] == ["0", "1", "2"]
        for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # as if it had ended before its commit
            p.unlink(missing_ok=True)
        assert run() == expected and spark.read.parquet(side).count() == aside
    write = batch_writer(fitted, ROLES, ["id"], str(tmp_path / "none"), str(tmp_path / "aside"))
    write(fields.limit(0), 0)
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
    assert checked(fitted, good, ROLES).filter("size(problems) > 0").count() == 0


def _many(spark, n):
    return spark.range(n).select(
        F.col("id"), F.concat(F.lit("v"), F.col("id") % (n // 2)).alias("t"), ((F.col("id") * 7) % (n // 3) - 5).cast("double").alias("d"), F.lit("x").alias("few")
    )


def test_values_beyond_a_list_are_a_table(spark, monkeypatch, tmp_path):
    """A dictionary gives the places that a list gives, also after saving, and each treatment of other values."""
    df = _many(spark, 600)
    columns = {"inputCols": ["t", "few", "d"], "outputCols": ["a", "b", "c"]}
    listed = {r.id: (r.a, r.b, r.c) for r in X.ValueIndexer(**columns).fit(df).transform(df).collect()}
    monkeypatch.setattr(X, "LISTED_VALUES", 50)
    fitted = X.ValueIndexer(**columns).fit(df)
    assert [type(s).__name__ for s in fitted.stages] == ["StringIndexerModel", "ValueDictionaryModel"]
    assert {r.id: (r.a, r.b, r.c) for r in fitted.transform(df).collect()} == listed
    fitted.write().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert {r.id: (r.a, r.b, r.c) for r in again.transform(df).collect()} == listed
    other = df.limit(3).union(spark.createDataFrame([(900, "unknown", 1.0, "x"), (901, None, 1.0, "x")], df.schema))
    with pytest.raises(Exception, match="not fitted"):
        fitted.transform(other).collect()
    kept = X.ValueIndexer(**columns, handleInvalid="keep").fit(df).transform(other).filter("id >= 900").collect()
    assert [r.a for r in kept] == [300.0, 300.0]
    assert X.ValueIndexer(**columns, handleInvalid="skip").fit(df).transform(other).count() == 3


def test_many_values_without_a_driver_list(spark, monkeypatch):
    """A million values: nothing of the dictionary is collected, and it is joined by a shuffle."""
    import pyspark.sql.classic.dataframe as classic

    sizes, collect = [], classic.DataFrame.collect
    monkeypatch.setattr(classic.DataFrame, "collect", lambda df: sizes.append(len(out := collect(df))) or out)
    df = spark.range(1_000_000).select(F.concat(F.lit("v"), F.lpad("id", 7, "0")).alias("t"), "id")
    fitted = X.ValueIndexer(inputCols=["t"], outputCols=["place"]).fit(df)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "-1")  # the library itself asks for no broadcast of so many
        out = fitted.transform(df)
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.filter(F.col("place") == F.col("id")).count() == 1_000_000
    finally:
        spark.conf.set(limit, before)
    assert max(sizes, default=0) <= 1000


def _regression_rows(spark, n=400):
    chance = np.random.default_rng(9)
    x = 1e6 + chance.normal(size=(n, 3)) * [1.0, 50.0, 0.01]
    y = 3e5 + x @ [2.0, -0.5, 40.0] + chance.normal(size=n)
    frame = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "k": np.where(x[:, 1] - 1e6 + 20 * chance.normal(size=n) > 0, "p", "q")})
    frame.loc[3, "a"], frame.loc[5, "y"] = None, None
    return spark.createDataFrame(frame).replace(float("nan"), None).repartition(5)


@pytest.mark.parametrize("penalty", [0.0, 0.2])
def test_linear_folds_equal_refits(spark, penalty):
    from tabscope.operators.leave_out import assigned_folds, cross_validate_linear

    rows, names = _regression_rows(spark), ["a", "b", "c"]
    found = {(r.repeat, r.fold): r for r in cross_validate_linear(rows, "y", names, ["id"], 4, 3, penalty).collect()}
    complete = rows.dropna(subset=[*names, "y"]).withColumn("_all", F.lit(0))
    own = assigned_folds(complete, "_all", ["id"], [*names, "y"], 4, 3).toPandas()
    assert len(found) == 12 and sum(r.n for r in found.values()) == 3 * 398
    whole = own[["_0", "_1", "_2"]].to_numpy()
    z = (whole - whole.mean(0)) / whole.std(0)
    for (repeat, fold), r in found.items():
        train, y = (own[f"_fold_{repeat}"] != fold).to_numpy(), own["_3"].to_numpy()
        a = np.column_stack([np.ones(train.sum()), z[train]])
        penal = penalty * train.sum() * np.diag([0.0, 1, 1, 1])
        beta = np.linalg.solve(a.T @ a + penal, a.T @ y[train])
        error = y[~train] - np.column_stack([np.ones((~train).sum()), z[~train]]) @ beta
        assert r.mse == pytest.approx((error**2).mean(), rel=1e-6)
        assert r.r2 == pytest.approx(1 - (error**2).mean() / y[~train].var(), abs=1e-8)
        assert [r.slope_0, r.slope_1, r.slope_2] == pytest.approx(list(beta[1:] / whole.std(0)), rel=1e-6)


def test_linear_folds_equal_the_engines_refits(spark):
    from pyspark.ml.feature import VectorAssembler

    from tabscope.operators.leave_out import cross_validate_linear
    from tabscope.operators.splitting import stratified_folds

    rows = _regression_rows(spark).dropna().withColumns({c: F.col(c) - 1e6 for c in ("a", "b")})  # the engine's solver does not centre
    found = {r.fold: r for r in cross_validate_linear(rows, "y", ["a", "b"], ["id"], 3, 1).collect()}
    folded = stratified_folds(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).withColumn("_all", F.lit(0)), "_all", ["id"], 3)
    for fold in range(3):
        model = R.LinearRegression(labelCol="y", solver="normal").fit(folded.filter(F.col("fold") != fold))
        assert found[fold].rmse == pytest.approx(model.evaluate(folded.filter(F.col("fold") == fold)).rootMeanSquaredError, rel=1e-6)


def test_bayes_folds_equal_the_engines_refits(spark):
    from pyspark.ml.feature import VectorAssembler

    from tabscope.operators.leave_out import cross_validate_gaussian_bayes
    from tabscope.operators.splitting import stratified_folds

    rows = _regression_rows(spark).dropna().withColumn("b", F.col("b") - 1e6).withColumn("a", F.col("a") - 1e6)
    found = {(r.repeat, r.fold): r for r in cross_validate_gaussian_bayes(rows, "k", ["a", "b"], ["id"], 3, 2).collect()}
    points = X.label_encoder("k").fit(rows).transform(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows))
    for repeat in range(2):
        folded = stratified_folds(points, "k", ["id"], 3, repeat)
        for fold in range(3):
            model = C.NaiveBayes(modelType="gaussian").fit(folded.filter(F.col("fold") != fold))
            share = model.transform(folded.filter(F.col("fold") == fold)).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
            assert found[repeat, fold].accuracy == pytest.approx(share)
