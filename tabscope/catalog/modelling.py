"""Queries over feature stages, model training, comparison and scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from tabscope.catalog.inputs import derived, position_sql, sql_of
from tabscope.functions.hashing import POSITION_BITS
from tabscope.operators import features as X, models as M
from tabscope.operators.cleaning import Roles
from tabscope.operators.compare import compare_classifiers, compare_regressors, set_up
from tabscope.operators.leave_out import cross_validate_gaussian_bayes, cross_validate_linear
from tabscope.operators.splitting import train_test_split
from tabscope.plans.churn_report import NUMERIC, churn_report, prepare
from tabscope.streaming.scoring import arriving_files, batch_writer, score_good_records, score_stream
from tabscope.workspace import materialize, new_path

KEY = ["c_custkey"]
CATEGORIES = ["Segment", "Region", "UrgentBuyer"]
ROLES = Roles(numeric=NUMERIC, categorical=CATEGORIES, passthrough=[])


def _rows(spark, sf_dir):
    """Cleaned churn rows with their split; stored, as every model reads them many times."""
    rows, _ = prepare(derived(spark, sf_dir, "churn"), "Churn", KEY)
    return materialize(train_test_split(rows, KEY), "churn")


def _train(rows):
    return rows.filter(F.col("split") == "train")


def standard_scaling(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    outputs = [f"{c}_scaled" for c in NUMERIC]
    fitted = X.PopulationScaler(inputCols=NUMERIC, outputCols=outputs).fit(_train(rows))
    return fitted.transform(rows).select("c_custkey", *[F.round(c, 6).alias(c) for c in outputs])


def _encoded(rows, roles):
    return X.feature_pipeline(roles).fit(_train(rows)).transform(rows).withColumn("values", vector_to_array("features"))


def one_hot_encoding(spark, sf_dir):
    """Width of the encoded categories, their sum, and the positions that are set as a sum of powers."""
    rows = _rows(spark, sf_dir)
    encoded = _encoded(rows, Roles([], CATEGORIES, []))
    powers = F.transform("values", lambda v, i: v * F.pow(F.lit(2.0), i.cast("double")))
    return encoded.select(
        "c_custkey",
        F.size("values").alias("width"),
        F.aggregate(powers, F.lit(0.0), lambda a, v: a + v).alias("positions"),
        F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("total"),
    )


def label_encoding(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    encoder = X.label_encoder("Churn").fit(_train(rows))
    decoded = X.label_decoder(encoder, "label", "decoded").transform(encoder.transform(rows))
    return decoded.select("c_custkey", F.col("label").cast("int").alias("label"), "decoded")


def column_transformer(spark, sf_dir):
    """Scaled numbers, then one-hot categories, then the untouched key, checked by position."""
    rows = _rows(spark, sf_dir)
    encoded = _encoded(rows, Roles(NUMERIC, CATEGORIES, ["c_custkey"]))
    weighted = F.transform("values", lambda v, i: v * (i + 1))
    return encoded.select(
        "c_custkey",
        F.size("values").alias("width"),
        F.round(F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v), 4).alias("checksum"),
    )


def _scored_by(key, **params):
    def query(spark, sf_dir):
        rows = _rows(spark, sf_dir)
        fitted = M.model_pipeline(ROLES, "Churn", key, **params).fit(_train(rows))
        return M.score(fitted, rows.drop("Churn"), ["c_custkey"], "churn")

    query.__name__ = f"score_{key}"
    return query


def stream_scoring(spark, sf_dir):
    """The same rows arriving as files."""
    rows = _rows(spark, sf_dir)
    fitted = M.model_pipeline(ROLES, "Churn", "lr").fit(_train(rows))
    arriving = new_path(spark, "arriving")
    rows.drop("Churn").repartition(4, "c_custkey").write.parquet(arriving)
    records = arriving_files(spark, arriving, rows.drop("Churn").schema, files_per_batch=2)
    target = new_path(spark, "scored")
    score_stream(fitted, records, ["c_custkey"], target, new_path(spark, "stream")).awaitTermination()
    return spark.read.parquet(target)


def stream_matches_batch(spark, sf_dir):
    """Rows scored, and rows whose streamed result differs from the batch result."""
    batch = QUERIES["score_lr"](spark, sf_dir).withColumnsRenamed({"prob": "batch_prob", "churn": "batch_churn"})
    streamed = stream_scoring(spark, sf_dir)
    both = batch.join(streamed, "c_custkey", "full")
    same = F.col("prediction_label").eqNullSafe(F.col("batch_churn")) & F.col("prob").eqNullSafe(F.col("batch_prob"))
    return both.agg(F.count("*").alias("scored"), F.count_if(~same).alias("different"))


def stream_with_bad_records(spark, sf_dir):
    """Records per kind of problem, and those scored, of a stream whose second batch was written twice."""
    rows = _rows(spark, sf_dir)
    fitted = M.model_pipeline(ROLES, "Churn", "dt").fit(_train(rows))
    fields = rows.drop("Churn").withColumns(
        {
            "Segment": F.when(F.col("c_custkey") % 10 == 3, "SPACE").when(F.col("c_custkey") % 10 == 4, None).otherwise(F.col("Segment")),
            "TotalCharges": F.when(F.col("c_custkey") % 15 == 3, float("nan")).when(F.col("c_custkey") % 15 == 5, None).otherwise(F.col("TotalCharges")),
            "MonthlyCharges": F.when(F.col("c_custkey") % 11 == 3, float("inf")).otherwise(F.col("MonthlyCharges")),
        }
    )
    arriving, target, side, checkpoint = (new_path(spark, name) for name in ("arriving", "scored", "unusable", "stream"))
    fields.repartition(4, "c_custkey").write.parquet(arriving)
    records = arriving_files(spark, arriving, fields.schema, files_per_batch=2)
    score_good_records(fitted, records, ROLES, KEY, target, side, checkpoint).awaitTermination()
    # the second batch again, as after a failure before its commit
    seen = spark.read.parquet(target).filter("batch = 1").select("c_custkey").unionByName(spark.read.parquet(side).filter("batch = 1").select("c_custkey"))
    again = fields.join(materialize(seen, "seen"), "c_custkey", "left_semi")
    batch_writer(fitted, ROLES, KEY, target, side)(again, 1)
    unusable = spark.read.parquet(side).select("c_custkey", F.array_join("problems", "; ").alias("problems"))
    scored = spark.read.parquet(target).select("c_custkey", F.lit("").alias("problems"))
    return scored.unionByName(unusable).groupBy("problems").agg(F.count("*").alias("records"), F.sum("c_custkey").alias("keys"))


def cross_validation(spark, sf_dir):
    """Six folds, ten repeats, of logistic regression."""
    rows = _rows(spark, sf_dir)
    return M.cross_validate(rows, M.model_pipeline(ROLES, "Churn", "lr", unseen="keep"), "Churn", KEY)


def model_parameters(spark, sf_dir):
    """First five parameters of a fitted tree model."""
    rows = _rows(spark, sf_dir)
    fitted = M.model_pipeline(ROLES, "Churn", "dt").fit(_train(rows))
    return spark.createDataFrame(M.first_parameters(fitted.stages[-1]), "name string, value string")


def churn_evaluation(spark, sf_dir):
    """The whole train-and-evaluate run of a decision tree, as a flat row."""
    report = churn_report(derived(spark, sf_dir, "churn"), "dt", KEY)
    return report.row.select(
        "model_name",
        "training_result.accuracy",
        F.col("testing_result.accuracy").alias("testing_accuracy"),
        F.col("testing_result.roc_score").alias("testing_roc_score"),
        "cross_validation",
        F.size("model_params").alias("parameters"),
    )


def _experiment(spark, sf_dir):
    churn = derived(spark, sf_dir, "churn")
    number = F.col("TotalCharges").try_cast("double")
    return churn.withColumn("TotalCharges", number)


def experiment_setup(spark, sf_dir):
    """Rows after type detection, split, and all stages: imputation, scaling and one-hot encoding, checked by position."""
    experiment = set_up(_experiment(spark, sf_dir), "Churn", KEY)
    rows = Pipeline(stages=experiment.stages).fit(experiment.train).transform(experiment.rows)
    weighted = F.transform(vector_to_array("features"), lambda v, i: v * (i + 1))
    return rows.select(
        "c_custkey",
        "split",
        "Segment",
        F.round("TotalCharges", 4).alias("TotalCharges"),
        F.size(weighted).alias("width"),
        F.round(F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v), 4).alias("checksum"),
    )


def classifier_comparison(spark, sf_dir):
    experiment = set_up(_experiment(spark, sf_dir), "Churn", KEY)
    return compare_classifiers(experiment)


def regressor_comparison(spark, sf_dir):
    """Monthly charges from the other columns; the total is left out, as it tells the answer."""
    rows = _experiment(spark, sf_dir).drop("TotalCharges")
    experiment = set_up(rows, "MonthlyCharges", KEY)
    return compare_regressors(experiment)


def logistic_mean_probability(spark, sf_dir):
    """Without a penalty the mean probability on the training rows is the class rate."""
    train = _train(_rows(spark, sf_dir))
    fitted = M.model_pipeline(ROLES, "Churn", "lr", maxIter=500, tol=1e-10).fit(train)
    return M.predictions(fitted, train, []).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_probability"))


#: One round of each kind of model on features whose every cut the trees try; two of adaptive boosting.
STUMP_ROLES = Roles(numeric=["tenure"], categorical=CATEGORIES, passthrough=[])
STUMPS = {
    "dt": ("dt", {"maxDepth": 1}),
    "rf": ("rf", {"maxDepth": 1, "numTrees": 1, "featureSubsetStrategy": "all", "bootstrap": False}),
    "gb": ("gb", {"maxDepth": 1, "maxIter": 1}),
    "xgb": ("xgb", {"maxDepth": 1, "maxIter": 1}),
    "ada": ("ada", {"maxIter": 2}),
}
SPENDING = """CASE WHEN MonthlyCharges < 220000 THEN 'low' WHEN MonthlyCharges > 250000 AND tenure > 62 THEN 'high' ELSE 'middle' END"""


def _stumps(rows, target):
    """``model, c_custkey, predicted, prob`` of every kind of model, as ``models.score`` gives them."""
    parts = []
    for name, (key, params) in STUMPS.items():
        pipeline = M.model_pipeline(STUMP_ROLES, target, key, unseen="keep", **params)
        made = pipeline.getStages()[-1]
        for tree in [getattr(made, "inner", made)]:
            if tree.hasParam("maxBins"):
                tree.set(tree.maxBins, 128)
        fitted = pipeline.fit(_train(rows))
        parts.append(M.score(fitted, rows.drop(target), ["c_custkey"], "predicted").withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def stumps_of_two_classes(spark, sf_dir):
    """Churn by one round of each kind of model."""
    return _stumps(_rows(spark, sf_dir), "Churn")


def stumps_of_three_classes(spark, sf_dir):
    """Spending in three classes by one round of each kind of model; boosting has a vote or a model per class."""
    return _stumps(_rows(spark, sf_dir).withColumn("Spending", F.expr(SPENDING)), "Spending")


def majority_folds(spark, sf_dir):
    """Cross-validated accuracy of a tree without a cut: the share of the majority, on sixty folds."""
    estimator = M.model_pipeline(STUMP_ROLES, "Churn", "dt", unseen="keep", maxDepth=0)
    board = M.cross_validate(_rows(spark, sf_dir), estimator, "Churn", KEY)
    return board.withColumn("accuracy", F.round("accuracy", 9))


def linear_folds(spark, sf_dir):
    """Least squares on sixty folds from the sums of one scan."""
    board = cross_validate_linear(_rows(spark, sf_dir), "TotalCharges", ["tenure"], KEY)
    shown = {"intercept": 1, "slope_0": 2, "rmse": 1, "r2": 6}
    return board.select("repeat", "fold", F.col("n").cast("bigint").alias("n"), *[F.round(c, d).alias(c) for c, d in shown.items()])


def gaussian_bayes_folds(spark, sf_dir):
    """Gaussian naive Bayes on sixty stratified folds, fitted from the sums of one scan."""
    board = cross_validate_gaussian_bayes(_rows(spark, sf_dir), "Churn", NUMERIC, KEY)
    return board.select("repeat", "fold", F.col("n").cast("bigint").alias("n"), F.round("accuracy", 9).alias("accuracy"))


def naive_bayes_means(spark, sf_dir):
    """The class means that Gaussian naive Bayes is made of."""
    train = X.label_encoder("Churn").fit(_train(_rows(spark, sf_dir))).transform(_train(_rows(spark, sf_dir)))
    points = VectorAssembler(inputCols=NUMERIC, outputCol="features").transform(train)
    theta = NaiveBayes(modelType="gaussian").fit(points).theta.toArray()
    lines = [(k, name, float(theta[k][i])) for k in range(len(theta)) for i, name in enumerate(NUMERIC)]
    means = spark.createDataFrame(lines, "label int, feature string, mean double")
    return means.withColumn("mean", F.round("mean", 4))


def regression_line(spark, sf_dir):
    """Least squares on one feature."""
    points = VectorAssembler(inputCols=["tenure"], outputCol="features").transform(_rows(spark, sf_dir))
    fitted = LinearRegression(solver="normal", labelCol="TotalCharges").fit(points)
    line = spark.createDataFrame([(float(fitted.coefficients[0]), float(fitted.intercept))], "slope double, intercept double")
    return line.select(*[F.round(c, 3).alias(c) for c in line.columns])


QUERIES = {
    f.__name__: f
    for f in [
        standard_scaling, one_hot_encoding, label_encoding, column_transformer,
        *[_scored_by(k) for k in ("lr", "dt")],
        *[_scored_by(k) for k in ("rf", "gb", "xgb", "ada")], logistic_mean_probability, linear_folds,
        stumps_of_two_classes, stumps_of_three_classes, majority_folds, gaussian_bayes_folds,
        naive_bayes_means, regression_line,
        stream_scoring, stream_matches_batch, stream_with_bad_records, cross_validation, model_parameters, churn_evaluation,
        experiment_setup, classifier_comparison, regressor_comparison,
    ]
}

_CUT = int(0.3 * (1 << POSITION_BITS))
_ROWS = f"""raw AS ({sql_of('churn')}),
r AS (
  SELECT * REPLACE (TRY_CAST(TotalCharges AS DOUBLE) AS TotalCharges),
    CASE WHEN {position_sql('40', 'c_custkey')} < {_CUT} THEN 'test' ELSE 'train' END AS split
  FROM raw WHERE tenure <> 0 AND TRY_CAST(TotalCharges AS DOUBLE) IS NOT NULL)"""
_MOMENTS = ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in NUMERIC)
_FITTED = f"{_ROWS}, k AS (SELECT {_MOMENTS} FROM r WHERE split = 'train')"
_Z = {c: f"({c} - m_{c}) / s_{c}" for c in NUMERIC}


def _folds_sql(stratum: str, repeats: int = 10, folds: int = 6) -> str:
    """``c_custkey, repeat, fold`` of the cleaned rows, as ``splitting.stratified_folds`` deals them."""
    placed = " UNION ALL ".join(
        f"SELECT c_custkey, {r} AS repeat, {stratum} AS stratum, {position_sql(f'cv:{r}', 'c_custkey')} AS place FROM r" for r in range(repeats)
    )
    window = "PARTITION BY repeat, stratum"
    return f"""SELECT c_custkey, repeat, CAST(((ROW_NUMBER() OVER ({window} ORDER BY place) - 1) * {folds}) // COUNT(*) OVER ({window}) AS INTEGER) AS fold FROM ({placed})"""


_EXPERIMENT = ["UrgentBuyer", "tenure", "MonthlyCharges", "TotalCharges"]
_EXPERIMENT_MOMENTS = ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in _EXPERIMENT)
_EXPERIMENT_SUM = " + ".join(f"{i} * (({c} - m_{c}) / s_{c})" for i, c in enumerate(_EXPERIMENT, 1))
#: Places of the fitted categories, from 1, and how many each column has.
_PLACES = ", ".join(
    f"""{p}s AS (SELECT {c} AS {p}v, ROW_NUMBER() OVER (ORDER BY {c}) AS {p}, COUNT(*) OVER () AS {p}w
  FROM (SELECT DISTINCT {c} FROM r WHERE split = 'train'))"""
    for p, c in zip("sru", CATEGORIES)
)
_PLACED = " ".join(f"JOIN {p}s ON {p}v = x.{c}" for p, c in zip("sru", CATEGORIES))



def _stumps_sql(target: str, classes: list[str], rounds: int = 2) -> str:
    """Every model of ``STUMPS`` by Gini impurity over all cuts, in SQL."""
    n = len(classes)
    number = "CASE k " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(classes)) + " END"
    names = ", ".join(f"'{c}'" for c in classes)
    values = " UNION ALL ".join(
        f"SELECT {i} AS f, {c if t else 0} AS t, {chr(39) * 2 if t else c} AS s FROM (SELECT DISTINCT {c} FROM r WHERE split = 'train')"
        for i, (c, t) in enumerate([("tenure", True), ("Segment", False), ("Region", False), ("UrgentBuyer", True)])
    )
    steps = [
        f"""x AS (SELECT *, {number} AS y FROM (SELECT *, {target} AS k FROM r)), vals AS ({values}),
cand AS (SELECT c_custkey, split, y, f, t, s,
  CASE f WHEN 0 THEN tenure <= t WHEN 1 THEN Segment <> s WHEN 2 THEN Region <> s ELSE UrgentBuyer <> t END AS lo FROM x CROSS JOIN vals),
w0 AS (SELECT c_custkey, CAST(1 AS DOUBLE) AS w FROM x WHERE split = 'train')"""
    ]
    for i in range(rounds):
        steps.append(
            f"""side{i} AS (SELECT f, t, s, lo, y, SUM(w) AS w FROM cand JOIN w{i} USING (c_custkey) GROUP BY ALL),
best{i} AS (SELECT f, t, s FROM (SELECT f, t, s, lo, SUM(w * w) / SUM(w) AS pure FROM side{i} GROUP BY ALL)
  GROUP BY f, t, s HAVING COUNT(*) = 2 ORDER BY ROUND(SUM(pure), 9) DESC, f, t, s LIMIT 1),
leaf{i} AS (SELECT lo, y, w, SUM(w) OVER (PARTITION BY lo) AS n, ROW_NUMBER() OVER (PARTITION BY lo ORDER BY w DESC, y) AS place
  FROM side{i} JOIN best{i} USING (f, t, s)),
hit{i} AS (SELECT c.c_custkey, c.split, c.y AS truth, l.y AS pred, l.w / l.n AS p
  FROM cand AS c JOIN best{i} USING (f, t, s) JOIN leaf{i} AS l ON l.lo = c.lo AND l.place = 1),
vote{i} AS (SELECT total, CASE WHEN e >= 1 - 1.0 / {n} THEN {1 if i == 0 else 0} ELSE LN((1 - e) / e) + LN({n - 1}) END AS v
  FROM (SELECT SUM(w) AS total, SUM(CASE WHEN pred <> truth THEN w ELSE 0 END) / SUM(w) AS e FROM hit{i} JOIN w{i} USING (c_custkey))),
w{i + 1} AS (SELECT c_custkey, w / total * EXP(CASE WHEN pred <> truth THEN v ELSE 0 END) AS w FROM w{i} JOIN hit{i} USING (c_custkey), vote{i})"""
        )
    cast = " + ".join(f"vote{i}.v * CASE WHEN hit{i}.pred = y THEN 1 ELSE -1.0 / {n - 1} END" for i in range(rounds))
    joined = " ".join(f"JOIN hit{i} USING (c_custkey)" for i in range(1, rounds))
    steps.append(
        f"""classes AS (SELECT UNNEST(range({n})) AS y),
pruned AS (SELECT COUNT(DISTINCT y) = 1 AS same FROM leaf0 WHERE place = 1),
share AS (SELECT y, w / SUM(w) OVER () AS p FROM (SELECT y, COUNT(*) AS w FROM x WHERE split = 'train' GROUP BY y)),
tree AS (SELECT c_custkey, pred, CASE WHEN same THEN share.p ELSE hit0.p END AS p FROM hit0, pruned LEFT JOIN share ON share.y = hit0.pred),
own AS (SELECT classes.y, f, t, s, lo, COUNT(*) AS n, COUNT(*) FILTER (WHERE cand.y = classes.y) AS k
  FROM cand, classes WHERE split = 'train' GROUP BY ALL),
cuts AS (SELECT y, f, t, s FROM (
  SELECT y, f, t, s, ROW_NUMBER() OVER (PARTITION BY y ORDER BY ROUND(SUM((k * k + (n - k) * (n - k)) / n), 9) DESC, f, t, s) AS place
  FROM own GROUP BY y, f, t, s HAVING COUNT(*) = 2) WHERE place = 1),
boosted AS (SELECT c.c_custkey, own.y, 1 / (1 + EXP(-2 * (2.0 * k / n - 1))) AS p
  FROM cuts JOIN own USING (y, f, t, s) JOIN cand AS c ON c.f = own.f AND c.t = own.t AND c.s = own.s AND c.lo = own.lo),
voted AS (SELECT c_custkey, classes.y, EXP(({cast}) / ({' + '.join(f'vote{i}.v' for i in range(rounds))}) / {max(2, n - 1)}) AS p
  FROM hit0 {joined}, classes, {', '.join(f'vote{i}' for i in range(rounds))}),
shares AS (
  SELECT model, c_custkey, y AS pred, p / SUM(p) OVER (PARTITION BY model, c_custkey) AS p,
    ROW_NUMBER() OVER (PARTITION BY model, c_custkey ORDER BY ROUND(p, 12) DESC, y) AS place
  FROM (SELECT UNNEST(['gb', 'xgb']) AS model, * FROM boosted UNION ALL SELECT 'ada', * FROM voted))"""
    )
    return f"""WITH {_ROWS}, {', '.join(steps)}
SELECT model, c_custkey, [{names}][pred + 1] AS predicted, ROUND_EVEN(p * 100, 2) AS prob
FROM (SELECT UNNEST(['dt', 'rf']) AS model, * FROM tree UNION ALL SELECT model, c_custkey, pred, p FROM shares WHERE place = 1)"""


ORACLES = {
    "stumps_of_two_classes": _stumps_sql("Churn", ["No", "Yes"]),
    "stumps_of_three_classes": _stumps_sql(SPENDING, ["high", "low", "middle"]),
    "majority_folds": f"""WITH {_ROWS}, a AS (SELECT repeat, fold, Churn FROM ({_folds_sql("Churn")}) JOIN r USING (c_custkey)),
h AS (SELECT UNNEST(range(6)) AS own),
m AS (SELECT repeat, own, Churn FROM (SELECT repeat, own, Churn, ROW_NUMBER() OVER (PARTITION BY repeat, own ORDER BY COUNT(*) DESC, Churn) AS place
  FROM a JOIN h ON fold <> own GROUP BY repeat, own, Churn) WHERE place = 1)
SELECT a.repeat, fold, ROUND(AVG(CASE WHEN a.Churn = m.Churn THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM a JOIN m ON m.repeat = a.repeat AND m.own = a.fold GROUP BY a.repeat, fold""",
    "standard_scaling": f"WITH {_FITTED} SELECT c_custkey, "
    + ", ".join(f"ROUND({z}, 6) AS {c}_scaled" for c, z in _Z.items())
    + " FROM r, k",
    "one_hot_encoding": f"""WITH {_ROWS}, {_PLACES}
SELECT c_custkey, CAST(sw + rw + uw AS INTEGER) AS width, CAST(POWER(2, s - 1) + POWER(2, sw + r - 1) + POWER(2, sw + rw + u - 1) AS DOUBLE) AS positions,
  CAST(3 AS DOUBLE) AS total FROM r AS x {_PLACED}""",
    "label_encoding": f"""WITH {_ROWS}, l AS (SELECT Churn, ROW_NUMBER() OVER (ORDER BY Churn) - 1 AS label FROM (SELECT DISTINCT Churn FROM r WHERE split = 'train'))
SELECT c_custkey, CAST(label AS INTEGER) AS label, Churn AS decoded FROM r JOIN l USING (Churn)""",
    "column_transformer": f"""WITH {_FITTED}, {_PLACES}
SELECT c_custkey, CAST(3 + sw + rw + uw + 1 AS INTEGER) AS width,
  ROUND({_Z['tenure']} + 2 * ({_Z['MonthlyCharges']}) + 3 * ({_Z['TotalCharges']}) + (3 + s) + (3 + sw + r) + (3 + sw + rw + u)
    + (3 + sw + rw + uw + 1) * c_custkey, 4) AS checksum
FROM r AS x CROSS JOIN k {_PLACED}""",
    "logistic_mean_probability": f"""WITH {_ROWS} SELECT COUNT(*) AS n,
  ROUND(CAST(COUNT(*) FILTER (WHERE Churn = 'Yes') AS DOUBLE) / COUNT(*), 4) AS mean_probability FROM r WHERE split = 'train'""",
    "linear_folds": f"""WITH {_ROWS}, a AS (SELECT repeat, fold, tenure AS x, TotalCharges AS y FROM ({_folds_sql("'0'")}) JOIN r USING (c_custkey)),
f AS (
  SELECT t.repeat, h.fold, regr_slope(t.y, t.x) AS slope, regr_intercept(t.y, t.x) AS intercept
  FROM a AS t JOIN (SELECT UNNEST(range(6)) AS fold) AS h ON t.fold <> h.fold GROUP BY t.repeat, h.fold)
SELECT repeat, CAST(fold AS INTEGER) AS fold, COUNT(*) AS n, ROUND(ANY_VALUE(intercept), 1) AS intercept, ROUND(ANY_VALUE(slope), 2) AS slope_0,
  ROUND(SQRT(AVG((y - intercept - slope * x) ** 2)), 1) AS rmse, ROUND(1 - AVG((y - intercept - slope * x) ** 2) / VAR_POP(y), 6) AS r2
FROM a JOIN f USING (repeat, fold) GROUP BY repeat, fold""",
    "gaussian_bayes_folds": f"""WITH {_ROWS}, a AS (
  SELECT c_custkey, repeat, fold, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS k, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in NUMERIC)}
  FROM ({_folds_sql('Churn')}) JOIN r USING (c_custkey)),
d AS (SELECT {', '.join(f'STDDEV_POP({c}) AS s_{c}' for c in NUMERIC)} FROM r),
h AS (SELECT UNNEST(range(6)) AS own),
e AS (SELECT repeat, own, 1e-9 * MAX(v) AS eps FROM (
  {' UNION ALL '.join(f"SELECT repeat, own, VAR_POP({c} / d.s_{c}) AS v FROM a JOIN h ON fold <> own, d GROUP BY repeat, own" for c in NUMERIC)}) GROUP BY repeat, own),
m AS (
  SELECT repeat, own, k, COUNT(*) AS c, SUM(COUNT(*)) OVER (PARTITION BY repeat, own) AS total,
    {', '.join(f'AVG({c}) AS m_{c}, VAR_POP({c} / d.s_{c}) AS v_{c}' for c in NUMERIC)}
  FROM a JOIN h ON fold <> own, d GROUP BY repeat, own, k),
o AS (
  SELECT a.repeat, a.fold, a.k AS truth, m.k, a.c_custkey, LN(c / total)
    - {' - '.join(f'0.5 * (LN(v_{c} + eps) + ((a.{c} - m_{c}) / d.s_{c}) ** 2 / (v_{c} + eps))' for c in NUMERIC)} AS odds
  FROM a JOIN m ON m.repeat = a.repeat AND m.own = a.fold JOIN e ON e.repeat = a.repeat AND e.own = a.fold, d)
SELECT repeat, CAST(fold AS INTEGER) AS fold, COUNT(*) AS n, ROUND(AVG(CASE WHEN k = truth THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY repeat, c_custkey ORDER BY odds DESC, k) AS place FROM o) WHERE place = 1 GROUP BY repeat, fold""",
    "naive_bayes_means": f"WITH {_ROWS} "
    + " UNION ALL ".join(
        f"SELECT CAST(CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS label, '{c}' AS feature, ROUND(AVG({c}), 4) AS mean FROM r WHERE split = 'train' GROUP BY Churn"
        for c in NUMERIC
    ),
    "regression_line": f"WITH {_ROWS} SELECT ROUND(regr_slope(TotalCharges, tenure), 3) AS slope, ROUND(regr_intercept(TotalCharges, tenure), 3) AS intercept FROM r",
    "stream_matches_batch": f"WITH {_ROWS} SELECT COUNT(*) AS scored, CAST(0 AS BIGINT) AS different FROM r",
    "stream_with_bad_records": f"""WITH {_ROWS} SELECT problems, COUNT(*) AS records, CAST(SUM(c_custkey) AS BIGINT) AS keys FROM (
  SELECT c_custkey, CONCAT_WS('; ', CASE WHEN c_custkey % 11 = 3 THEN 'MonthlyCharges: no number' END,
    CASE WHEN c_custkey % 15 IN (3, 5) THEN 'TotalCharges: no number' END, CASE WHEN c_custkey % 10 IN (3, 4) THEN 'Segment: not fitted' END) AS problems FROM r)
GROUP BY problems""",
    "experiment_setup": f"""WITH raw AS ({sql_of('churn')}),
i AS (SELECT *, TRY_CAST(TotalCharges AS DOUBLE) AS t, CASE WHEN {position_sql('40', 'c_custkey')} < {_CUT} THEN 'test' ELSE 'train' END AS split FROM raw),
r AS (SELECT c_custkey, split, Segment, Region, UrgentBuyer, tenure, MonthlyCharges, COALESCE(t, (SELECT AVG(t) FROM i WHERE split = 'train')) AS TotalCharges FROM i),
k AS (SELECT {_EXPERIMENT_MOMENTS} FROM r WHERE split = 'train'),
{_PLACES}
SELECT c_custkey, split, Segment, ROUND(TotalCharges, 4) AS TotalCharges, CAST({len(_EXPERIMENT)} + sw + 1 + rw + 1 AS INTEGER) AS width,
  ROUND({_EXPERIMENT_SUM} + ({len(_EXPERIMENT)} + s) + ({len(_EXPERIMENT)} + sw + 1 + r), 4) AS checksum
FROM r AS x CROSS JOIN k JOIN ss ON sv = x.Segment JOIN rs ON rv = x.Region""",
}
