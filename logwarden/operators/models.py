"""Four classifiers on log-line features, fitted and scored by Spark."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import BOOTSTRAP_LINES
from ..schemas import CLASSIFIERS
from ..session import scratch_folder, stage, use_checkpoints
from .features import add_features, fit_features
from .iforest import IsolationForest, fit_forest, from_table, score_samples
from .trees import SparseBoosting, SparseForest, TreeModel

ROUNDS = 100
SUPERVISED = {
    "random_forest": RandomForestClassificationModel,
    "logistic_regression": LogisticRegressionModel,
    "gradient_boosting": GBTClassificationModel,
}
DEFAULT_SCORE = 0.05
MIN_RETRAIN_LINES = 10
# The fits keep rows in memory that Parquet holds in a tenth of the space or less.
ROWS_PER_TASK = 250_000


@dataclass
class Models:
    features: PipelineModel
    fitted: dict[str, object]


def classifier_name(name: str) -> str:
    """Lower case with underscores; unknown names mean the isolation forest."""
    plain = name.lower().replace(" ", "_")
    return plain if plain in CLASSIFIERS else "isolation_forest"


def _width(features: PipelineModel) -> int:
    return len(features.stages[3].vocabulary)


def _supervised(name: str, n: int):
    if name == "random_forest":
        return SparseForest(trees=100, max_depth=10)
    if name == "logistic_regression":
        return LogisticRegression(
            maxIter=1000, regParam=1.0 / n, elasticNetParam=0.0, standardization=False
        )
    return SparseBoosting(rounds=ROUNDS, max_depth=3, step=0.1)


@dataclass
class TrainingSet:
    """Fitted features, and ``line_no, label, features`` written once for all classifiers."""

    features: PipelineModel
    rows: DataFrame


def training_set(lines: DataFrame, labelled: DataFrame) -> TrainingSet:
    """From ``value``, and the same lines as ``line_no, value, label``.

    The iterative fits re-read the written table, not the log.
    """
    features = fit_features(lines)
    rows = add_features(features, labelled).select("line_no", "label", "features")
    return TrainingSet(features, stage(rows, "features"))


def fit_classifier(training: TrainingSet, name: str):
    if name == "isolation_forest":
        return fit_forest(training.rows, _width(training.features))
    spark = training.rows.sparkSession
    use_checkpoints(spark)
    n = training.rows.count()
    fitted = _supervised(name, n).fit(_dealt(training.rows, n))
    if name != "logistic_regression":
        return fitted
    # Its copies keep the training summary, which holds the session: tasks cannot take that along.
    path = scratch_folder(spark, name)
    fitted.write().save(path)
    return SUPERVISED[name].load(path)


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows in so many partitions that none holds more than ``ROWS_PER_TASK`` on average."""
    wanted = -(-n // ROWS_PER_TASK)
    return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows


def fit_models(lines: DataFrame, labelled: DataFrame, names: list[str] | None = None) -> Models:
    """``names`` limits which classifiers are fitted."""
    training = training_set(lines, labelled)
    fitted = {name: fit_classifier(training, name) for name in names or CLASSIFIERS}
    return Models(training.features, fitted)


def bootstrap_lines(spark: SparkSession) -> DataFrame:
    lines = F.posexplode(F.array(*[F.lit(line) for line in BOOTSTRAP_LINES]))
    return spark.range(1).select(lines.alias("line_no", "value")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


def _result(flagged: Column, score: Column) -> Column:
    return F.struct(
        F.when(flagged, "Anomaly").otherwise("Normal").alias("prediction"), score.alias("score")
    )


def add_scores(
    models: Models | None, rows: DataFrame, text: str = "value", names: list[str] | None = None
) -> DataFrame:
    """Add ``scores``: prediction and score of each classifier, in one pass over the rows.

    Without models every classifier says Normal, 0.05.
    """
    names = CLASSIFIERS if names is None else names
    if models is None:
        default = _result(F.lit(False), F.lit(DEFAULT_SCORE))
        return rows.withColumn("scores", F.struct(*[default.alias(n) for n in names]))
    kept = rows.columns
    made = rows if text == "value" else rows.withColumn("value", F.col(text))
    made = add_features(models.features, made)
    results = []
    for name in names:
        model = models.fitted[name]
        column = f"_{name}"
        if isinstance(model, IsolationForest):
            made = score_samples(model, made, column)
            decision = F.col(column) - F.lit(model.offset)
            result = _result(decision < 0, 1.0 / (1.0 + F.exp(decision * 10)))
        elif isinstance(model, TreeModel):
            made = model.chance(made, column)
            result = _result(F.col(column) >= 0.5, F.col(column))
        else:
            model = model.copy()
            model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(column)
            made = model.transform(made)
            chance = F.coalesce(F.get(vector_to_array(column), F.lit(1)), F.lit(0.0))
            result = _result(chance >= 0.5, chance)
        results.append(result.alias(name))
    return made.withColumn("scores", F.struct(*results)).select(*kept, "scores")


def chosen(classifier: str) -> tuple[Column, Column]:
    """The chosen classifier's flag and score, from ``scores``."""
    result = F.col("scores")[classifier_name(classifier)]
    return result["prediction"] == "Anomaly", result["score"]


# --- storage -----------------------------------------------------------------------------------
def save_models(models: Models, spark: SparkSession, path: str) -> None:
    """Write a new version, then point to it: readers never see half of a new model."""
    version = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/{version}"
    models.features.write().save(f"{folder}/features")
    described = []
    for name, model in models.fitted.items():
        offset, sample_rows, trees = None, None, isinstance(model, TreeModel)
        if isinstance(model, IsolationForest):
            model.table(spark).write.parquet(f"{folder}/{name}")
            offset, sample_rows = model.offset, model.sample_rows
        elif trees:
            model.table(spark).write.parquet(f"{folder}/{name}")
        else:
            model.write().save(f"{folder}/{name}")
        described.append((version, name, offset, sample_rows, trees, model.scale if trees else None))
    schema = (
        "version string, name string, forest_offset double, sample_rows int, trees boolean, scale double"
    )
    pointer = spark.createDataFrame(described, schema).coalesce(1)
    pointer.write.mode("overwrite").parquet(f"{path.rstrip('/')}/current")


def load_models(spark: SparkSession, path: str) -> Models:
    """The current version; a missing path raises AnalysisException."""
    described = spark.read.parquet(f"{path.rstrip('/')}/current").collect()
    folder = f"{path.rstrip('/')}/{described[0]['version']}"
    features = PipelineModel.load(f"{folder}/features")
    fitted = {}
    for row in described:
        name = row["name"]
        if name == "isolation_forest":
            nodes = spark.read.parquet(f"{folder}/{name}").toPandas()
            fitted[name] = from_table(
                nodes, _width(features), row["sample_rows"], row["forest_offset"]
            )
        elif row.asDict().get("trees"):  # models stored before were Spark's own
            nodes = spark.read.parquet(f"{folder}/{name}").toPandas()
            forest = from_table(nodes, _width(features), 0, 0.0)
            fitted[name] = TreeModel(forest.nodes, forest.width, row["scale"])
        else:
            fitted[name] = SUPERVISED[name].load(f"{folder}/{name}")
    return Models(features, fitted)


def has_models(spark: SparkSession, path: str) -> bool:
    try:
        return set(CLASSIFIERS) <= set(load_names(spark, path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def load_names(spark: SparkSession, path: str) -> list[str]:
    return [r["name"] for r in spark.read.parquet(f"{path.rstrip('/')}/current").collect()]
