"""Tree ensembles as Spark ML pipelines: build, fit, predict, importance, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from stopwise.config import FEATURES, TARGET, LearnerParams
from stopwise.operators.level_trees import BoostedTrees
from stopwise.session import shared_dir

# Model types a configuration may name, and the learner that serves them.
MODEL_TYPES = {"gbt": "gbt", "lightgbm": "gbt", "xgboost": "gbt", "random_forest": "random_forest"}

# Stands for an unknown order time: MLlib's trees take no nulls.
UNKNOWN_TIME = -1.0
TIME_FEATURES = ["order_hour", "order_day_of_week", "order_month"]


def numeric_features(df: DataFrame, names: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Feature columns as doubles; an absent column is 0, an unknown time the sentinel."""
    columns = {}
    for name in names:
        value = F.col(name).cast("double") if name in df.columns else F.lit(0.0)
        columns[name] = F.coalesce(value, F.lit(UNKNOWN_TIME)) if name in TIME_FEATURES else value
    return df.withColumns(columns)


def create_model(model_type: str = "gbt", params: LearnerParams = LearnerParams(), names: Sequence[str] = tuple(FEATURES)) -> Pipeline:
    learner = MODEL_TYPES.get(model_type)
    if learner is None:
        raise ValueError(f"unknown model type: {model_type}; use one of {sorted(MODEL_TYPES)}")
    shared = dict(
        featuresCol="features",
        labelCol=TARGET,
        predictionCol="predicted",
        maxDepth=params.depth,
        minInstancesPerNode=params.min_rows_per_leaf,
        subsamplingRate=params.row_share,
        featureSubsetStrategy=params.column_share,
        seed=params.seed,
    )
    if learner == "gbt":
        estimator = BoostedTrees(maxIter=params.trees, stepSize=params.learning_rate, checkpointInterval=10, **shared)
    else:
        estimator = RandomForestRegressor(numTrees=params.trees, **shared)
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="features"), estimator])


def assembled(df: DataFrame, assembler: VectorAssembler) -> DataFrame:
    """What a learner reads: the feature vector and the target."""
    return assembler.transform(numeric_features(df, assembler.getInputCols())).select(assembler.getOutputCol(), TARGET)


def _checkpointed(df: DataFrame) -> DataFrame:
    """The rows, in a session that has a checkpoint folder; or the lineage grows with every tree."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df


def fit(df: DataFrame, pipeline: Pipeline) -> PipelineModel:
    """MLlib reads its input several times before its own binned copy is complete, so the vectors are
    made once, kept in the executors for the fit (spilling to disk) and released after it. Boosted trees
    read it twice and keep blocks of codes, which are a fraction of it."""
    assembler, learner = pipeline.getStages()
    ready = assembled(_checkpointed(df), assembler)
    if isinstance(learner, BoostedTrees):
        return PipelineModel([assembler, learner.fit(ready)])
    ready.persist()
    try:
        return PipelineModel([assembler, learner.fit(ready)])
    finally:
        ready.unpersist()


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    used = model.stages[0].getInputCols()
    return model.transform(numeric_features(df, used)).drop("features")


def feature_importance(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Features with their normalised gain, strongest first; one row per feature."""
    names = model.stages[0].getInputCols()
    scores = model.stages[-1].featureImportances
    rows = [(name, float(scores[i])) for i, name in enumerate(names)]
    listed = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return listed.orderBy(F.desc("importance"), "feature")


def cross_validate(
    df: DataFrame,
    model_type: str = "gbt",
    params: LearnerParams = LearnerParams(),
    depths: Sequence[int] = (3, 5),
    folds: int = 3,
) -> CrossValidatorModel:
    """The best model is fitted on all rows. Folds are cut from vectors made once; the models of a fold are fitted side by side."""
    assembler, learner = create_model(model_type, params).getStages()
    grid = ParamGridBuilder().addGrid(learner.maxDepth, list(depths)).build()
    judge = RegressionEvaluator(labelCol=TARGET, predictionCol="predicted", metricName="rmse")
    search = CrossValidator(estimator=learner, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=params.seed, parallelism=len(grid))
    ready = assembled(_checkpointed(df), assembler).persist()
    try:
        found = search.fit(ready)
    finally:
        ready.unpersist()
    return CrossValidatorModel(PipelineModel([assembler, found.bestModel]), found.avgMetrics, stdMetrics=found.stdMetrics)
