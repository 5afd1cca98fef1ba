"""Model artefacts: versions, run metadata, metrics, feature importance.

What a training run writes stands under its version and is seen by nobody until `publish`
renames one small file, `current`, that names the version; `latest` means what it names. So a run that
fails half way changes nothing for readers, and they never see parts of two runs.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stopwise.sources.schemas import RUNS
from stopwise.sources.tables import exists

LATEST = "latest"

# By folder and asked version: the version that was meant, and its model.
_LOADED: dict[tuple[str, str], tuple[str, PipelineModel]] = {}


def new_version(model_type: str, at: datetime.datetime) -> str:
    return f"{model_type}_{at:%Y%m%d_%H%M%S}"


def model_path(model_dir: str, version: str) -> str:
    return f"{model_dir.rstrip('/')}/model_{version}"


def publish(spark: SparkSession, model_dir: str, version: str) -> None:
    """Make a version the latest one, in a single rename."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    pointer = hadoop.Path(f"{model_dir.rstrip('/')}/current")
    draft = hadoop.Path(f"{model_dir.rstrip('/')}/_current-{uuid.uuid4().hex}")
    out = pointer.getFileSystem(conf).create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    files = hadoop.FileContext.getFileContext(pointer.getFileSystem(conf).getUri(), conf)
    files.rename(files.makeQualified(draft), files.makeQualified(pointer), overwrite)


def current(spark: SparkSession, model_dir: str) -> str | None:
    """The published version, if there is one."""
    path = f"{model_dir.rstrip('/')}/current"
    return spark.read.text(path).first()[0] if exists(spark, path) else None


def save_model(model: PipelineModel, model_dir: str, version: str) -> str:
    path = model_path(model_dir, version)
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, model_dir: str, version: str = LATEST) -> PipelineModel:
    """By version, once per driver process; the latest one anew when another is published."""
    meant = (current(spark, model_dir) or LATEST) if version == LATEST else version
    key = (model_dir, version)
    if key not in _LOADED or _LOADED[key][0] != meant:
        path = model_path(model_dir, meant)
        if not exists(spark, path):
            raise FileNotFoundError(f"no model at {path}")
        _LOADED[key] = meant, PipelineModel.load(path)
    return _LOADED[key][1]


def list_models(spark: SparkSession, model_dir: str) -> DataFrame:
    """Version, path, and whether this process has it loaded: one row per saved model, and `latest` for the published one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{model_dir.rstrip('/')}/model_*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    paths = {entry.getPath().getName().removeprefix("model_"): entry.getPath().toString() for entry in found}
    published = current(spark, model_dir)
    if published in paths:
        paths[LATEST] = paths[published]
    rows = [(version, path, (model_dir, version) in _LOADED) for version, path in paths.items()]
    return spark.createDataFrame(rows, "version string, path string, loaded boolean")


def write_run(
    spark: SparkSession,
    model_dir: str,
    version: str,
    model_type: str,
    at: datetime.datetime,
    feature_names: list[str],
    metrics: dict[str, float],
    params: dict[str, str],
    samples: dict[str, int],
) -> None:
    """One JSON row per training run; the same version again replaces its own."""
    row = (version, model_type, at, model_path(model_dir, version), feature_names, metrics, params, samples)
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("overwrite").json(f"{model_dir.rstrip('/')}/runs/{version}")


def read_runs(spark: SparkSession, model_dir: str) -> DataFrame:
    path = f"{model_dir.rstrip('/')}/runs"
    if not exists(spark, path):
        return spark.createDataFrame([], RUNS)
    return spark.read.schema(RUNS).option("recursiveFileLookup", True).json(path)


def _importance_path(model_dir: str, version: str) -> str:
    return f"{model_dir.rstrip('/')}/feature_importance/{version}"


def write_importance(importance: DataFrame, model_dir: str, version: str) -> None:
    """Two-column CSV, strongest first; one row per feature, hence one file."""
    ordered = importance.coalesce(1).sortWithinPartitions(F.desc("importance"), "feature")
    ordered.write.mode("overwrite").option("header", True).csv(_importance_path(model_dir, version))


def read_importance(spark: SparkSession, model_dir: str, version: str = LATEST) -> DataFrame:
    meant = current(spark, model_dir) if version == LATEST else version
    schema = "feature string, importance double"
    path = _importance_path(model_dir, meant or LATEST)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path).orderBy(F.desc("importance"), "feature")


def _part(prefix: str) -> Column:
    """The metrics of one part, without the prefix in their names."""
    chosen = F.map_filter("metrics", lambda name, _: name.startswith(prefix))
    return F.transform_keys(chosen, lambda name, _: F.substring(name, len(prefix) + 1, 1000))


def model_metrics(spark: SparkSession, model_dir: str, version: str = "latest") -> DataFrame:
    """The published, a named or, where none is published, the newest run: metrics by part and importance.

    Raises LookupError where there is no such run.
    """
    runs = read_runs(spark, model_dir)
    meant = current(spark, model_dir) if version == LATEST else version
    if meant:
        runs = runs.filter(F.col("version") == meant)
    chosen = runs.orderBy(F.desc("timestamp"), F.desc("version")).limit(1)
    row = chosen.select(
        F.col("version").alias("model_version"),
        "model_type",
        "timestamp",
        _part("train_").alias("training_metrics"),
        _part("val_").alias("validation_metrics"),
        _part("test_").alias("test_metrics"),
    )
    if row.isEmpty():
        raise LookupError(f"no run {version} in {model_dir}")
    listed = F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False)
    strongest_first = F.transform(listed, lambda entry: F.struct(entry["feature"], entry["importance"]))
    importance = read_importance(spark, model_dir, version).agg(strongest_first.alias("feature_importance"))
    return row.withColumn("feature_importance", importance.scalar())
