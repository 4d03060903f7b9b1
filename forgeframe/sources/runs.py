"""Training runs, model files and step logs as tables."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_name

RUN = "run_id string, created_at string, model_name string, r2 double, rmse double, mae double, train_time double, split_strategy string, test_size double, random_state int, params map<string,string>, n_samples long, n_features long"
STEP = "step_id int, timestamp string, operation string, description string, params map<string,string>, input_shape array<long>, output_shape array<long>, features_added array<string>, features_removed array<string>, status string, message string"
VERSION = "1.0"


def save_run(spark: SparkSession, folder: str, metadata: dict, history: DataFrame | None = None) -> str:
    """Appends a run to ``folder``/runs, its curve to ``folder``/history (K04); returns its id."""
    row = {c.split()[0]: metadata.get(c.split()[0]) for c in RUN.split(", ")}
    row["params"] = {k: json.dumps(v) if not isinstance(v, str) else v for k, v in (metadata.get("params") or {}).items()}
    made = spark.createDataFrame([tuple(row.values())], RUN)
    made = made.withColumn("created_at", F.coalesce("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")))
    run_id = F.concat(F.regexp_replace(F.regexp_replace("created_at", "[-:]", ""), " ", "_"), F.lit("_"), safe_name(F.col("model_name")))
    made = made.withColumn("run_id", F.coalesce("run_id", run_id)).cache()
    name = made.first()["run_id"]
    made.write.mode("append").parquet(f"{folder}/runs")
    if history is not None:
        history.withColumn("run_id", F.lit(name)).write.mode("append").parquet(f"{folder}/history")
    return name


def list_runs(runs: DataFrame, k: int = 200) -> DataFrame:
    """The ``k`` newest runs by id."""
    return runs.orderBy(F.col("run_id").desc()).limit(k)


def read_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    """Runs from metadata files, one folder a run; broken files are left out."""
    schema = ", ".join(c for c in RUN.split(", ") if not c.startswith("run_id"))
    rows = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(pattern)
    rows = rows.withColumn("run_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return rows.where("model_name is not null").drop("_corrupt_record")


def save_model(spark: SparkSession, model: PipelineModel, folder: str, features: list[str], target: str, metrics: dict, extra: dict | None = None) -> None:
    """A fitted pipeline with what it was fitted on."""
    model.write().overwrite().save(f"{folder}/pipeline")
    facts = {"artifact_version": VERSION, "feature_cols": features, "target_col": target, "metrics": metrics, "extra": extra or {}}
    spark.createDataFrame([(json.dumps(facts, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/artifact")


def load_model(spark: SparkSession, folder: str) -> tuple[PipelineModel, dict]:
    """(pipeline, facts)."""
    return PipelineModel.load(f"{folder}/pipeline"), json.loads(spark.read.text(f"{folder}/artifact").first()["value"])


def content_ids(files: DataFrame) -> DataFrame:
    """Files with a hash of their content, each content once, the first path."""
    hashed = files.select("path", F.sha2("content", 256).alias("content_id"))
    return hashed.groupBy("content_id").agg(F.min("path").alias("path"))


class Tracker:
    """Steps of a pipeline, in order; shapes only where the caller knows them."""

    def __init__(self) -> None:
        self.steps: list[dict] = []

    def log(self, operation: str, description: str = "", params: dict | None = None, before: DataFrame | None = None, after: DataFrame | None = None, status: str = "success", message: str = "", timestamp: str = "") -> dict:
        old, new = (list(d.columns) if d is not None else [] for d in (before, after))
        step = {
            "step_id": len(self.steps) + 1, "timestamp": timestamp, "operation": operation, "description": description, "params": {k: str(v) for k, v in (params or {}).items()},
            "input_shape": [None, len(old)], "output_shape": [None, len(new)], "features_added": [c for c in new if c not in old], "features_removed": [c for c in old if c not in new], "status": status, "message": message,
        }
        self.steps.append(step)
        return step

    def last(self) -> dict | None:
        return self.steps[-1] if self.steps else None

    def clear(self) -> None:
        self.steps.clear()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(s.values()) for s in self.steps], STEP)


def status_counts(steps: DataFrame) -> DataFrame:
    """Steps by status, with the total."""
    return steps.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("success", "warning", "error")))


def steps_json(steps: DataFrame) -> DataFrame:
    """Each step as JSON."""
    return steps.select("step_id", F.to_json(F.struct(*steps.columns)).alias("json"))


def training_script(model: str, features: list[str], target: str, params: dict, path: str) -> str:
    """A script that trains the same model on its own."""
    return f'''"""Trains {model} on {path}."""
from forgeframe.operators.models import train
from forgeframe.session import session
from forgeframe.sources.files import load, with_row_id

spark = session()
data = with_row_id(load(spark, {path!r}))
model, predictions, scores = train(data, {features!r}, {target!r}, "__rid", {model!r}, **{params!r})
scores.show()
'''
