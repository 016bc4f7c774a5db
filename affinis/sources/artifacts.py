"""Tables and metadata that a run leaves for later runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SPLITS = ("validation", "test")
#: Errors of a path that is not there; every other error of a folder is the caller's to see.
ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class Artifacts:
    """A folder of Parquet tables, by name; tables of stages are partitioned by the stage."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, name: str, df: DataFrame, *partitions: str) -> None:
        df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame | None:
        """The table, lazily; None if there is none."""
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if (e.getCondition() or "").startswith(ABSENT):
                return None
            raise

    def load(self, *names: str) -> dict[str, DataFrame]:
        """The tables of an earlier run; all that are missing are named at once."""
        found = {name: self.read(name) for name in names}
        missing = sorted(name for name, df in found.items() if df is None)
        if missing:
            raise FileNotFoundError(f"{self.path} has no {', '.join(missing)}")
        return found

    def load_candidates(self, split: str) -> DataFrame:
        if split not in SPLITS:
            raise ValueError(f"split is {split!r}, not one of {', '.join(SPLITS)}")
        return self.load(f"candidates_{split}")[f"candidates_{split}"]

    def write_stage(self, name: str, stage: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/stage={stage}")

    def read_stage(self, name: str, stage: str) -> DataFrame | None:
        return self.read(f"{name}/stage={stage}")

    def write_meta(self, name: str, values: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}.json")

    def read_meta(self, name: str) -> dict | None:
        try:
            rows = self.spark.read.text(f"{self.path}/{name}.json").collect()
        except AnalysisException as e:
            if (e.getCondition() or "").startswith(ABSENT):
                return None
            raise
        return json.loads(rows[0][0]) if rows else None

    def timings(self, stages: list[str]) -> DataFrame:
        """(stage, kind, seconds) from the stages' sidecars: train, predict and rank of each that has run."""
        rows = [(s, kind, float(x)) for s in stages for kind, x in ((self.read_meta(f"meta_{s}") or {}).get("seconds") or {}).items()]
        return self.spark.createDataFrame(rows, "stage string, kind string, seconds double")

    def write_factors(self, model: str, df: DataFrame, users: int, items: int, **more: float) -> None:
        """``df``: (side, id, bias, factors, seen). ``more``: numbers that go with the model, such as its regularisation."""
        self.write(f"factors_{model}", df, "side")
        self.write_meta(f"factors_{model}_shape", {"users": users, "items": items, **more})

    def read_factors(self, model: str, users: int, items: int) -> DataFrame | None:
        """None too if the model belongs to data of another shape."""
        shape = self.read_meta(f"factors_{model}_shape") or {}
        return self.read(f"factors_{model}") if (shape.get("users"), shape.get("items")) == (users, items) else None


def _is_result(value: object) -> bool:
    return isinstance(value, dict) and isinstance(value.get("rating"), dict) and isinstance(value.get("ranking"), dict)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """(name, section, metric, value) of the results in a JSON file, or in a folder's results.json, else in all its JSON files.

    A file holds one result or several by name, each with the sections rating and ranking. Files that are no JSON are
    skipped; a name that is there twice raises. Values are the finite numbers. Files of results are few and small.
    """
    try:
        files = {r.path: r.value for r in spark.read.option("wholetext", True).option("recursiveFileLookup", False).text(path).where(F.col("_metadata.file_name").endswith(".json") | F.lit(path.endswith(".json"))).select("value", F.col("_metadata.file_path").alias("path")).collect()}
    except AnalysisException as e:
        if not (e.getCondition() or "").startswith(ABSENT):
            raise
        files = {}
    preferred = [f for f in files if f.endswith("/results.json")]
    found: dict[str, dict] = {}
    for file in preferred or sorted(files):
        try:
            payload = json.loads(files[file])
        except json.JSONDecodeError:
            continue
        if not isinstance(payload, dict):
            continue
        named = [(payload["rating"].get("name"), payload)] if _is_result(payload) else list(payload.items())
        for name, value in named:
            if isinstance(name, str) and _is_result(value):
                if name in found:
                    raise ValueError(f"{name} has two results")
                found[name] = value
    rows = [(name, section, metric, float(x)) for name, result in found.items() for section, values in result.items() if isinstance(values, dict) for metric, x in values.items() if isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < float("inf")]
    return spark.createDataFrame(rows, "name string, section string, metric string, value double")


def nested_metric(results: DataFrame, section: str, metric: str) -> DataFrame:
    """(name, value) of one metric of the results that have it."""
    return results.where((F.col("section") == section) & (F.col("metric") == metric)).select("name", "value")


def merge_results(parts: DataFrame) -> DataFrame:
    """Of (part, stage, ...) rows the one of the highest part for each stage: later files win."""
    rest = [c for c in parts.columns if c not in ("part", "stage")]
    last = parts.groupBy("stage").agg(F.max(F.struct("part", *rest)).alias("x"))
    return last.select("stage", *[F.col(f"x.{c}").alias(c) for c in rest])
