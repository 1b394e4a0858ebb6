"""Resumable stages: the flow's outputs by name in a folder, skipped when complete.

A stage is complete when its folder holds the committer's ``_SUCCESS`` marker and its manifest agrees with the settings it was
made with; a stage that was interrupted or whose settings changed is made again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.metrics import fingerprint


class Workspace:
    """Stage outputs below one folder that Spark can read and write."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict | None = None) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.digest = hashlib.sha256(json.dumps(settings or {}, sort_keys=True).encode()).hexdigest()

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def manifest(self, name: str) -> dict | None:
        """Settings digest, row count and content digest of a complete stage; null if there is none."""
        try:
            row = self.spark.read.json(f"{self.path(name)}.manifest").first()
        except AnalysisException:
            return None
        return row.asDict() if row else None

    def done(self, name: str) -> bool:
        found = self.manifest(name)
        return found is not None and found["settings"] == self.digest

    def stage(self, name: str, make: Callable[[], DataFrame], partition_by: str | None = None) -> DataFrame:
        """The stage's result, made only if it is not there yet."""
        if not self.done(name):
            writer = make().write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))
            rows, content = fingerprint(self.spark.read.parquet(self.path(name)))
            state = [{"settings": self.digest, "rows": rows, "content": content}]
            self.spark.createDataFrame(state).coalesce(1).write.mode("overwrite").json(f"{self.path(name)}.manifest")
        return self.spark.read.parquet(self.path(name))

    def unchanged(self, name: str) -> bool:
        """Whether the stored rows still agree with the manifest."""
        found = self.manifest(name)
        return found is not None and (found["rows"], found["content"]) == fingerprint(self.spark.read.parquet(self.path(name)))
