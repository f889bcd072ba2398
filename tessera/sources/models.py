"""Fitted pipelines with versions: each is saved whole to a folder of its own, and a pointer names the one in use."""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .stored import drop_path, list_names, move, read_text, write_text


class WrongSchema(ValueError):
    pass


class ModelStore:
    """Pipelines under a folder that the driver and all executors share.

    A version is its number, a record of it (schema of the rows it learned from, notes) and the pipeline. Records are numbered folders that are renamed into place and never
    replaced: the highest is in use, a version without one is not there, and of two writers of one number the second takes the next.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        return [int(x) for x in list_names(self.spark, f"{self.root}/versions") if x.isdigit()]

    def record(self, version: int | None = None) -> dict:
        """Version, folder, schema and notes; of the one in use without a number."""
        there = self.versions()
        version = max(there, default=0) if version is None else version
        if version not in there:
            raise LookupError(f"no version {version} in {self.root}")
        return {"version": version, **json.loads(read_text(self.spark, f"{self.root}/versions/{version:09d}/record.json"))}

    def save(self, model: PipelineModel, learned_from: DataFrame, **notes) -> int:
        name = uuid.uuid4().hex
        model.save(f"{self.root}/model-{name}")
        aside = f"{self.root}/aside-{name}"
        write_text(self.spark, f"{aside}/record.json", json.dumps({"folder": f"model-{name}", "schema": learned_from.schema.jsonValue(), "notes": notes}))
        while True:
            version = max(self.versions(), default=0) + 1
            try:
                move(self.spark, aside, f"{self.root}/versions/{version:09d}")
                return version
            except FileExistsError:
                continue  # another writer took the number

    def load(self, version: int | None = None) -> PipelineModel:
        return PipelineModel.load(f"{self.root}/{self.record(version)['folder']}")

    def predict(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        """Rows with what the pipeline adds; they must have the columns that it learned from, with their types."""
        known = {f.name: f.dataType for f in T.StructType.fromJson(self.record(version)["schema"])}
        here = {f.name: f.dataType for f in rows.schema}
        wrong = [c for c, kind in known.items() if here.get(c) != kind]
        if wrong:
            raise WrongSchema(", ".join(wrong))
        return self.load(version).transform(rows)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest versions, and what writers that died have left."""
        numbers = sorted(self.versions())[-keep:] if keep else []
        used = {self.record(v)["folder"] for v in numbers}
        for v in set(self.versions()) - set(numbers):
            drop_path(self.spark, f"{self.root}/versions/{v:09d}")
        for name in list_names(self.spark, self.root):
            if name.startswith(("model-", "aside-")) and name not in used:
                drop_path(self.spark, f"{self.root}/{name}")
