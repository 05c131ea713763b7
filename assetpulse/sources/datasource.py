"""The readings payload as a Python data source: ``spark.read.format("readings_payload").load(path)``."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, seq bigint, sensor_id string, ts string, value double, unit string"


class PayloadFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PayloadReader(DataSourceReader):
    """One partition per payload file; records that are no readings are left to validation as nulls."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.path, "*.json"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [PayloadFile(p) for p in found]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as handle:
            body = json.load(handle)
        entries = body.get("readings") if isinstance(body, dict) else body
        if not isinstance(entries, list):
            raise ValueError(f"{partition.path}: no readings array")
        for seq, entry in enumerate(entries):
            if not isinstance(entry, dict):
                raise ValueError(f"{partition.path}: entry {seq} is no object")
            value = entry.get("value")
            number = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
            texts = [v if isinstance(v, str) else None for v in (entry.get("sensor_id"), entry.get("ts"), entry.get("unit"))]
            yield (partition.path, seq, texts[0], texts[1], number, texts[2])


class ReadingsPayload(DataSource):
    @classmethod
    def name(cls) -> str:
        return "readings_payload"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReadingsPayload)
