"""Expressions and helpers shared by the operators of this package."""

from __future__ import annotations

import string
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import materialize

#: ASCII white space: what separates words in `sizes` and in the shingles
SPACE = "[\\x20\\x09-\\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Texts go to Python in batches of a few megabytes.

    Every batch is held several times over, on both sides and while its buffers grow, by every running task of an executor.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts as empty."""
    words = F.split(F.coalesce(text, F.lit("")), SPACE)  # at most one empty piece at either end
    empty = F.when(words[0] == "", 1).otherwise(0) + F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    return (F.size(words) - empty).cast("long")


class Ranges:
    """A union of spans (start, end), asked in logarithmic time whether a span meets it."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)  # ranges that start before b
        return i > 0 and self.ends[i - 1] > a


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names for intermediate results that ``df`` does not have in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to write."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the order of the array."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and has_map(kind.elementType)


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes over all columns of a row, with different seeds; maps enter as JSON."""
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if has_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    nulls = F.array(*[c.isNull() for c in cols])  # a null leaves the hash as it was
    return F.xxhash64(F.lit(1), nulls, *cols), F.xxhash64(F.lit(2), nulls, *cols)


def running_total(df: DataFrame, order: list, weight: str, column: str, label: str, codec: str | None = None) -> DataFrame:
    """``df``, written once in the given order, with the sum of ``weight`` (a long, never null) over all rows before each row.

    Rows are range-partitioned and sorted; every task adds up its own partition batch by batch, and the sums of the partitions
    (one row each) become offsets. ``order`` should identify rows: equal ones meet in one partition.
    """
    spark, (part,) = df.sparkSession, unused(df, "_part")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = 0, TaskContext.get().partitionId()
        for batch in batches:
            each = batch.column(weight).to_numpy()
            before = total + np.cumsum(each) - each
            total += int(each.sum())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(before, pa.int64()), pa.array(np.full(len(each), own), pa.int32())], [*batch.schema.names, column, part]
            )

    schema = T.StructType([*df.schema.fields, T.StructField(column, T.LongType()), T.StructField(part, T.IntegerType())])
    placed = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(add, schema), label, codec)
    sums = placed.groupBy(part).agg(F.max(F.col(column) + F.col(weight)).alias("_sum"))
    offsets = sums.select(F.col(part).alias("_of"), F.expr(f"sum(_sum) OVER (ORDER BY {part}) - _sum").alias("_offset"))
    found = placed.join(F.broadcast(offsets), F.col(part) == F.col("_of"))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(column) + F.col("_offset")).alias(column))
