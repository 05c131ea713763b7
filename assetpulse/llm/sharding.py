"""Shards documents by extendible hashing, so that no shard exceeds a byte limit.

A row's hash is a string of bits: 60 from the MD5 of its id, then 60 from its row number, which tell rows of one id apart.
The directory starts with one bucket and only buckets above the limit are split on the next bit, so a leaf is the shortest
prefix whose bytes fit. The splits are computed on sums: bytes are summed by cells of a fixed number of leading bits (with
map-side combining), the cells' sums are added up for every shorter prefix, and a prefix that fits while its parent does
not is a leaf. Cells that exceed the limit themselves, which needs crowded ids, go through the same steps with their next
bits, and only their rows do. Rows find their leaf by an equality join on the cell.

Defined results: a null text has 0 bytes, a null id hashes like the text ``null``. One row beyond the limit gets a shard of
its own, which is the only kind above the limit. The empty table has no shard; one that fits is the shard ``""``. Which of
several rows with one id lands where depends on the row numbers, all else is the same in every run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import broadcast_below, materialize
from .common import unused, without

BITS = 60


def id_bits(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def row_bits(number: Column) -> Column:
    return F.xxhash64(number).bitwiseAND(F.lit((1 << BITS) - 1))


def prefix(high: Column, low: Column, start: int, n: int) -> Column:
    """``n`` bits from bit ``start`` of the 120 bits, as a number; n is at most 30."""
    if n == 0:
        return F.lit(0).cast("long")
    if start + n <= BITS:
        return F.shiftright(high, BITS - start - n).bitwiseAND(F.lit((1 << n) - 1))
    if start >= BITS:
        return F.shiftright(low, 2 * BITS - start - n).bitwiseAND(F.lit((1 << n) - 1))
    head = BITS - start
    return F.shiftleft(prefix(high, low, start, head), n - head).bitwiseOR(prefix(high, low, BITS, n - head))


def as_bits(value: Column, n: Column | int) -> Column:
    """The lowest ``n`` bits as text of zeros and ones."""
    return F.when(F.lit(n) == 0, "").otherwise(F.lpad(F.bin(value), n, "0"))


def leaves(cells: DataFrame, width: int, limit: int) -> DataFrame:
    """(base, cell, depth, bytes, rows): for each cell its leaf's depth below ``base``, and the leaf's bytes and rows.

    A cell whose every prefix exceeds the limit has the depth null. ``cells`` has base, cell (``width`` bits), bytes, rows.
    """
    depth = F.explode(F.sequence(F.lit(0), F.lit(width))).alias("depth")
    levels = cells.select("base", "cell", "bytes", "rows", depth).withColumn("prefix", F.expr(f"shiftright(cell, {width} - depth)"))
    sums = levels.groupBy("base", "depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    fits = sums.where((F.col("bytes") <= limit) | (F.col("rows") == 1))
    # sums only shrink with depth, so the shortest fitting prefix of a cell is the least depth at which it fits
    placed = levels.select("base", "cell", "depth", "prefix").join(fits, ["base", "depth", "prefix"])
    first = placed.groupBy("base", "cell").agg(F.min(F.struct("depth", "bytes", "rows")).alias("leaf"))
    return cells.select("base", "cell").join(first, ["base", "cell"], "left").select("base", "cell", "leaf.*")


def directory(narrow: DataFrame, max_bytes: int, spare_bits: int = 4) -> tuple[DataFrame, list[int]]:
    """(path, shard, shard_bytes) for the cells of (high, low, bytes) rows, and the lengths of the paths.

    Paths are prefix-free, so a row meets exactly one of them among its own prefixes of the given lengths.
    """
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    width = min(30, math.ceil(math.log2(total / max_bytes)) + spare_bits) if total > max_bytes else 1
    start, rows, found, lengths = 0, narrow.withColumn("base", F.lit("")), None, []
    while True:
        at = prefix(F.col("high"), F.col("low"), start, width)
        cells = rows.groupBy("base", at.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        level = materialize(leaves(materialize(cells, "shard-cells"), width, max_bytes), "shard-leaves")
        bits = as_bits(F.col("cell"), width)
        done = level.where("depth IS NOT NULL").select(
            F.concat("base", bits).alias("path"), F.concat("base", F.substring(bits, F.lit(1), F.col("depth"))).alias("shard"),
            F.col("bytes").alias("shard_bytes"),
        )
        found = done if found is None else found.union(done)
        lengths.append(start + width)
        crowded = level.where("depth IS NULL").select(F.col("base").alias("b"), F.col("cell").alias("c"))
        if crowded.isEmpty():
            return found, lengths
        if start + width >= 2 * BITS:
            raise ValueError("rows with equal hashes exceed the limit")
        rows = rows.join(crowded, (F.col("base") == F.col("b")) & (at == F.col("c")), "left_semi")
        rows = rows.withColumn("base", F.concat("base", as_bits(at, width)))
        start, width = start + width, min(12, 2 * BITS - start - width)


def shards(df: DataFrame, size_col: str = "n_bytes", id_col: str = "doc_id", max_bytes: int = 1 << 28) -> DataFrame:
    """``df`` with shard (the bits of its leaf) and shard_bytes (what the shard holds). ``size_col`` has the bytes of a row.

    The rows are written to the shared folder once together with their numbers; the directory is computed from numbers and
    sizes alone and joined back by cell.
    """
    high, low, path = unused(df, "_high", "_low", "_path")
    sized = df.withColumn(high, id_bits(F.col(id_col))).withColumn(low, F.monotonically_increasing_id())
    rows = materialize(sized, "shard-rows").withColumn(low, row_bits(F.col(low)))
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long")
    found, lengths = directory(rows.select(F.col(high).alias("high"), F.col(low).alias("low"), size.alias("bytes")), max_bytes)
    found = materialize(found.withColumnRenamed("path", path), "shard-directory")
    found = broadcast_below(found, found.count())
    full = F.concat(as_bits(F.col(high), BITS), as_bits(F.col(low), BITS))
    paths = F.array(*[F.substring(full, 1, n) for n in lengths])
    kept = [F.col(f"`{c}`") for c in without(df, "shard", "shard_bytes").columns]
    one = rows.withColumn(path, paths[0] if len(lengths) == 1 else F.explode(paths))
    return one.select(*kept, path).join(found, path).select(*kept, "shard", "shard_bytes")


def text_bytes(text: Column) -> Column:
    """Bytes of a text in UTF-8; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
