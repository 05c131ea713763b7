"""Token counts as additive totals that batches of signed changes maintain.

A change is a row with the keys (source, lang, version of the tokenizer), a sign and a number of tokens: an insert is +1, a
delete -1, a revised count (or a document that moves to another source) a -1 with what was counted and a +1 with what is
counted now. A batch is summed by key, with map-side combining, and committed as a small table of deltas under its number.
Totals are the sums over the last snapshot and the batches that it does not hold.

Commits are idempotent. Every delivery of a batch writes a folder of its own under the batch's number and counts once its
writer has marked it complete; of several deliveries the first complete one by name counts, so a reader never misses a batch
that is delivered again, and what a lost driver left half-written is not read. A snapshot keeps the numbers of the batches
that it holds as ranges: those, and no others, are ignored from then on, so a batch that comes late, after a snapshot of
later ones, still counts. As the batch number of a stream has this meaning too, ``follow`` is exactly-once.

Defined results: null keys are keys. Null token counts are 0. Keys whose documents and tokens are all gone have no row. An
empty batch is committed and changes nothing.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import forget, materialize, scratch_dir
from .common import small_batches

KEYS = ("source", "lang", "version")
COLUMNS = "source string, lang string, version string, docs bigint, tokens bigint"
#: characters after which a long text is cut at a place that no token crosses
PIECE = 1 << 16


def vocabulary_path() -> str:
    """The public byte-level vocabulary of this environment."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    """How that vocabulary's tokenizer cuts texts into words."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def pieces(text: str, size: int, cut: re.Pattern) -> Iterator[str]:
    """The text in pieces that end before a lone space in front of a letter, where the word pattern begins a word anyway."""
    at = 0
    while len(text) - at > size:
        m = cut.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_count(text: Column, spark: SparkSession, vocabulary: str | None = None, word_pattern: str | None = None) -> Column:
    """Number of tokens of each text; the vocabulary (under 1 MB) is read on the driver and broadcast."""
    with open(vocabulary or vocabulary_path(), "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    words = word_pattern or pattern()

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encode = tiktoken.Encoding("counts", pat_str=words, mergeable_ranks=table, special_tokens={}).encode_ordinary
        cut = re.compile(r"(?<=\S) (?=[^\W\d_])")
        for batch in batches:
            yield pd.Series([sum(len(encode(p)) for p in pieces(t, PIECE, cut)) if isinstance(t, str) else 0 for t in batch], dtype="int64")

    return count(text)


def count_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", version: str = "byte_bpe_50k", **options) -> DataFrame:
    """(id, source, lang, version, copy, estimate, tokens) of each document, written to the shared folder.

    ``copy`` identifies the text; ``estimate`` is what a quarter of the bytes suggests before anything is counted.
    """
    small_batches(df.sparkSession)
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    counted = df.select(
        F.col(id_col).alias("id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("version"),
        F.struct(F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("hash"), size.alias("bytes")).alias("copy"),
        F.ceil(size / 4).alias("estimate"), token_count(text, df.sparkSession, **options).alias("tokens"),
    )
    return materialize(counted, "tokens-counted")


def signed(counted: DataFrame, sign: int, count_col: str) -> DataFrame:
    """One change for each counted document."""
    return counted.select(*KEYS, F.lit(sign).cast("long").alias("sign"), F.col(count_col).cast("long").alias("tokens"))


def first_copies(counted: DataFrame) -> DataFrame:
    """Of the documents with one text that with the smallest id; partial minima meet, however many copies there are."""
    row = F.struct(F.col("id").isNull().alias("unnamed"), "id", *KEYS, "estimate", "tokens")
    return counted.groupBy("copy").agg(F.min(row).alias("row")).select("row.id", *[f"row.{k}" for k in KEYS], "row.estimate", "row.tokens")


def new_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/assetpulse-{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"


def merged_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of whole numbers, those that touch joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def complete(self, kind: str) -> list[tuple[int, str]]:
        """(number, path) of the folders that their writer marked complete, by number and name."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}=*/part-*/_SUCCESS")
        found = [s.getPath().getParent() for s in path.getFileSystem(conf).globStatus(path) or []]
        return sorted((int(p.getParent().getName().partition("=")[2]), p.toString()) for p in found)

    def write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.write.parquet(f"{self.folder}/{kind}={number}/part-{uuid.uuid4().hex}")

    def snapshot(self) -> tuple[int, str | None, list[tuple[int, int]]]:
        """Number and path of the last snapshot, and the ranges (first, last) of the batches it holds; -1, None and none without one."""
        last, path = max(self.complete("snapshot"), default=(-1, None))
        if path is None:
            return -1, None, []
        held = self.spark.read.parquet(path).where("kind = 'held'").select("docs", "tokens").collect()  # one row a gap in the numbers
        return last, path, sorted((r.docs, r.tokens) for r in held)

    def open_batches(self, held: list[tuple[int, int]]) -> dict[int, str]:
        """The folder that counts of each complete batch outside the ranges ``held``."""
        out: dict[int, str] = {}
        for number, path in self.complete("batch"):
            if not any(a <= number <= b for a, b in held):
                out.setdefault(number, path)
        return out

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Records the changes of a batch, once for each number."""
        _, _, held = self.snapshot()
        if any(a <= batch <= b for a, b in held) or batch in self.open_batches(held):
            return
        count = F.coalesce(F.col("tokens"), F.lit(0))
        sums = changes.groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * count).alias("tokens"))
        self.write(sums.withColumn("kind", F.lit("sum")), "batch", batch)

    def sums(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], COLUMNS)
        rows = self.spark.read.schema(COLUMNS + ", kind string").parquet(*paths).where("kind = 'sum'")
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 OR tokens != 0")

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over all committed batches."""
        _, path, held = self.snapshot()
        return self.sums([*self.open_batches(held).values(), *([path] if path else [])])

    def compact(self) -> None:
        """Folds the batches so far into a snapshot with their numbers; it counts, and they stop counting, once it is complete.

        The folders of batches that the snapshot before held are deleted: nothing has read them since.
        """
        last, path, held = self.snapshot()
        new = self.open_batches(held)
        if not new:
            return
        ranges = merged_ranges([*held, *((n, n) for n in new)])
        rows = self.sums([*new.values(), *([path] if path else [])]).withColumn("kind", F.lit("sum"))
        text = [None] * len(KEYS)
        numbers = self.spark.createDataFrame([(*text, a, b, "held") for a, b in ranges], COLUMNS + ", kind string")
        self.write(rows.union(numbers), "snapshot", last + 1)
        for number in {n for n, _ in self.complete("batch")}:
            if any(a <= number <= b for a, b in held):
                forget(self.spark, f"{self.folder}/batch={number}")

    def follow(self, changes: DataFrame, checkpoint: str):
        """Starts a streaming query that commits each micro-batch of changes under its number."""
        return changes.writeStream.foreachBatch(lambda rows, number: self.commit(number, rows)).option("checkpointLocation", checkpoint).start()
