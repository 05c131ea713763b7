"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words of digits, letters and characters beyond ASCII. Every k-gram of words is
hashed, and of each window of w consecutive k-grams the smallest hash is kept. Two texts that share k + w - 1 words share a
whole window and therefore keep the same k-gram of it, at the same place: with k = 5 and w = 6 every shared span of 10 words
is met. Items shorter than that are met by all n-grams of their own length (a window of one).

Kept document hashes are probed against a bitmap of the item hashes; what passes carries its surroundings (the k-gram and
the words around it that can lie in one span with it) and is joined to the items' hashes. A joined pair is extended word by
word over both surroundings; a common run of a whole window makes its words hits. Longer spans are the union of their
windows. The bitmap has a fixed size whatever the number of items; a bit set by chance only sends a row to the join.

Defined results: a null text has no words. Items without words match nothing. An item without an id makes words hits but is
not listed. Repeated rows are judged each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import ascii_lower, row_hashes, small_batches, unused

#: bits of the filter over item hashes (2 MB)
FILTER_BITS = 1 << 24
#: what Spark's bitmap functions put into one bucket
BUCKET_BITS = 32768
#: bytes of a word that are hashed in step with those of all other words
LONG = 64
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

KEPT = "array<struct<size:int,hash:bigint,at:int,before:int,words:array<string>>>"


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of lower-cased UTF-8 bytes, all bytes at once."""
    code = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate(([False], ((code >= 97) & (code <= 122)) | ((code >= 48) & (code <= 57)) | (code >= 128), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = np.zeros(len(starts), dtype=np.uint64)
    length = ends - starts
    left = np.arange(len(starts))
    step = 0
    while len(left) and step < LONG:  # the step-th byte of every word that is long enough
        hashes[left] = (hashes[left] ^ code[starts[left] + step].astype(np.uint64)) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)
        step += 1
        left = left[length[left] > step]
    for i in left:  # words beyond LONG bytes, which texts hardly have
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    hashes ^= hashes >> np.uint64(29)
    return starts, ends, hashes * np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram of word hashes."""
    n = max(len(words) - k + 1, 0)
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window, the last of equal ones."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


class Scheme:
    """Which k-grams are kept: those of the general window, and all n-grams of the lengths of short items."""

    def __init__(self, window: int = 10, k: int = 5, short: tuple[int, ...] = ()):
        self.window, self.k, self.short = window, min(k, window), tuple(sorted(short))

    def kept(self, words: np.ndarray, whole_item: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(window length, k, places, hashes). A short item is one window of its own length."""
        if not whole_item or len(words) >= self.window:
            h = gram_hashes(words, self.k)
            at = winnow(h, self.window - self.k + 1)
            yield self.window, self.k, at, h[at]
        for n in self.short:
            if not whole_item or len(words) == n:
                h = gram_hashes(words, n)
                yield n, n, np.arange(len(h)), h


def kept_of(text: bytes | None, scheme: Scheme, whole_item: bool, passes) -> tuple[int, list[dict]]:
    """Number of words, and the kept k-grams whose hash passes, each with the words of all windows that hold it."""
    if not text:
        return 0, []
    data = text.lower()
    starts, ends, hashes = word_hashes(data)
    found = []
    for size, k, places, kept in scheme.kept(hashes, whole_item):
        ok = passes(kept)
        for at, h in zip(places[ok].tolist(), kept[ok].view(np.int64).tolist()):
            low, high = max(0, at + k - size), min(len(starts), at + size)
            words = [data[s:e].decode() for s, e in zip(starts[low:high].tolist(), ends[low:high].tolist())]
            found.append({"size": size, "hash": h, "at": at, "before": at - low, "words": words})
    return len(starts), found


def kept_grams(text: Column, scheme: Scheme, whole_item: bool, bits: bytes | None, spark) -> Column:
    """struct<n_words, kept>: see ``kept_of``; without a bitmap every hash passes."""
    shared = spark.sparkContext.broadcast(bits) if bits is not None else None
    window, k, short = scheme.window, scheme.k, scheme.short

    @F.pandas_udf(f"struct<n_words:bigint,kept:{KEPT}>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Scheme(window, k, short)
        if shared is None:
            def passes(h):
                return np.ones(len(h), dtype=bool)
        else:
            table, mask = np.frombuffer(shared.value, dtype=np.uint8), np.uint64(len(shared.value) * 8 - 1)

            def passes(h):
                bit = (h & mask).astype(np.int64)
                return (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0

        for batch in batches:
            rows = [kept_of(t, own, whole_item, passes) for t in batch]
            yield pd.DataFrame({"n_words": [n for n, _ in rows], "kept": [kept for _, kept in rows]})

    return scan(text.cast("binary"))


def bitmap(hashes: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A bitmap of the hashes' low bits. Spark builds it in buckets; at most bits / 8 bytes reach the driver."""
    bit = F.col("hash").bitwiseAND(F.lit(bits - 1))
    rows = (
        hashes.select(bit.alias("bit"))
        .groupBy(F.expr(f"bit div {BUCKET_BITS}").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.expr(f"bit % {BUCKET_BITS}")).alias("bits"))
    )
    out = bytearray(bits // 8)
    width = BUCKET_BITS // 8
    for r in rows.toLocalIterator():
        out[r.bucket * width : r.bucket * width + len(r.bits)] = r.bits
    return bytes(out)


def run_around(a: Column, a_at: Column, b: Column, b_at: Column, k: Column, size: Column) -> Column:
    """struct<start, n>: the longest common run of two word arrays through their common k-gram, started at a's place."""
    steps = F.sequence(F.lit(1), F.greatest(size - k, F.lit(1)))  # a window reaches at most size - k words to either side

    def reach(same) -> Column:
        return F.aggregate(steps, F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= size - k) & same(i), i).otherwise(n))

    left = reach(lambda i: F.coalesce((a_at - i >= 0) & (b_at - i >= 0) & (F.get(a, a_at - i) == F.get(b, b_at - i)), F.lit(False)))
    right = reach(lambda i: F.coalesce(F.get(a, a_at + k - 1 + i) == F.get(b, b_at + k - 1 + i), F.lit(False)))
    same = F.slice(a, a_at + 1, k) == F.slice(b, b_at + 1, k)
    return F.when(same, F.struct((a_at - left).alias("start"), (left + k + right).alias("n")))


def union_size(spans: Column) -> Column:
    """Number of places that sorted spans (start, end exclusive) cover."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    step = F.aggregate(
        spans, start,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["end"]).alias("end")
        ),
    )
    return step["n"]


def item_lengths(items: DataFrame, text_col: str, window: int) -> tuple[int, ...]:
    """Word counts below the window that occur among the items; fewer than ``window`` rows arrive."""
    n = F.size(F.filter(F.split(ascii_lower(F.col(text_col)), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != ""))
    return tuple(r.n for r in items.select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < window)).distinct().collect())


def contamination(
    docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = 10, k: int = 5,
) -> DataFrame:
    """The columns ``keep`` of every document with n_words, n_hit, the sorted hit ``spans`` (words, end exclusive) and ``items``.

    Documents are read once; their word counts and candidates are written to the shared folder.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scheme = Scheme(window, k, item_lengths(items, item_text, window))
    scanned = items.select(F.col(item_col).cast("string").alias("item"), kept_grams(F.col(item_text), scheme, True, None, spark).alias("s"))
    grams = scanned.select("item", F.explode("s.kept").alias("g")).select("item", "g.*")
    grams = materialize(grams, "decontaminate-items")
    filled = bitmap(grams.select("hash"))
    names = unused(docs.select(*keep), "_u", "_s")
    uid, scan = names
    rows = docs.select(*keep, kept_grams(F.col(text_col), scheme, False, filled, spark).alias(scan))
    rows = materialize(rows.withColumn(uid, F.monotonically_increasing_id()), "decontaminate-docs")
    candidates = rows.select(F.col(uid).alias("uid"), F.explode(f"{scan}.kept").alias("g")).select("uid", "g.*")
    # one row for each distinct surrounding of an item hash
    other = grams.groupBy("size", "hash", "before", "words").agg(F.collect_set("item").alias("items"), F.count("*").alias("n"))
    other = other.select("size", "hash", F.col("before").alias("b_before"), F.col("words").alias("b_words"), "items")
    joined = candidates.join(other, ["size", "hash"])
    length = F.when(F.col("size") < window, F.col("size")).otherwise(F.lit(scheme.k))
    run = run_around(F.col("words"), F.col("before"), F.col("b_words"), F.col("b_before"), length, F.col("size"))
    runs = joined.select("uid", "at", "before", "size", "items", run.alias("run")).where(F.col("run.n") >= F.col("size"))
    start = F.col("at") - F.col("before") + F.col("run.start")
    spans = runs.select("uid", start.alias("start"), (start + F.col("run.n")).alias("end"), "items")
    covered = spans.groupBy("uid").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = rows.join(covered, rows[uid] == covered["uid"], "left").select(
        *[rows[c] for c in keep], F.col(f"{scan}.n_words").alias("n_words"), F.coalesce(union_size(covered["spans"]), F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(covered["spans"], none).alias("spans"), F.coalesce(covered["items"], F.array().cast("array<string>")).alias("items"),
    )
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents none of whose words lies in a window shared with an item."""
    key = unused(docs, "_row_a", "_row_b")
    marked = docs.withColumns(dict(zip(key, row_hashes(docs))))
    found = contamination(marked, items, keep=tuple(key), text_col=text_col, **options)
    dirty = found.where("n_hit > 0").select(*key).distinct()
    return marked.join(dirty, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
