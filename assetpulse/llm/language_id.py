"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and every letter yields three n-grams: itself, itself after its left neighbour, and itself between
both neighbours, where any run of other characters counts as one space. Each n-gram hashes to one of ``buckets``. Training
counts n-grams per language in Arrow batches, sums them by (language, bucket) with Spark, and smooths them into a matrix of
log-probabilities of languages x buckets floats, which is broadcast. Its size depends on the label set and not on the data.
Scoring adds, per document, the matrix entries of the document's n-grams (the product of its sparse row with the matrix).

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing is labelled.
Equal scores go to the label that sorts first. Columns of the input called like the outputs are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches, unused, without

UNDETERMINED = "und"
#: characters that are turned into n-grams at once; bounds the memory of a task
BLOCK = 1 << 19


@dataclass
class Model:
    labels: list[str]
    log_prior: np.ndarray  # per label
    log_prob: np.ndarray  # label x bucket, float32


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def pieces(text: str, size: int) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that end where a word ends; a word beyond that size is cut."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            cut = end
            while cut > at and text[cut - 1].isalpha():
                cut -= 1
            end = cut if cut > at else end
        yield text[at:end]
        at = end


def blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and pieces of texts, together about BLOCK characters."""
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        for part in pieces(text, BLOCK) if text else ():
            rows.append(row)
            parts.append(part)
            held += len(part)
            if held >= BLOCK:
                yield rows, parts
                rows, parts, held = [], [], 0
    if parts:
        yield rows, parts


def grams(rows: list[int], parts: list[str], letters: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row number of every letter, and its three buckets."""
    low = [p.lower() for p in parts]
    code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.asarray(rows, dtype=np.int64), [len(p) + 1 for p in low])
    is_letter = letters[code]
    c = np.where(is_letter, code, 32).astype(np.uint64)
    centre = np.flatnonzero(is_letter)
    here, left, right = c[centre], c[centre - 1], c[centre + 1]
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - int(math.log2(buckets)))
    pair = (left << np.uint64(21)) | here
    triple = (pair ^ (right << np.uint64(42))) * np.uint64(0xD6E8FEB86659FD93)
    keys = (here * mix, (pair + np.uint64(1 << 60)) * mix, (triple ^ (triple >> np.uint64(32))) * mix)
    return row[centre - 1], [(k >> shift).astype(np.int64) for k in keys]


def fit(
    df: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", buckets: int = 1 << 16,
    docs_per_label: int = 10_000, smoothing: float = 0.5,
) -> Model:
    """Learns from rows with a label and a text. ``buckets`` is a power of two.

    Priors count every such row. N-grams are counted in a sample of about ``docs_per_label`` whole documents of each
    label, chosen by a hash of id and text, so that the cost of training is bounded for any corpus.
    """
    small_batches(df.sparkSession)
    rows = df.where(F.col(label_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1_000_000)).alias("draw"),
    )
    counted = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a language
    labels = sorted(counted)
    if not labels:
        return Model([], np.zeros(0), np.zeros((0, buckets), np.float32))
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, math.ceil(1e6 * min(1.0, docs_per_label / counted[k])))])
    sample = rows.where(F.col("draw") < share[F.col("label")]).select("text", "label")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        place = {k: i for i, k in enumerate(labels)}
        total = np.zeros(len(labels) * buckets, dtype=np.int64)
        for batch in batches:
            of = batch["label"].map(place).to_numpy()
            for at, parts in blocks(batch["text"].tolist()):
                row, keys = grams(at, parts, letters, buckets)
                base = of[row] * buckets
                for k in keys:
                    total += np.bincount(base + k, minlength=len(total))
        hit = np.flatnonzero(total)
        for i in range(0, len(hit), 100_000):
            yield pd.DataFrame({"cell": hit[i : i + 100_000], "n": total[hit[i : i + 100_000]]})

    summed = sample.mapInPandas(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(labels) * buckets)  # at most labels x buckets rows arrive
    counts[summed["cell"].to_numpy(dtype=np.int64)] = summed["n"].to_numpy(dtype=np.float64)
    counts = counts.reshape(len(labels), buckets) + smoothing
    prior = np.array([counted[k] for k in labels], dtype=np.float64)
    return Model(labels, np.log(prior / prior.sum()), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def score_texts(texts: list[str | None], model: Model, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Best label and its posterior probability for each text."""
    n, buckets = len(texts), model.log_prob.shape[1]
    if not model.labels:
        return [UNDETERMINED] * n, np.zeros(n)
    sums, seen = np.zeros((len(model.labels), n)), np.zeros(n, dtype=np.int64)
    for at, parts in blocks(texts):
        row, keys = grams(at, parts, letters, buckets)
        if not len(row):
            continue
        first, last = int(row[0]), int(row[-1])
        within = row - first
        seen[first : last + 1] += np.bincount(within, minlength=last - first + 1)
        for i, weights in enumerate(model.log_prob):
            each = weights[keys[0]]
            each += weights[keys[1]]
            each += weights[keys[2]]
            sums[i, first : last + 1] += np.bincount(within, weights=each, minlength=last - first + 1)
    sums += model.log_prior[:, None]
    best = sums.argmax(axis=0)
    top = sums.max(axis=0)
    score = np.where(seen > 0, 1.0 / np.exp(sums - top).sum(axis=0), 0.0)
    return [model.labels[b] if s else UNDETERMINED for b, s in zip(best, seen)], score


def predict(df: DataFrame, model: Model, text_col: str = "text", label_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``df`` with the predicted label and its posterior probability. Only the text enters the prediction."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.labels, model.log_prior, model.log_prob))

    @F.pandas_udf("struct<label:string,score:double>")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters, fitted = letter_table(), Model(*shared.value)
        for batch in batches:
            names, score = score_texts([t if isinstance(t, str) else None for t in batch], fitted, letters)
            yield pd.DataFrame({"label": names, "score": score})

    (tmp,) = unused(df, "_guess")
    found = df.withColumn(tmp, guess(F.col(text_col)))
    return without(found, label_out, score_out).select("*", f"{tmp}.label", f"{tmp}.score").toDF(
        *without(df, label_out, score_out).columns, tmp, label_out, score_out
    ).drop(tmp)


def accepted(label: Column, score: Column, least: float = 0.5) -> Column:
    """Whether a document has a language at all: some letters, and a label that is likelier than all others together."""
    return (label != UNDETERMINED) & (score >= least)


def is_held_out(doc_id: Column) -> Column:
    """The fixed third of the documents that no model is fitted on; rows without an id belong to the others."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))
