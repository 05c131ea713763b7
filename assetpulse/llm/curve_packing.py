"""Packs documents into sequences of tokens along a space-filling curve, so that neighbours in a sequence are alike.

A document's tokens are counted in ``BUCKETS`` hashed buckets; the logarithms of the counts, as a vector of length 1, are
projected to ``DIMENSIONS`` directions drawn once from normal numbers. Every projection of such a vector is distributed about
like a normal number, so its normal distribution function spreads it over (0, 1), cut into 2^15 steps without a look at the
data. The steps are the coordinates of a cell of a grid, whose place on the Hilbert curve is the sort key. Documents are
range-sorted by (key, hash of the tokens, id, row), so that copies, however many, lie in several ranges, and their tokens
numbered along the curve by running sums of partitions.

Sequences are cut every ``length`` tokens along the curve, through documents where need be: every sequence is full. What is
left at the end of the curve is cut into sequences whose lengths are powers of two, largest first, so nothing is padded.

Tokens are stored in two bytes each while they are sorted (four for vocabularies beyond 65,536 entries). A text is cut at
ASCII white space before it is tokenised: words of the vocabulary never cross it, so a task tokenises every distinct word
once as long as it remembers it. Defined results: a null text is empty, and an empty text is the end token alone. Rows without an id are packed like all
others. Repeated rows are packed each on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import running_total, small_batches

BUCKETS, DIMENSIONS, STEPS = 1024, 4, 15
#: pieces of words, and words, whose tokens a task remembers
REMEMBERED = 1 << 18


def vocabulary_path() -> str:
    """The public vocabulary with word ends of this environment."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Token ids of texts as bytes, with the ids of the pieces of words once seen.

    A text of printable ASCII characters and the letters of U+00C0 to U+00FF is cut into pieces by the vocabulary's own
    pattern, and only new pieces go through its model. Other texts are cut into words at ASCII white space; new words go
    through the whole tokenizer in long rows, set apart by a special token.
    """

    #: fixed value: how the vocabulary cuts such a text, its ASCII letters in lower case
    PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]+|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[!-/:-`{-~]+")
    OTHER = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f\xc2\xc4-\xff]|\xc3[\x97\xb7]")
    APART = "<|startoftext|>"

    def __init__(self, vocabulary: bytes, kind: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.kind = kind
        self.tokenizer, self.plain = Tokenizer.from_buffer(vocabulary), Tokenizer.from_buffer(vocabulary)
        self.plain.encode_special_tokens = True  # their names in a text are ordinary text
        self.model, self.apart = self.plain.model, self.tokenizer.token_to_id(self.APART)
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def stored(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def learn_pieces(self, new: set[bytes]) -> None:
        lengths, ids, tokenize = [], [], self.model.tokenize
        for piece in new:
            found = tokenize(piece.decode() if piece.isascii() else piece.decode().lower().translate(self.written))
            ids.extend([t.id for t in found])
            lengths.append(len(found))
        data, width = self.stored(ids), np.dtype(self.kind).itemsize
        ends = (np.cumsum(lengths) * width).tolist()
        self.pieces.update(zip(new, (data[a:b] for a, b in zip([0, *ends], ends))))

    def learn_words(self, new: set[bytes]) -> None:
        others = []
        for word in new:
            if self.apart is None or b"<|" in word or len(word) > 1000:
                self.words[word] = self.stored(self.plain.encode(word.decode(errors="replace"), add_special_tokens=False).ids)
            else:
                others.append(word)
        rows = [others[at : at + 500] for at in range(0, len(others), 500)]
        for row in rows:
            text = self.APART.join(f" {w.decode(errors='replace')} " for w in row)
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int64)
            for word, own in zip(row, np.split(ids, np.flatnonzero(ids == self.apart))):
                self.words[word] = self.stored(own[own != self.apart])

    def ids(self, texts: list[bytes | None], end: int) -> list[bytes]:
        """The ids of each text and the end token."""
        known, cut, last = [], [], self.stored([end])
        for text in texts:
            simple = not text or not self.OTHER.search(text)
            known.append(self.pieces if simple else self.words)
            cut.append(self.PIECES.findall((text or b"").lower()) if simple else text.split())
        for own, learn in ((self.pieces, self.learn_pieces), (self.words, self.learn_words)):
            if len(own) > REMEMBERED:
                own.clear()
            learn(set(chain.from_iterable(c for c, k in zip(cut, known) if k is own)).difference(own))
        return [b"".join(map(k.__getitem__, c)) + last for c, k in zip(cut, known)]


def directions() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS))


def coordinates(ids: list[bytes], kind: str, axes: np.ndarray) -> np.ndarray:
    """Grid cells (documents x dimensions) of stored tokens."""
    vectors = np.zeros((len(ids), BUCKETS))
    for row, own in zip(vectors, ids):
        mixed = (np.frombuffer(own, dtype=kind).astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(22)  # the upper 10 bits: BUCKETS of them
        row += np.log1p(np.bincount(mixed, minlength=BUCKETS))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)  # never 0: every document has its end token
    x = vectors @ axes
    share = 0.5 * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))  # the normal distribution function, nearly
    return np.clip((share * (1 << STEPS)).astype(np.int64), 0, (1 << STEPS) - 1)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (rows x dimensions) on the Hilbert curve.

    From the highest bit down: an axis whose bit is set mirrors the lower bits of the first axis, one whose bit is not set
    exchanges them with the first axis, which turns each sub-cube as the curve runs through it; Gray code orders the rest.
    """
    x = cells.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        low = np.int64((1 << bit) - 1)
        for axis in range(len(x)):
            flips = (x[axis] >> bit) & 1 > 0
            change = np.where(flips, low, (x[0] ^ x[axis]) & low)
            x[0] ^= change
            x[axis] ^= np.where(flips, 0, change)
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1 > 0, np.int64((1 << bit) - 1), 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> bit) & 1)
    return key


def tokens(docs: DataFrame, vocabulary: str | None, end: int, text_col: str, id_col: str) -> tuple[DataFrame, str]:
    """(id, ids, n, key) of every document, and the type of a stored token."""
    with open(vocabulary or vocabulary_path(), "rb") as file:
        data = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)
    from tokenizers import Tokenizer

    kind = "<u2" if max(Tokenizer.from_buffer(data).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"

    @F.pandas_udf("struct<ids:binary,n:bigint,key:bigint>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, axes, width = Words(shared.value, kind), directions(), np.dtype(kind).itemsize
        for batch in batches:
            ids = words.ids(batch.tolist(), end)
            keys = [hilbert_keys(coordinates(ids[at : at + 256], kind, axes), STEPS) for at in range(0, len(ids), 256)]
            yield pd.DataFrame({"ids": ids, "n": [len(x) // width for x in ids], "key": np.concatenate([*keys, np.zeros(0, np.int64)])})

    rows = docs.select(F.col(id_col).alias("id"), encode(F.col(text_col).cast("binary")).alias("t"))
    return rows.select("id", "t.*"), kind


def tail_starts(total: int, length: int) -> list[int]:
    """Where sequences begin that are not at a multiple of ``length``: the end of the curve in powers of two."""
    at, out = total - total % length, []
    for bit in reversed(range(length.bit_length())):
        if (total % length) >> bit & 1:
            at += 1 << bit
            out.append(at)
    return out[:-1]


def pieces(kind: str, length: int, tail: list[int]) -> Column:
    """array<struct<sequence_id, offset, start, length, ids>> of a document with ``ids`` that begins at ``before`` on the curve."""

    @F.pandas_udf("array<struct<sequence_id:bigint,offset:bigint,start:bigint,length:bigint,ids:binary>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        steps = np.array(tail, dtype=np.int64)
        last = (tail[0] - tail[0] % length) if tail else 0
        for befores, batch in batches:
            out = []
            for before, data in zip(befores.tolist(), batch):
                ids = np.frombuffer(data, dtype=kind).astype("<u4")
                inner = np.arange(before - before % length + length, before + len(ids), length)
                more = steps[(steps > before) & (steps < before + len(ids))]
                bounds = np.unique(np.concatenate(([before], inner, more, [before + len(ids)])))
                begins = bounds[:-1]
                late = np.searchsorted(steps, begins, side="right")
                opened = np.where(late > 0, steps[np.maximum(late - 1, 0)] if len(steps) else 0, begins - begins % length)
                numbers = begins // length + late
                out.append([
                    {"sequence_id": int(s), "offset": int(a - o), "start": int(a - before), "length": int(b - a), "ids": ids[a - before : b - before].tobytes()}
                    for s, o, a, b in zip(numbers, opened, begins, bounds[1:])
                ])
            yield pd.Series(out)

    return cut(F.col("before"), F.col("ids"))


def pack(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = 4096, end: int = 2, vocabulary: str | None = None,
) -> DataFrame:
    """(id, doc_tokens, sequence_id, offset, start, length, ids): the pieces of all documents; ids as little-endian 32-bit numbers.

    Tokens are written once as they are counted and once in the order of the curve, which is also their one shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark, 4 << 20)  # a text in pieces is held several times over
    found, kind = tokens(docs, vocabulary, end, text_col, id_col)
    counted = materialize(found, "packing-tokens", "zstd").withColumn("row", F.monotonically_increasing_id())
    order = [F.col("key"), F.xxhash64("ids"), F.col("id"), F.col("row")]
    placed = running_total(counted, order, "n", "before", "packing-order", "zstd")
    total = placed.agg(F.sum("n")).first()[0] or 0
    cut = placed.select("id", F.col("n").alias("doc_tokens"), F.explode(pieces(kind, length, tail_starts(total, length))).alias("p"))
    return cut.select("id", "doc_tokens", "p.*")
