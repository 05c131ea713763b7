"""Ranked lexical search: the best documents for each of a set of items, by dense products of weight and impact tiles.

An item's score for a document is the sum of weight times impact over the item's terms. The items of a block have a compact
vocabulary of their own; a tile is up to ``TERMS`` of its columns. For each tile a matrix of item weights (items x terms)
meets a matrix of impacts (terms x documents of a tile of documents) in one matrix product of doubles.

Exact sums. An impact is below 10^6. A column holds weights of at most ``HEAVIEST``; a larger weight is dealt to several
columns of the same term. So no partial sum of a product passes 2^53, doubles add without error in any order, and the sums
of tiles are added as integers.

Best documents. A task keeps the best k documents of every item over all its tiles: of equal scores at the k-th place those
with the smallest ids, so what is left at the end does not depend on how documents were dealt to tiles and tasks. Only k rows
an item leave a task; they are ranked in two steps, so that no item's rows of all tasks meet in one.

Documents are read twice for each pass of items: to count (documents, terms, documents of each item term; every task adds up
its own first) and to score. A pass takes items up to ``PASS_BYTES`` of text, or one item, which bounds what reaches the
driver and the tasks; few items need one pass.

Defined results: a null text has no term. Every row is a document and every item row an item of its own, ids repeated or
null included; documents without an id come last among equal scores. Items without terms, and those that no document scores
for, have no row.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialize
from .common import row_hashes, running_total, small_batches

#: what separates terms becomes a space, A-Z become lower case
TABLE = bytes(ord(chr(c).lower()) if chr(c) in string.ascii_letters + string.digits else 32 for c in range(128)) + bytes(range(128, 256))
PASS_BYTES = 4 << 20
#: documents, items and vocabulary columns of a tile
DOCUMENTS, ITEMS, TERMS = 512, 512, 2048
#: an impact is smaller than this
IMPACT = 1_000_000
HEAVIEST = (1 << 53) // (IMPACT * TERMS)


def terms(text: bytes | None) -> list[bytes]:
    """The maximal runs of letters, digits and characters beyond ASCII of UTF-8 bytes, A-Z lower-cased."""
    return text.translate(TABLE).split() if text else []


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Block:
    """Items with a compact vocabulary of their own, as sparse weights (item, column, weight)."""

    def __init__(self, items: list[Counter], first: int, vocabulary: dict[bytes, int], weights: np.ndarray):
        self.first, self.size = first, len(items)
        entries = [(i, vocabulary[t], n * int(weights[vocabulary[t]])) for i, own in enumerate(items) for t, n in own.items()]
        parts = [(i, t, k, min(w - k * HEAVIEST, HEAVIEST)) for i, t, w in entries for k in range(-(-w // HEAVIEST))]
        number = {c: k for k, c in enumerate(sorted({(t, k) for _, t, k, _ in parts}))}
        self.term = np.array([t for t, _ in number], dtype=np.int64)
        self.item = np.array([i for i, _, _, _ in parts], dtype=np.int64)
        self.column = np.array([number[t, k] for _, t, k, _ in parts], dtype=np.int64)
        self.weight = np.array([w for *_, w in parts], dtype=np.float64)

    def scores(self, document: np.ndarray, term: np.ndarray, impact: np.ndarray, documents: int) -> np.ndarray:
        """(items, documents) scores from the sparse impacts of a tile of documents, sorted by term."""
        total = np.zeros((self.size, documents), dtype=np.int64)
        for low in range(0, len(self.term), TERMS):
            columns = self.term[low : low + TERMS]
            begin, end = np.searchsorted(term, columns), np.searchsorted(term, columns, side="right")
            held = end - begin
            if not held.any():
                continue
            row = np.repeat(np.arange(len(columns)), held)
            at = np.arange(len(row)) + np.repeat(begin - np.concatenate(([0], np.cumsum(held)[:-1])), held)
            impacts = np.zeros((len(columns), documents))
            impacts[row, document[at]] = impact[at]
            own = (self.column >= low) & (self.column < low + TERMS)
            weights = np.zeros((self.size, len(columns)))
            weights[self.item[own], self.column[own] - low] = self.weight[own]
            total += (weights @ impacts).astype(np.int64)
        return total


class Best:
    """The best documents of each item so far, as rows (item, score, no id, id) in order."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items, dtype=np.int64)
        self.rows = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool, np.int64)]

    def add(self, scores: np.ndarray, first: int, nameless: np.ndarray, ids: np.ndarray) -> None:
        least = self.least[first : first + len(scores)]
        item, at = np.nonzero((scores > 0) & (scores >= least[:, None]))
        if not len(item):
            return
        new = (item + first, scores[item, at], nameless[at], ids[at])
        item, score, none, own = (np.concatenate(pair) for pair in zip(self.rows, new))
        order = np.lexsort((own, none, -score, item))
        ordered = item[order]
        place = np.arange(len(order)) - np.searchsorted(ordered, ordered)
        self.rows = [x[order[place < self.k]] for x in (item, score, none, own)]
        last = order[place == self.k - 1]
        self.least[item[last]] = score[last]


def tiles(batches: Iterator[pd.DataFrame], vocabulary: dict[bytes, int]):
    """Tiles of documents: ids, numbers of terms, and (document, term, occurrences) of the terms of the vocabulary by term."""
    for batch in batches:
        for at in range(0, len(batch), DOCUMENTS):
            part = batch.iloc[at : at + DOCUMENTS]
            found, sizes = [], []
            for text in part["text"]:
                words = terms(text)
                sizes.append(len(words))
                found.append(np.fromiter(map(vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words)))
            document, term = np.repeat(np.arange(len(part)), sizes), np.concatenate(found)
            keys, times = np.unique((term * DOCUMENTS + document)[term >= 0], return_counts=True)
            yield part["id"], np.array(sizes, dtype=np.int64), keys % DOCUMENTS, keys // DOCUMENTS, times


def counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the documents that hold each term of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, some, total = np.zeros(len(shared.value) + 1, dtype=np.int64), 0, 0
        for _, sizes, _, term, _ in tiles(batches, shared.value):
            held += np.bincount(term, minlength=len(held))
            some, total = some + int((sizes > 0).sum()), total + int(sizes.sum())
        at = np.flatnonzero(held)
        yield pd.DataFrame({"term": [-2, -1, *at.tolist()], "n": [some, total, *held[at].tolist()]})

    rows = docs.mapInPandas(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(t, 0) for t in range(len(vocabulary))], dtype=np.int64)


def best_of_tasks(docs: DataFrame, items: list[bytes], rows: list[int], k: int) -> DataFrame:
    """(row, id, score, part): the best ``k`` documents of each item, named by its row number, in every task."""
    bags = [Counter(terms(text)) for text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*bags)))}
    documents, total, holding = counts(docs, vocabulary)
    weights = np.array([term_weight(documents, int(n)) for n in holding], dtype=np.int64)
    blocks = [Block(bags[at : at + ITEMS], at, vocabulary, weights) for at in range(0, len(bags), ITEMS)]
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, blocks, np.array(rows, dtype=np.int64)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, parts, numbers = shared.value
        best = Best(sum(b.size for b in parts), k)
        for ids, sizes, document, term, times in tiles(batches, own):
            m = 25 + 75 * sizes * documents // max(total, 1)
            impact = (1_000_000_000 * times) // (1000 * times + 8 * m[document])
            nameless = ids.isna().to_numpy()
            named = ids.fillna(0).to_numpy().astype(np.int64)
            for b in parts:
                best.add(b.scores(document, term, impact, len(ids)), b.first, nameless, named)
        item, points, none, ids = best.rows
        yield pd.DataFrame({"row": numbers[item], "id": pd.Series(ids, dtype="Int64").mask(none), "score": points})

    return docs.mapInPandas(score, "row bigint, id bigint, score bigint").withColumn("part", F.spark_partition_id())


def top_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(item, rank, id, score): the ``k`` documents with the highest scores above 0 for each row of ``items``; ids are integers."""
    spark = docs.sparkSession
    small_batches(spark)
    one, two = row_hashes(items)
    text = F.coalesce(F.col(item_text), F.lit(""))
    wanted = items.select(F.col(item_col).alias("item"), text.alias("text"), F.octet_length(text).cast("long").alias("size"), one.alias("a"), two.alias("b"))
    placed = running_total(wanted, ["a", "b"], "size", "before", "search-items")
    placed = placed.select("item", "text", F.expr(f"before div {pass_bytes}").alias("pass"), F.monotonically_increasing_id().alias("row"))
    placed = materialize(placed, "search-passes")  # row numbers hold because they are stored
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = spark.createDataFrame([], "row bigint, id bigint, score bigint, part int")
    for r in placed.select("pass").distinct().orderBy("pass").toLocalIterator():
        own = placed.where(F.col("pass") == r["pass"]).select("row", "text").orderBy("row").collect()
        best = best_of_tasks(rows, [x.text.encode() for x in own], [x.row for x in own], k)
        found = found.union(materialize(best, "search-best"))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    near = found.withColumn("place", F.row_number().over(W.partitionBy("row", F.col("part") % 64).orderBy(*order))).where(F.col("place") <= k)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(placed.select("row", "item"), "row").select("item", "rank", "id", "score")
