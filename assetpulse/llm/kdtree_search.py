"""Exact top-k search by inner product with KD-trees per shard.

Vectors become integers, floor(scale * x). Shards follow the same median splits as the trees: a bounded sample is split on
the coordinate of widest range until there are as many cells as wanted, every vector goes to its cell, and cells above the
size of a shard are dealt over several by a hash of the id, so no shard grows with the data. In a shard a KD-tree splits at
medians down to leaves of some rows; every node has the tight bounding box of its rows. The largest inner product of a query
with any point of a box is the sum over coordinates of the larger product with the box's two ends, which bounds every row in
it. A tree is searched best first, and a node whose bound is below the k-th score so far is left out together with all that
would follow; one that equals it is visited, because ties go to the smaller id.

A query first visits one shard, that of its own cell. The k-th score found there is carried to all others: a shard is
visited only if its box can reach that score, and within it the search starts from it. Vectors and queries of a shard meet
in one sorted partition, in which the vectors come first and build the tree and the queries then pass by in batches, so
memory is bounded by the shard and not by the number of queries.

Defined results: rows whose id or vector is null, or whose vector holds a null or a non-finite value, take no part. A query
is compared with vectors of its own length only. Repeated rows (equal id and vector) count once. Rows with the query's id
are its own. If a query's id comes with several vectors, the smallest is the query. Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

LEAF = 64
#: rows of the sample that places the cells
SAMPLE = 20_000
#: shards at most; boxes of all of them reach every task that routes queries
MOST_SHARDS = 4096
LOWEST = -(1 << 62)


def integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as a double; null if any component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


def cells_of(rows: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """Splits (coordinate, cut, left child) of a tree over the rows with up to ``parts`` leaves; a leaf has coordinate -1.

    Children of a node are neighbours. Rows with x[coordinate] < cut go left.
    """
    nodes: list[tuple[int, int, int]] = [(-1, 0, 0)]
    heap = [(-len(rows), 0, 0, rows)]
    leaves = 1
    while heap and leaves < parts:
        _, node, _, part = heapq.heappop(heap)
        if len(part) < 2 or part.shape[1] == 0:
            continue
        spread = part.max(axis=0) - part.min(axis=0)
        axis = int(spread.argmax())
        if not spread[axis]:
            continue
        cut = int(np.sort(part[:, axis])[len(part) // 2])
        if cut == part[:, axis].min():
            cut += 1
        left = part[:, axis] < cut
        nodes[node] = (axis, cut, len(nodes))
        for side in (part[left], part[~left]):
            heapq.heappush(heap, (-len(side), len(nodes), len(nodes), side))
            nodes.append((-1, 0, 0))
        leaves += 1
    return nodes


def cell_numbers(rows: np.ndarray, nodes: list[tuple[int, int, int]]) -> np.ndarray:
    axis, cut, left = (np.array(c, dtype=np.int64) for c in zip(*nodes))
    at = np.zeros(len(rows), dtype=np.int64)
    inner = np.flatnonzero(axis[at] >= 0)
    while len(inner):
        n = at[inner]
        at[inner] = left[n] + (rows[inner, axis[n]] >= cut[n])
        inner = inner[axis[at[inner]] >= 0]
    return at


class Tree:
    """KD-tree over integer rows; node boxes are tight."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.arange(len(rows))
        self.first, self.last, self.left, lows, highs = [], [], [], [], []
        self.first.append(0), self.last.append(len(rows)), self.left.append(-1)
        node = 0
        while node < len(self.first):
            a, b = self.first[node], self.last[node]
            part = rows[order[a:b]]
            low, high = part.min(axis=0), part.max(axis=0)
            lows.append(low), highs.append(high)
            spread = high - low
            if b - a > LEAF and spread.size and spread.max() > 0:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, int(spread.argmax())], middle)]
                self.left[node] = len(self.first)
                for x, y in ((a, a + middle), (a + middle, b)):
                    self.first.append(x), self.last.append(y), self.left.append(-1)
            node += 1
        self.lows, self.highs = np.array(lows), np.array(highs)
        self.ids, self.rows = ids[order], rows[order]

    def search(self, query: np.ndarray, own: int, k: int, least: int) -> list[tuple[int, int]]:
        """Up to k (score, id) of at least ``least``, best first, ties to the smaller id; rows with id ``own`` are left out."""
        positive = query > 0
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst of the k best on top
        bound = lambda n: int(np.where(positive, self.highs[n], self.lows[n]) @ query)
        queue = [(-bound(0), 0)]
        while queue:
            top, node = heapq.heappop(queue)
            if -top < (best[0][0] if len(best) == k else least):
                break
            left = self.left[node]
            if left >= 0:
                for child in (left, left + 1):
                    heapq.heappush(queue, (-bound(child), child))
                continue
            a, b = self.first[node], self.last[node]
            scores = self.rows[a:b] @ query
            near = np.flatnonzero(scores >= (best[0][0] if len(best) == k else least))
            for i in near.tolist():
                name = int(self.ids[a + i])
                if name != own:
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (int(scores[i]), -name))
        return sorted(((s, -n) for s, n in best), key=lambda x: (-x[0], x[1]))


ROW = "shard bigint, is_query boolean, id bigint, vec array<bigint>, least bigint"
HIT = "query_id bigint, id bigint, score bigint"


def searched(rows: DataFrame, k: int, partitions: int) -> DataFrame:
    """(query_id, id, score): the best hits of each query in each shard it visits. ``rows`` are as in ROW."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, ids, vectors, tree, out = None, [], [], None, []
        for batch in batches:
            for s, is_query, name, vec, least in zip(batch["shard"], batch["is_query"], batch["id"], batch["vec"], batch["least"]):
                if s != shard:
                    shard, ids, vectors, tree = s, [], [], None
                if not is_query:
                    ids.append(name)
                    vectors.append(np.asarray(vec, dtype=np.int64))
                    continue
                if not vectors and tree is None:
                    continue  # a query alone in a shard
                if tree is None:
                    both = np.column_stack([np.array(ids, dtype=np.int64), np.array(vectors, dtype=np.int64).reshape(len(ids), -1)])
                    both = np.unique(both, axis=0)
                    tree, ids, vectors = Tree(both[:, 0], both[:, 1:]), [], []
                out += [(name, n, score) for score, n in tree.search(np.asarray(vec, dtype=np.int64), name, k, least)]
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["query_id", "id", "score"])
                out = []
        yield pd.DataFrame(out, columns=["query_id", "id", "score"]).astype("int64")

    met = rows.repartition(partitions, "shard").sortWithinPartitions("shard", "is_query")
    return met.mapInPandas(visit, HIT)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, shard_rows: int = 8192
) -> DataFrame:
    """(query_id, rank, id, score): the k largest inner products of each query row with all other rows, ties to the smaller id."""
    spark = vectors.sparkSession
    whole = vectors.select(F.col(id_col).cast("bigint").alias("id"), integers(F.col(vec_col), scale).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    whole = materialize(whole.where("id IS NOT NULL AND vec IS NOT NULL"), "knn-vectors")
    sizes = {r.dim: r.n for r in whole.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}  # one row a length
    count = sum(sizes.values())
    if not count:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    rows_each = max(shard_rows, -(-count // (MOST_SHARDS // 2)))
    # cells from a bounded sample, for each vector length
    chance = min(1.0, SAMPLE / count)
    drawn = whole.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(chance * (1 << 20)) + 1)).select("vec").limit(2 * SAMPLE).toPandas()["vec"]
    grids = {}
    for dim, n in sizes.items():
        sample = [np.asarray(v, dtype=np.int64) for v in drawn if len(v) == dim]
        grids[dim] = cells_of(np.array(sample, dtype=np.int64).reshape(len(sample), dim), max(1, -(-n // rows_each))) if sample else [(-1, 0, 0)]
    bases = dict(zip(sorted(grids), np.cumsum([0] + [len(grids[d]) for d in sorted(grids)]).tolist()))

    @F.pandas_udf("bigint")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.int64)
            lengths = batch.map(len).to_numpy()
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                part = np.array([np.asarray(v, dtype=np.int64) for v in batch.iloc[at]], dtype=np.int64).reshape(len(at), dim)
                out[at] = bases[int(dim)] + cell_numbers(part, grids[int(dim)])
            yield pd.Series(out)

    placed = materialize(whole.withColumn("cell", cell("vec")), "knn-placed")
    # cells above the size of a shard are dealt over several
    held = placed.groupBy("cell").agg(F.count("*").alias("n"), F.first(F.size("vec")).alias("dim")).collect()  # at most as many as cells
    salts = {r.cell: -(-r.n // (2 * rows_each)) for r in held}
    number, starts = 0, {}
    for c in sorted(salts):
        starts[c], number = number, number + salts[c]
    deal = F.array(*[F.struct(F.lit(starts.get(c, 0)).alias("start"), F.lit(salts.get(c, 1)).alias("n")) for c in range(max(salts) + 1)])
    deal = F.get(deal, F.col("cell").cast("int"))
    sharded = placed.select("id", "vec", "is_query", (deal["start"] + F.pmod(F.xxhash64("id"), deal["n"].cast("bigint"))).alias("shard"))
    partitions = min(number, 4 * spark.sparkContext.defaultParallelism) if number < MOST_SHARDS else number
    partitions = max(partitions, 1)
    # tight boxes of the shards
    ends = sharded.select("shard", F.size("vec").alias("dim"), F.posexplode("vec").alias("axis", "x")).groupBy("shard", "dim", "axis").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    boxes = ends.groupBy("shard", "dim").agg(F.sort_array(F.collect_list(F.struct("axis", "low", "high"))).alias("b")).collect()  # at most MOST_SHARDS
    queries = sharded.where("is_query").groupBy("id").agg(F.min(F.struct("vec", "shard")).alias("q")).select("id", "q.*")
    queries = materialize(queries, "knn-queries")
    stored = sharded.select("shard", F.lit(False).alias("is_query"), "id", "vec", F.lit(LOWEST).alias("least"))
    home = queries.select("shard", F.lit(True).alias("is_query"), "id", "vec", F.lit(LOWEST).alias("least"))
    first = materialize(searched(stored.union(home), k, partitions), "knn-home")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    reached = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    by_dim: dict[int, tuple] = {}
    for r in boxes:
        by_dim.setdefault(r.dim, ([], [], []))
        names, lows, highs = by_dim[r.dim]
        names.append(r.shard), lows.append([x.low for x in r.b]), highs.append([x.high for x in r.b])
    shared = spark.sparkContext.broadcast({d: tuple(np.array(x, dtype=np.int64) for x in t) for d, t in by_dim.items()})

    @F.pandas_udf("array<bigint>")
    def others(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vecs, least, own in batches:
            out = []
            for v, l, s in zip(vecs, least, own):
                q = np.asarray(v, dtype=np.int64)
                names, lows, highs = shared.value.get(len(q), (np.zeros(0, dtype=np.int64),) * 3)
                bound = np.where(q > 0, highs, lows) @ q if len(names) else np.zeros(0)
                out.append(names[(bound >= l) & (names != s)].tolist())
            yield pd.Series(out)

    carried = queries.join(reached, "id", "left").withColumn("least", F.coalesce("least", F.lit(LOWEST)))
    visits = carried.select(F.explode(others("vec", "least", "shard")).alias("shard"), F.lit(True).alias("is_query"), "id", "vec", "least")
    second = searched(stored.union(visits), k, partitions)
    ranked = first.union(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
