"""Near duplicates by SimHash: fingerprints within a few bits of each other are linked.

Fingerprint. Texts are cut into word shingles; each shingle's XXH64 votes on 64 bits, and a bit is set if over half the
shingles set it. Copies share a fingerprint, so everything after this works on distinct fingerprints.

Segment-popcount embedding. A fingerprint is cut into 32 segments of 2 bits and mapped to the vector of their bit counts.
The Manhattan distance of two such vectors never exceeds the number of differing bits. For links of up to d bits the 32
coordinates are dealt into 8 blocks; vectors within Manhattan distance d differ in at most d blocks, so they fall into one
cell of at least one grid that leaves d blocks out. With d = 2 there are 28 grids whose cells are keyed by the counts of the
other 24 segments. The range join is an equality join on the cell with both distances behind it, Manhattan first.

Crowded cells. Fingerprints that differ in a few bits only may crowd one cell, where pairs would grow with the square.
Cells of more than ``crowd`` fingerprints are not paired. Their members are linked through centres instead, which is linear
in the members and loses no link (see ``centre_edges``).

Similar texts. Two bits are a much narrower bound than a similarity of 0.8: pairs of texts that share 80 to 98 % of their
five-word shingles differ in 1 to 17 of 64 bits, and no bound on segment counts separates 17 bits from unrelated texts (half
the bits). Nor do two bits prove similarity: a shingle that makes over half of a text sets all bits alone. In ``keep_one``
fingerprints within two bits are therefore candidates only, and there is a second kind: every text also has sampled
fingerprints, each over the four shingles that are smallest under hashes of its own. Distinct texts with either in common are
compared by their whole shingle sets; they are linked if the share of common shingles is at least ``similarity``. A pair at
0.8 is missed with a probability of 0.2 %. In buckets of up to ``crowd`` texts all pairs are compared; texts of larger ones
are searched exactly by their rarest shingles (see ``rare_buckets`` and ``similar_classes``).

Defined results: null and empty texts have no word and fingerprint zero, linked like any other. A class id is the smallest
id in the class; rows without an id belong to classes but give them no id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.components import connected_components
from ..session import forget, materialize, merged, stored
from .common import row_hashes, small_batches, unused

BLOCKS = 8
#: shingles hashed before their votes are added up; bounds the memory of a very long text
VOTES = 1 << 15


#: sampled fingerprints of a text, and shingles in each
SAMPLES, DRAWN = 12, 4
#: multipliers and offsets of the hashes that draw them
DRAWS = np.random.default_rng(7).integers(1, 1 << 63, size=(2, SAMPLES * DRAWN), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes | None, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of UTF-8 bytes, in blocks. bytes.lower and bytes.split know ASCII only, which is what is wanted."""
    words = text.lower().split() if text else []
    if not words:
        return
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    stops, digest = ends[width - 1 :], xxhash.xxh64_intdigest
    for at in range(0, len(starts), VOTES):
        pairs = zip(starts[at : at + VOTES].tolist(), stops[at : at + VOTES].tolist())
        yield np.array([digest(joined[a:b], seed) for a, b in pairs], dtype="<u8")


def fingerprint_of(text: bytes | None, shingle: int, sampled: bool = False) -> tuple[int, list[int]]:
    """SimHash, and the sampled fingerprints if wanted (none for a text without words)."""
    votes, n = np.zeros(64, dtype=np.int64), 0
    least = np.full(SAMPLES * DRAWN, np.uint64(0xFFFFFFFFFFFFFFFF))
    for hashes in shingle_hashes(text, shingle):
        n += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        for at in range(0, len(hashes) if sampled else 0, 4096):
            drawn = hashes[None, at : at + 4096] * DRAWS[0][:, None] + DRAWS[1][:, None]
            least = np.minimum(least, (drawn ^ (drawn >> np.uint64(31))).min(axis=1))
    fp = int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])
    if not (sampled and n):
        return fp, []
    keys = np.zeros(SAMPLES, dtype=np.uint64)
    for part in least.reshape(SAMPLES, DRAWN).T:
        keys = (keys ^ part) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return fp, keys.view(np.int64).tolist()


def fingerprint(text: Column, shingle: int = 5) -> Column:
    """The 64-bit fingerprint as a signed long."""

    @F.pandas_udf("bigint")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = np.fromiter((fingerprint_of(t, shingle)[0] for t in batch), dtype=np.uint64, count=len(batch))
            yield pd.Series(found.view(np.int64))

    return simhash(text.cast("binary"))


def fingerprints(text: Column, shingle: int = 5) -> Column:
    """struct<fp, samples>: the fingerprint and the sampled fingerprints."""

    @F.pandas_udf("struct<fp:bigint,samples:array<bigint>>")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [fingerprint_of(t, shingle, True) for t in batch]
            fps = np.array([fp for fp, _ in found], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"fp": fps, "samples": [samples for _, samples in found]})

    return simhash(text.cast("binary"))


def shingle_set(text: Column, shingle: int = 5) -> Column:
    """The different shingles of a text as hashes."""

    @F.pandas_udf("array<bigint>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *shingle_hashes(t, shingle)])).view(np.int64) for t in batch])

    return hashes(text.cast("binary"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each kept in the segment's own two bits."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Sum of differences of two vectors of segment counts (each 0, 1 or 2).

    As unary codes (1 -> 01, 2 -> 11) the counts differ in as many bits as in value.
    """

    def unary(v: Column) -> Column:
        high = v.bitwiseAND(F.lit(-0x5555555555555556))  # 0xAAAA...: set where the count is 2
        return v.bitwiseOR(F.shiftrightunsigned(high, 1))

    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cells(fps: DataFrame, bits: int) -> DataFrame:
    """(fp, embedding, grid, cell): one row for each way to leave ``bits`` of the 8 blocks out."""
    width, masks = 64 // BLOCKS, []
    for out in combinations(range(BLOCKS), bits):
        mask = (1 << 64) - 1
        for block in out:
            mask &= ~(((1 << width) - 1) << (width * block))
        masks.append(signed(mask))
    grids = F.array(*[F.struct(F.lit(i).cast("short").alias("grid"), F.lit(m).alias("mask")) for i, m in enumerate(masks)])
    embedded = fps.select("fp", segment_counts(F.col("fp")).alias("embedding"))
    each = embedded.select("fp", "embedding", F.explode(grids).alias("g"))
    return each.select("fp", "embedding", F.col("g.grid").alias("grid"), F.col("embedding").bitwiseAND(F.col("g.mask")).alias("cell"))


def signed(value: int) -> int:
    """A 64-bit pattern as the long that has it."""
    return value - (1 << 64) if value >> 63 else value


def centres(fps: DataFrame, bits: int) -> DataFrame:
    """(fp, dst, pair, centre): fingerprints that share a centre, and the smallest of them, for distances of up to ``bits``, 1 or 2.

    For two bits a fingerprint names itself and its 64 neighbours at one bit. Fingerprints that name one centre are within
    1 + 1 bits, and two fingerprints within two bits have a centre in common: one of them, or a value between them. For
    one bit a fingerprint names the 64 pairs that it forms with a neighbour. Links of all that name one centre to the smallest
    of them connect exactly the fingerprints that such distances connect.
    """
    if bits == 2:
        masks = F.array(F.lit(0), *[F.lit(signed(1 << i)) for i in range(64)])
        named = fps.select("fp", F.lit(0).alias("pair"), F.explode(masks).alias("mask")).withColumn("centre", F.col("fp").bitwiseXOR(F.col("mask")))
    elif bits == 1:
        masks = F.array(*[F.lit(signed((1 << 64) - 1 - (1 << i))) for i in range(64)])
        named = fps.select("fp", F.posexplode(masks).alias("pair", "mask")).withColumn("centre", F.col("fp").bitwiseAND(F.col("mask")))
    else:
        raise ValueError("links are defined for one or two bits")
    least = named.groupBy("pair", "centre").agg(F.min("fp").alias("dst"), F.max("fp").alias("top")).where("dst < top").drop("top")
    return merged(named).join(least, ["pair", "centre"]).select("fp", "dst", "pair", "centre")


def close_pairs(fps: DataFrame, bits: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(src, dst) pairs of distinct fingerprints within ``bits`` bits of cells up to ``crowd``, and (fp) those in larger cells."""
    placed = cells(fps, bits)
    sized = placed.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(merged(placed).join(sized, ["grid", "cell"]), "simhash-cells")  # fingerprints that are alone in a cell are gone
    small = shared.where(F.col("n") <= crowd)
    a, b = small.alias("a"), small.alias("b")
    near = (
        (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
        & (manhattan(F.col("a.embedding"), F.col("b.embedding")) <= bits) & (hamming(F.col("a.fp"), F.col("b.fp")) <= bits)
    )
    pairs = merged(a).join(b, near).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    return pairs, shared.where(F.col("n") > crowd).select("fp").distinct()


def close_edges(fps: DataFrame, bits: int = 2, crowd: int = 64) -> DataFrame:
    """(src, dst) links between distinct fingerprints that differ in at most ``bits`` bits, enough to connect all of them."""
    pairs, crowded = close_pairs(fps, bits, crowd)
    return pairs.union(centres(crowded, bits).where("fp > dst").select(F.col("fp").alias("src"), "dst")).distinct()


def close_buckets(fps: DataFrame, bits: int = 2, crowd: int = 64) -> DataFrame:
    """(fp, sample, key): buckets, called samples below 0, in one of which any two fingerprints within ``bits`` bits meet.

    Every fingerprint has one of its own, where different texts with that fingerprint meet.
    """
    pairs, crowded = close_pairs(fps, bits, crowd)
    pair = pairs.distinct().select(F.explode(F.array("src", "dst")).alias("fp"), F.lit(-2).alias("sample"), F.xxhash64("src", "dst").alias("key"))
    centre = centres(crowded, bits).select("fp", F.lit(-3).alias("sample"), F.xxhash64("pair", "centre").alias("key"))
    return fps.select("fp", F.lit(-1).alias("sample"), F.col("fp").alias("key")).union(pair).union(centre)


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): the ``pairs`` (a, b) whose ``sets`` (node, size, hashes) of shingles have at least ``similarity`` in common."""
    one, other = (sets.select(F.col("node").alias(n), F.col("size").alias(f"{n}_size"), F.col("hashes").alias(f"{n}_hashes")) for n in "ab")
    both = pairs.join(one, "a").where("a_size > 0").join(other, "b")
    both = both.where(F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size") - 1e-6)
    common = F.size(F.array_intersect("a_hashes", "b_hashes"))
    return both.where(common >= similarity * (F.col("a_size") + F.col("b_size") - common) - 1e-6).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def rare_buckets(sets: DataFrame, similarity: float) -> DataFrame:
    """(sample, key, node, side): buckets in one of which any two ``sets`` (node, size, hashes) of at least ``similarity`` meet.

    Two such sets have at least s / (1 + s) of their sizes' sum in common. With the hashes of each set from the rarest to the
    most frequent, they share one among the first of either that go beyond what it may lack. How many these are depends on
    the other set's size, so there is a bucket for each hash and each pair of size classes (steps of 3 %). What only one set
    holds comes first and makes no bucket: texts of one template that each add an eighth of their own have none at all. In a
    bucket of two size classes only sets of different sides meet, those of the smaller (1) and of the larger class (2).
    """
    step = float(np.log(1.03))
    reach = int(np.ceil(-np.log(similarity) / step))
    each = sets.select("node", "size", F.explode("hashes").alias("hash"))
    held = each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    known = merged(each).join(held, "hash").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "hash"))).alias("known"))  # bounded by one text
    own = F.floor(F.log("size") / step).cast("int")
    classes = known.select("node", "size", "known", own.alias("own"), F.explode(F.sequence(own - reach, own + reach)).alias("other"))
    needed = F.ceil(similarity / (1 + similarity) * (F.col("size") + F.ceil(F.exp(F.col("other") * step) - 1e-6)) - 1e-6)
    first = (F.col("size") - needed + 1 - (F.col("size") - F.size("known"))).cast("int")
    met = classes.withColumn("first", first).where("first > 0").select("node", "own", "other", F.explode(F.slice("known", F.lit(1), F.col("first"))).alias("k"))
    pair = F.least("own", "other").cast("long") * (1 << 20) + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    rows = met.select(F.lit(-4).alias("sample"), F.xxhash64(F.col("k.hash"), pair).alias("key"), "node", side.alias("side"))
    sides = rows.groupBy("sample", "key").agg(F.count("*").alias("n"), F.min("side").alias("one"), F.max("side").alias("other"))
    return merged(rows).join(sides.where("n > 1 AND (other = 0 OR one < other)").select("sample", "key"), ["sample", "key"])


def classes_of(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that ``edges`` link."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return connected_components(nodes, edges).select(F.col("id").alias("node"), "component")


def unsettled(buckets: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """``buckets`` (sample, key, node, side) that hold more than one class, with n, met (other members of a node's buckets) and component."""
    at = ["sample", "key"]
    placed = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy(*at).agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = placed.join(split.where("low < high").select(*at, "n"), at)
    return stored(mixed.join(mixed.groupBy("node").agg(F.sum("n").alias("met")), "node"), "simhash-unsettled")


def pivoted(members: DataFrame, wide: int, crowd: int) -> DataFrame:
    """(a, b): ``wide`` pivots of each bucket, those that meet most others, with its members of other classes; all pairs of small buckets."""
    at = ["sample", "key"]
    slot = F.when(F.col("n") <= crowd, F.col("node")).otherwise(F.pmod(F.xxhash64("node", F.lit(wide)), F.lit(wide)))
    best = members.groupBy(*at, slot.alias("slot")).agg(F.max_by(F.struct("node", "component", "side"), F.struct("met", F.xxhash64("node"))).alias("p"))
    pivots = best.select(*at, F.col("p.node").alias("b"), F.col("p.component").alias("of"), F.col("p.side").alias("from"))
    met = members.join(pivots, at).where((F.col("component") != F.col("of")) & ((F.col("side") == 0) | (F.col("side") != F.col("from"))))
    return met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def similar_classes(buckets: DataFrame, sets: DataFrame, similarity: float, crowd: int = 64) -> DataFrame:
    """(node, component) of the nodes that are linked: those of one bucket (sample, key, node) whose ``sets`` are similar.

    All pairs of buckets of up to ``crowd`` nodes are compared, and all members of larger ones with one pivot. Then all sets
    are searched exactly by ``rare_buckets``, in rounds of pivots of which each takes sixteen times as many as the last, until
    every bucket is one class or has been compared whole. Sets of a crowd that each add an eighth or more of their own meet in
    no rare bucket, so their pairs are never made; sets without a common original that share a little more than that, but less
    than ``similarity``, are still compared pair by pair.
    """
    spark, at = buckets.sparkSession, ["sample", "key"]
    sized = buckets.groupBy(*at).agg(F.count("*").alias("n"))
    small, crowded = (buckets.join(sized.where(c), at) for c in (f"n <= {crowd}", f"n > {crowd}"))
    x, y = small.alias("x"), small.alias("y")
    same = (F.col("x.sample") == F.col("y.sample")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node"))
    pairs = x.join(y, same).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    central = crowded.groupBy("node").agg(F.sum("n").alias("met"))
    members = crowded.join(central, "node").withColumn("component", F.col("node")).withColumn("side", F.lit(0))
    first, first_path = stored(pairs.union(pivoted(members, 1, 0)).distinct(), "simhash-pairs")
    edges, path = stored(compared(first, sets, similarity), "simhash-edges")
    forget(spark, first_path)
    labels = classes_of(edges)
    left, left_path = stored(rare_buckets(sets, similarity), "simhash-rare")
    wide = 1
    while True:
        members, members_path = unsettled(left, labels)
        forget(spark, left_path)
        if members.isEmpty():
            forget(spark, members_path)
            return labels
        pairs, pairs_path = stored(pivoted(members, wide, crowd), "simhash-pairs")
        before = path
        edges, path = stored(edges.union(compared(pairs, sets, similarity)), "simhash-edges")
        for gone in (before, pairs_path):
            forget(spark, gone)
        labels = classes_of(edges)
        left, left_path = members.where(F.col("n") > max(crowd, wide)).select(*at, "node", "side"), members_path  # buckets compared whole are done
        wide *= 16


def classified(prints: DataFrame, id_col: str, bits: int, crowd: int) -> DataFrame:
    """``prints`` (with fp) and the class of each row: ``component``, its smallest fingerprint, and ``component_id``."""
    distinct = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    edges = materialize(close_edges(distinct.select("fp"), bits, crowd), "simhash-edges")
    linked = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    labels = connected_components(linked, edges).select(F.col("id").alias("fp"), "component")
    grouped = distinct.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(grouped.select("fp", "component").join(roots, "component"), "fp")


def near_duplicates(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, bits: int = 2, crowd: int = 64
) -> DataFrame:
    """(id, fp, component, component_id) for every row: its fingerprint, the smallest fingerprint and the smallest id of its class.

    Fingerprints are written to the shared folder once; links and classes follow from that narrow table.
    """
    small_batches(df.sparkSession)
    prints = df.select(F.col(id_col), fingerprint(F.col(text_col), shingle).alias("fp"))
    return classified(materialize(prints, "simhash-prints"), id_col, bits, crowd)


def keep_one(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, bits: int = 2, crowd: int = 64, similarity: float = 0.8
) -> DataFrame:
    """``df`` without near copies: of each class the row with the smallest id stays; a row without an id only if none has one.

    Classes join texts whose shingle sets have at least ``similarity`` in common, and texts without words. Rows are
    told apart by two hashes over all columns; of rows equal in every column one stays.
    """
    small_batches(df.sparkSession)
    key = unused(df, "_row_a", "_row_b")
    marked = df.withColumns(dict(zip(key, row_hashes(df))))
    row = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col(key[0]).alias("a"), F.col(key[1]).alias("b"))
    text, same = F.col(text_col), ["one", "two", "size"]
    prints = marked.select(
        row.alias("row"), F.xxhash64(F.lit(1), text).alias("one"), F.xxhash64(F.lit(2), text).alias("two"), F.octet_length(text).alias("size"),
        fingerprints(text, shingle).alias("f"),
    )
    prints = materialize(prints.select("row", *same, "f.*"), "simhash-prints")
    wordless = F.size("samples") == 0
    prints = prints.withColumns({c: F.when(wordless, 0).otherwise(F.col(c)) for c in same})
    first = prints.groupBy(*same).agg(F.min(F.struct("row", "fp", "samples")).alias("m")).select(F.monotonically_increasing_id().alias("node"), "m.*")
    first = materialize(first, "simhash-nodes")  # numbers hold because they are stored
    buckets = first.select(F.posexplode("samples").alias("sample", "key"), "node")
    close = close_buckets(first.select("fp").distinct(), bits, crowd)
    buckets = buckets.union(first.where(~wordless).join(close, "fp").select("sample", "key", "node"))
    shared = buckets.groupBy("sample", "key").agg(F.count("*").alias("n")).where("n > 1").select("sample", "key")
    buckets = materialize(merged(buckets).join(shared, ["sample", "key"]), "simhash-buckets")
    wanted = first.join(buckets.select("node").distinct(), "node").select("node", F.col("row.a").alias("a"), F.col("row.b").alias("b"))
    texts = marked.select(F.col(key[0]).alias("a"), F.col(key[1]).alias("b"), F.col(text_col).alias("text")).join(wanted, ["a", "b"])
    sets = texts.select("node", shingle_set(F.col("text"), shingle).alias("hashes")).select("node", F.size("hashes").alias("size"), "hashes")
    sets = materialize(sets.dropDuplicates(["node"]), "simhash-sets")
    labels = similar_classes(buckets, sets, similarity, crowd)
    grouped = first.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = grouped.groupBy("component").agg(F.min("row").alias("row")).select(F.col("row.a").alias(key[0]), F.col("row.b").alias(key[1]))
    return marked.join(kept, key, "left_semi").dropDuplicates(key).select(*[F.col(f"`{c}`") for c in df.columns])
