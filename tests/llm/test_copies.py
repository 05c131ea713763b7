"""SimHash near duplicates and benchmark decontamination next to brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assetpulse.llm import decontaminate, simhash
from assetpulse.llm.common import row_hashes
from assetpulse.session import materialize

from .util import corpus, empty, frame, words


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles_of(text, n):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
    n = min(n, len(w))
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if w else []


def plain_fingerprint(text, n):
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles_of(text, n)], dtype=np.uint64)
    return sum(1 << b for b in range(64) if int((h >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(h))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def near_values():
    """Distinct 64-bit values: chains of one and two bit steps, a crowded cell, and strangers."""
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(100)}
    for _ in range(6):
        v = rng.getrandbits(64)
        for _ in range(10):
            values.add(v)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                v ^= 1 << b
    base = rng.getrandbits(64)
    for _ in range(120):
        v = base
        for b in rng.sample(range(16), rng.randint(0, 5)):
            v ^= 1 << b
        values.add(v)
    return sorted(values)


@pytest.mark.parametrize("bits, crowd", [(2, 64), (2, 4), (1, 4)])
def test_links_connect_what_is_close(spark, near_values, bits, crowd):
    fps = spark.createDataFrame([(simhash.signed(v),) for v in near_values], "fp bigint")
    edges = [(r.src % 2**64, r.dst % 2**64) for r in simhash.close_edges(fps, bits, crowd).collect()]
    assert all((a ^ b).bit_count() <= bits for a, b in edges)
    pairs = [(a, b) for i, a in enumerate(near_values) for b in near_values[:i] if (a ^ b).bit_count() <= bits]
    assert components(near_values, edges) == components(near_values, pairs)
    if (bits, crowd) == (2, 4):
        assert len(edges) < len(pairs)


def first_plans(monkeypatch):
    """The plans, before any size is measured, of the tables that simhash stores from here on."""
    plans = []

    def kept(store):
        return lambda df, *args: (plans.append(df._jdf.queryExecution().executedPlan().toString()), store(df, *args))[1]

    for name in ("materialize", "stored"):
        monkeypatch.setattr(simhash, name, kept(getattr(simhash, name)))
    return plans


def test_exploded_cells_are_not_broadcast_by_a_guess(spark, near_values, monkeypatch):
    """Spark takes 28 cells of a fingerprint for one row; a join on them must not collect them in the driver."""
    fps = materialize(spark.createDataFrame([(simhash.signed(v),) for v in near_values], "fp bigint"), "test-fps")
    plans = first_plans(monkeypatch)
    pairs, crowded = simhash.close_pairs(fps, 2, 4)
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (pairs, simhash.centres(crowded, 2))]
    assert sum("Join" in p for p in plans) == 3
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_exploded_samples_and_hashes_are_not_broadcast_by_a_guess(spark, monkeypatch):
    rng = random.Random(4)
    texts = [words(rng, "en", 40) for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts + texts[:5])]
    plans = first_plans(monkeypatch)
    simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    exploded = [p for p in plans if "Generate explode" in p or "Generate posexplode" in p]
    assert len(exploded) >= 3
    for plan in exploded:
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                at = line.index("BroadcastExchange")
                below = []
                for x in lines[i + 1 :]:  # what stands deeper in the tree
                    if len(x) - len(x.lstrip(" :+-")) <= at:
                        break
                    below.append(x)
                assert not [x for x in below if "Generate" in x], plan


def test_manhattan_of_segment_counts_bounds_distance(spark):
    rng = random.Random(5)
    rows = [(simhash.signed(rng.getrandbits(64)), simhash.signed(rng.getrandbits(64))) for _ in range(200)] + [(-1, 0), (0, 0)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", simhash.manhattan(simhash.segment_counts(a), simhash.segment_counts(b)).alias("m")).collect():
        x, y = r.a % 2**64, r.b % 2**64
        assert r.m == sum(abs((x >> i & 3).bit_count() - (y >> i & 3).bit_count()) for i in range(0, 64, 2)) <= (x ^ y).bit_count()


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    got = simhash.near_duplicates(frame(spark, rows, clash=False), shingle=3).collect()
    assert len(got) == len(rows)
    fps = {plain_fingerprint(t, 3) for _, t, *_ in rows}
    of = components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            c = of[plain_fingerprint(t, 3)]
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, plain_fingerprint(t, 3), least.get(of[plain_fingerprint(t, 3)])) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_keep_one_of_similar_texts(spark):
    rng = random.Random(9)
    base = words(rng, "en", 300)
    rows = []
    for i in range(40):  # copies of one original, most of them less similar to each other than to it
        w = list(base)
        for j in rng.sample(range(300), 5 if i else 0):
            w[j] = w[j] + "x"
        rows.append((100 + i, " ".join(w), "en", "s", 1))
    rows += corpus()
    df = frame(spark, rows)
    got = simhash.keep_one(df, crowd=8)
    assert got.columns == df.columns
    sets = [frozenset(shingles_of(t, 5)) for _, t, *_ in rows]
    links = [(i, j) for j in range(len(rows)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * max(1, len(sets[i] | sets[j])) or sets[i] == sets[j]]
    group = components(range(len(rows)), links)
    want = {}
    for k, (i, *_) in enumerate(rows):
        want.setdefault(group[k], []).append((i is None, i))
    assert sorted(((r.doc_id is None, r.doc_id) for r in got.collect()), key=str) == sorted((min(v, key=lambda x: (x[0], x[1] or 0)) for v in want.values()), key=str)
    assert simhash.keep_one(empty(spark)).count() == 0


def changed(rng, text, n):
    """``text`` with n words replaced, none within five words of another or of an end."""
    while True:
        at = sorted(rng.sample(range(5, len(text) - 5), n))
        if all(b - a > 5 for a, b in zip(at, at[1:])):
            return [f"{w}{rng.getrandbits(32)}" if i in at else w for i, w in enumerate(text)]


def kept_ids(spark, texts, **options):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string").repartition(8)
    return sorted(r.doc_id for r in simhash.keep_one(df, **options).collect())


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(13)
    base, form = words(rng, "en", 200), words(rng, "de", 200)
    copies = [base] + [changed(rng, base, 3) for _ in range(2000)]  # 0.86 to the original, about 0.75 to each other
    family = [changed(rng, form, 4) for _ in range(150)]  # about 0.66 to each other
    family += [changed(rng, w, 1) for w in family[:10]]
    sets = [frozenset(shingles_of(" ".join(w), 5)) for w in family]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(links) >= 10
    got = set(kept_ids(spark, copies + family))
    assert {i for i in got if i <= 2000} == {0}
    assert not [(i, j) for i, j in links if {2001 + i, 2001 + j} <= got]


def sets_of(spark, texts):
    """The table of shingle sets of texts, nodes numbered, through the operator's own expression."""
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "node bigint, text string").repartition(8)
    sets = rows.select("node", simhash.shingle_set(F.col("text")).alias("hashes"))
    return materialize(sets.select("node", F.size("hashes").alias("size"), "hashes"), "test-sets")


@pytest.mark.parametrize("edits", [5, 8])
def test_templates_below_the_similarity_make_no_pairs(spark, monkeypatch, edits):
    """2,000 texts of one template with an eighth or more of their own: one bucket holds all, and only pivots are compared."""
    rng = random.Random(31)
    form = words(rng, "en", 200)
    texts = [changed(rng, form, edits) for _ in range(2000)]
    texts += [changed(rng, w, 1) for w in texts[:20]]
    asked = []
    compared = simhash.compared

    def counted(pairs, *args):
        asked.append(pairs.count())
        return compared(pairs, *args)

    monkeypatch.setattr(simhash, "compared", counted)
    buckets = spark.range(len(texts)).select(F.lit(0).alias("sample"), F.lit(7).cast("long").alias("key"), F.col("id").alias("node"))
    labels = simhash.similar_classes(buckets, sets_of(spark, texts), 0.8)
    classes = {}
    for r in labels.collect():
        classes.setdefault(r.component, set()).add(r.node)
    assert {i: i + 2000 for i in range(20)} == {min(c): max(c) for c in classes.values()} and all(len(c) == 2 for c in classes.values())
    assert sum(asked) <= 3 * len(texts)


def test_rare_buckets_hold_every_similar_pair(spark):
    """Sets of random sizes and overlaps, also just at the similarity: those that are similar meet in a bucket."""
    rng = random.Random(5)
    base, sets = rng.sample(range(1, 10**6), 120), []
    for k in range(160):
        kept = rng.sample(base, rng.randint(70, 120))
        sets.append((k, sorted(kept + rng.sample(range(10**6, 2 * 10**6), rng.randint(0, 14)))))
    sets += [(200, base[:100]), (201, base[:80]), (202, base[:100] + list(range(-25, 0))), (203, [5]), (204, [5]), (205, [])]
    df = spark.createDataFrame([(n, len(h), h) for n, h in sets], "node bigint, size int, hashes array<bigint>")
    met = {}
    for r in simhash.rare_buckets(df, 0.8).collect():
        met.setdefault((r.sample, r.key), set()).add((r.node, r.side))
    together = {(a, b) for nodes in met.values() for a, x in nodes for b, y in nodes if a < b and (x == 0 or x != y)}
    alike = {(a, b) for a, x in sets for b, y in sets if a < b and x and len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))}
    assert {(200, 201), (200, 202), (203, 204)} <= alike and len(alike) > 100
    assert alike <= together
    pairs = spark.createDataFrame([(a, b) for a, _ in sets for b, _ in sets if a < b], "a bigint, b bigint")
    assert {(r.src, r.dst) for r in simhash.compared(pairs, df, 0.8).collect()} == alike


def test_texts_behind_one_fingerprint_are_searched(spark):
    rng = random.Random(21)
    halves = [words(rng, "en", 60) for _ in range(3)]
    full = [["|"] * 100 + h for h in halves]  # one shingle makes over half of each: equal fingerprints
    assert len({plain_fingerprint(" ".join(w), 5) for w in full}) == 1
    near = ["|"] * 8 + changed(rng, halves[2], 1)
    assert plain_fingerprint(" ".join(near), 5) != plain_fingerprint(" ".join(full[2]), 5)
    assert 3 not in kept_ids(spark, [*full, near])


def test_fingerprints_alone_link_no_texts(spark):
    rng = random.Random(22)
    texts = [["|"] * 150 + words(rng, "en", 80) for _ in range(100)]
    assert len({plain_fingerprint(" ".join(w), 5) for w in texts}) == 1
    assert kept_ids(spark, texts + texts[:5]) == list(range(100))
    texts = [changed(rng, w, 1) for w in texts] + texts
    assert len(kept_ids(spark, texts)) == 100


def test_row_hashes_tell_nulls_apart(spark):
    df = spark.sql("SELECT * FROM VALUES (CAST(NULL AS STRING), 'a', map('k', 1)), ('a', NULL, map('k', 1)), ('a', 'a', NULL) AS t(x, y, z)")
    assert len({tuple(r) for r in df.select(*row_hashes(df)).collect()}) == 3


# --- decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain_hits(text, items):
    w = words_of(text)
    hit, met = set(), set()
    for name, item in items:
        x = words_of(item)
        n = min(10, len(x))
        grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                met.add(name)
    return len(w), hit, met


def test_winnowing_keeps_a_gram_of_every_shared_window():
    rng = random.Random(2)
    for _ in range(200):
        shared = [rng.choice("abcd") for _ in range(10)]
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        kept = []
        for prefix in (a, b):
            w = np.array([xxhash.xxh64_intdigest(x.encode()) for x in prefix + shared + a], dtype=np.uint64)
            h = decontaminate.gram_hashes(w, 5)
            kept.append({int(i) - len(prefix) for i in decontaminate.winnow(h, 6)})
        assert kept[0] & kept[1] & set(range(6))


def test_word_hashes_follow_the_words():
    text = "A1 bé \t,, " + "z" * 200 + " a1 " + "z" * 200 + "y"
    data = text.lower().encode()
    starts, ends, hashes = decontaminate.word_hashes(data)
    assert [data[a:b].decode() for a, b in zip(starts, ends)] == words_of(text)
    assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == len(hashes) - 1
    assert len(decontaminate.word_hashes(b"")[0]) == 0


def test_contamination_equals_brute_force(spark):
    rng = random.Random(4)
    long_items = [" ".join(words(rng, "en", 30)) for _ in range(4)]
    repeated = " ".join(["la la"] * 10)
    items = [(i, t) for i, t in enumerate(long_items)] + [(10, "Tiny item!"), (11, "word"), (12, repeated), (13, None), (14, " . "), (None, "no id at all"), (0, long_items[0])]
    docs = [
        (1, " ".join(words(rng, "en", 20)) + " " + long_items[0].upper() + " " + long_items[1][:-3], 0), (2, long_items[2].split(" ", 3)[3], 0),
        (3, " ".join(long_items[3].split()[:9]), 0), (4, " ".join(long_items[3].split()[5:15]), 0), (5, "a tiny, ITEM and a Word.", 0), (6, "la " * 500, 0),
        (7, None, 0), (8, "", 0), (9, "no id at all", 0), (None, "tiny item", 0), (5, "a tiny, ITEM and a Word.", 0), (12, "x" * 100_000 + " word", 0),
    ] + [(100 + i, t, 0) for i, (_, t, *_) in enumerate(corpus(10)) if t]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, _u int").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(df, bench, keep=("doc_id", "text", "_u")).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, met = plain_hits(r.text, items)
        assert (r.n_words, r.n_hit) == (n, len(hit)), r.doc_id
        assert r["items"] == sorted(str(m) for m in met if m is not None)
        assert {i for s in r.spans for i in range(s.start, s.end)} == hit
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert sorted(map(str, clean.collect())) == sorted(str(r) for r in df.collect() if not plain_hits(r.text, items)[1])
    assert decontaminate.contamination(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
