"""Mixing, sharding, token rollups and top-k search next to plain computations."""

import re
import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import differences
from pyspark.sql import functions as F

from assetpulse.llm import kdtree_search, mixing, sharding, token_rollup
from assetpulse.llm.common import word_count
from assetpulse.llm.queries import ORACLES

from .util import corpus, empty, frame


def sizes(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]


def plain_targets(by_source, share=1.5, most=2.0):
    names = sorted(by_source, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_names, left = {}, list(names), share * sum(by_source.values())
    while open_names:
        over = [s for s in open_names if weight[s] * left / sum(weight[x] for x in open_names) > most * by_source[s]]
        if not over:
            total = sum(weight[x] for x in open_names)
            target.update({s: weight[s] * left / total for s in open_names})
            break
        for s in over:
            target[s] = most * by_source[s]
            left -= target[s]
            open_names.remove(s)
    return target


def test_word_count(spark):
    texts = [None, "", " ", "a", " a", "a ", "\t a\x0bb\x0c", "a b c", "\x1fa \x1c b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == sizes([(0, t) for t in texts])


def test_mix_reaches_targets(spark):
    rows = [r for r in corpus(200) if len(r[1] or "") < 10_000]  # a third of all words in one document leaves no choice
    df = frame(spark, rows)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, str(r.source), r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    by_source, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        by_source[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 2
    assert sum(by_source.values()) == sum(sizes(rows)) and {r.source: r.source_size for r in got} == dict(by_source)
    want = plain_targets(dict(by_source))
    for s in want:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] <= target[s] + 1e-6 and target[s] - taken[s] <= 120  # less than the smallest document that is left
    assert mixing.mix(empty(spark)).count() == 0
    copies = mixing.mixed(df)
    assert copies.columns == df.columns and copies.count() == sum(r.copies for r in got)


def test_order_sample_takes_in_key_order(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "a" if i % 3 else "b", 1) for i in range(300)]
    got = mixing.mix(frame(spark, rows, clash=False), rounds=1).withColumn("u", mixing.uniform(F.col("doc_id"), F.col("size"))).collect()
    for s in ("a", "b"):
        part = [r for r in got if r.source == s]
        whole = int(part[0].target // part[0].source_size)
        left = part[0].target - whole * part[0].source_size
        for r in sorted(part, key=lambda r: r.u):
            left -= r.size
            assert r.copies == whole + (left >= 0)


@pytest.mark.parametrize("null_id", [True, False])
def test_rows_of_equal_id_and_size_are_divided(spark, null_id):
    df = spark.range(1000).select(
        (F.lit(None) if null_id else F.lit(7)).cast("long").alias("doc_id"), F.concat(F.repeat(F.lit("w "), 99), F.lit("t"), F.pmod("id", F.lit(40))).alias("text"),
        F.lit("a").alias("source"), F.lit("x").alias("_number"),
    )
    got = mixing.mix(df)
    assert got.agg(F.count("*"), F.sum(F.col("size") * F.col("copies")), F.first("target")).first()[:] == (1000, 150_000, 150_000.0)
    texts = lambda out: sorted(r.text for r in mixing.mixed(out).collect())
    assert texts(df) == texts(df.repartition(5)) and mixing.mixed(df).columns == df.columns


def test_mix_equals_its_sql_on_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, i]), "w " * rng.choice([0, 3, 3, 10, 40]), "en", rng.choice(["a", "b", "c", None, "d"]), 1) for i in range(600)]
    rows += [(None, "x y z", "en", "hot", 1)] * 401 + [(None, None, None, None, None)] * 3
    docs = frame(spark, rows, clash=False)
    found = mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pandas(docs.toPandas().astype({"doc_id": "Int64"})))
    assert differences(found, con, ORACLES["op6_mixing"]) is None
    held = defaultdict(list)
    for r in mixing.mix(docs).collect():
        held[r.source].append(r)
    for part in held.values():  # what is open is less than a document that was left out
        lacking, most = part[0].target - sum(r.size * r.copies for r in part), max(r.copies for r in part)
        left_out = [r.size for r in part if r.size and r.copies < most]
        assert -1e-6 <= lacking < max(left_out, default=1)


# --- sharding


@pytest.mark.parametrize("limit", [1 << 28, 20_000, 3_000, 100])
def test_shards_are_the_shortest_fitting_prefixes(spark, limit):
    rows = [r for r in corpus() if r[0] is not None]
    df = frame(spark, rows).withColumn("n_bytes", sharding.text_bytes(F.col("text")))
    out = sharding.shards(df, max_bytes=limit)
    got = out.select("doc_id", "n_bytes", "shard", "shard_bytes", "extra").collect()
    assert len(got) == len(rows) and out.columns.count("shard") == 1
    held, members = defaultdict(int), defaultdict(int)
    for r in got:
        held[r.shard] += r.n_bytes
        members[r.shard] += 1
    bits = {i: h for i, h in [(r.doc_id, f"{r.h:060b}") for r in df.select("doc_id", sharding.id_bits(F.col("doc_id")).alias("h")).distinct().collect()]}
    for r in got:
        assert r.shard_bytes == held[r.shard] and (held[r.shard] <= limit or members[r.shard] == 1)
        assert r.shard[:60] == bits[r.doc_id][: len(r.shard)]
        if r.shard and len(r.shard) <= 60:  # the parent does not fit
            inside = [(x.n_bytes, 1) for x in got if bits[x.doc_id].startswith(r.shard[:-1])]
            assert sum(n for n, _ in inside) > limit and len(inside) > 1
    assert sharding.shards(df.limit(0), max_bytes=limit).count() == 0


def test_rows_of_one_id_are_split(spark):
    df = spark.range(2000).select(F.lit(7).alias("doc_id"), F.lit(10).cast("long").alias("n_bytes"))
    got = sharding.shards(df, max_bytes=1000).groupBy("shard", "shard_bytes").agg(F.sum("n_bytes").alias("n")).collect()
    assert len(got) >= 20 and all(r.n == r.shard_bytes <= 1000 for r in got)
    nulls = sharding.shards(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS n_bytes FROM range(3)"), max_bytes=1)
    assert {r.shard for r in nulls.collect()} == {""}


# --- rollups


def plain_tokens(text):
    import base64

    import tiktoken

    with open(token_rollup.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return len(tiktoken.Encoding("t", pat_str=token_rollup.pattern(), mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text or ""))


def rows_of(df):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in df.collect()}


def test_rollup_equals_recount(spark, tmp_path):
    rows = [r for r in corpus(30) if not (r[1] or "").startswith("qq")]
    counted = token_rollup.count_documents(frame(spark, rows))
    store = token_rollup.Rollup(spark, f"file://{tmp_path}/store")
    assert store.totals().count() == 0
    store.commit(0, token_rollup.signed(counted, 1, "estimate"))
    revision = token_rollup.signed(counted, -1, "estimate").union(token_rollup.signed(counted, 1, "tokens"))
    store.commit(1, revision)
    want = defaultdict(lambda: [0, 0])
    for _, t, lang, source, _ in rows:
        want[source, lang, "byte_bpe_50k"][0] += 1
        want[source, lang, "byte_bpe_50k"][1] += plain_tokens(t)
    assert rows_of(store.totals()) == {k: tuple(v) for k, v in want.items()}
    store.commit(1, revision)  # delivered again
    assert rows_of(store.totals()) == {k: tuple(v) for k, v in want.items()}
    store.compact()
    store.commit(1, revision)  # already in the snapshot
    store.commit(2, revision.limit(0))
    assert rows_of(store.totals()) == {k: tuple(v) for k, v in want.items()}
    store.commit(3, token_rollup.signed(counted, -1, "tokens"))
    assert rows_of(store.totals()) == {}
    kept = token_rollup.first_copies(counted)
    assert kept.count() == len({r[1] or "" for r in rows})
    assert token_rollup.count_documents(empty(spark)).count() == 0


def test_half_written_batch_is_not_read(spark, tmp_path):
    counted = token_rollup.count_documents(frame(spark, corpus(5)[:5]))
    store = token_rollup.Rollup(spark, f"file://{tmp_path}/store")
    store.commit(4, token_rollup.signed(counted, 1, "tokens"))
    next((tmp_path / "store" / "batch=4").glob("part-*/_SUCCESS")).unlink()
    assert store.totals().count() == 0
    store.commit(4, token_rollup.signed(counted, 1, "tokens"))
    assert store.totals().agg(F.sum("docs")).first()[0] == 5


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_count_once_in_any_order(spark, tmp_path, seed):
    """Batches come late, again, and between snapshots; the totals hold each of them once after every step."""
    rng = random.Random(seed)
    store, seen = token_rollup.Rollup(spark, f"file://{tmp_path}/store"), set()
    steps = [1, 3, "compact", 2, 3, "compact"] if seed == 1 else [*rng.sample(range(8), 8), *rng.sample(range(8), 3), "compact", "compact"]
    if seed != 1:
        rng.shuffle(steps)
    for step in steps:
        if step == "compact":
            store.compact()
        else:
            rows = [("s", None if step % 2 else "en", "v", 1, 10**step), ("s", "en", "v", -1, None)]
            store.commit(step, spark.createDataFrame(rows, "source string, lang string, version string, sign bigint, tokens bigint"))
            seen.add(step)
        got = rows_of(store.totals())
        assert sum(t for _, t in got.values()) == sum(10**b for b in seen) and sum(n for n, _ in got.values()) == 0
    assert token_rollup.merged_ranges([(n, n) for n in seen]) == ([(1, 3)] if seed == 1 else [(0, 7)])


def test_rollup_follows_a_stream(spark, tmp_path):
    counted = token_rollup.count_documents(frame(spark, corpus(20)[:20]))
    changes = token_rollup.signed(counted, 1, "tokens")
    changes.repartition(4).write.parquet(f"{tmp_path}/in")
    store = token_rollup.Rollup(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = store.follow(stream, f"{tmp_path}/checkpoint")
    query.processAllAvailable()
    query.stop()
    want = rows_of(changes.groupBy("source", "lang", "version").agg(F.sum("sign").alias("docs"), F.sum("tokens").alias("tokens")))
    assert rows_of(store.totals()) == want and len(store.complete("batch")) >= 4


def test_long_texts_are_cut_where_no_token_crosses():
    cut = re.compile(r"(?<=\S) (?=[^\W\d_])")
    for text in ("one two  three\n four 5 six's  " * 40, "x" * 3000, "é è" * 500):
        parts = list(token_rollup.pieces(text, 64, cut))
        assert "".join(parts) == text and sum(map(plain_tokens, parts)) == plain_tokens(text)


# --- top-k search


def plain_top(vectors, queries, k):
    out = {}
    for q, v in queries.items():
        found = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v)]
        out[q] = [(i, -s) for s, i in sorted(set(found))[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [1000, 20])
def test_top_k_equals_brute_force(spark, shard_rows):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=6).round(3).tolist()) for i in range(300)]
    data += [(1000 + i, [0.5] * 6) for i in range(90)]  # one vector many times: ties
    data += [data[0], (2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [0.0] * 6)]
    data += [(3000, [1.0, 2.0]), (3001, [0.5, 0.25]), (3100, []), (3101, [])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)
    got = defaultdict(list)
    for r in kdtree_search.top_k(df, F.col("vec_id") % 100 == 0, shard_rows=shard_rows).collect():
        got[r.query_id].append((r["rank"], r.id, r.score))
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = plain_top(list(whole.items()), {i: v for i, v in whole.items() if i % 100 == 0}, 10)
    assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert all([r for r, *_ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert kdtree_search.top_k(df, F.lit(True)).count() == 0


def test_tree_visits_few_leaves_of_separate_groups():
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.integers(-5, 6, size=(2000, 4)) + c for c in (-1000, 0, 1000)])
    tree = kdtree_search.Tree(np.arange(len(rows)), rows)
    assert all((tree.rows[a:b] >= low).all() and (tree.rows[a:b] <= high).all() for a, b, low, high in zip(tree.first, tree.last, tree.lows, tree.highs))
    query = np.array([1, 1, 1, 1])
    best = tree.search(query, -1, 5, kdtree_search.LOWEST)
    scores = rows @ query
    order = sorted(range(len(rows)), key=lambda i: (-scores[i], i))[:5]
    assert best == [(int(scores[i]), i) for i in order]
