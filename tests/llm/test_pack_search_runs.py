"""Packing along a curve, ranked lexical search and run detection next to brute force."""

import hashlib
import math
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetpulse.llm import curve_packing, lexical_search, periodic_runs
from assetpulse.llm.common import running_total
from assetpulse.llm.queries import QUERIES, planted_repeats

from .util import corpus, empty, frame

SF = "/root/testdata/sf0.001"


# packing


@pytest.mark.parametrize("bits, dims", [(3, 2), (2, 3), (2, 4)])
def test_curve_moves_by_one_step(bits, dims):
    cells = np.array(list(product(range(1 << bits), repeat=dims)))
    keys = curve_packing.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    along = cells[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_words_keep_the_tokens_of_the_text():
    from tokenizers import Tokenizer

    path = curve_packing.vocabulary_path()
    whole = Tokenizer.from_file(path)
    texts = ["It's  A test\tof it, déjà vu 123-45\n\nÀ é <x> 's 't %%'s ÿß Ñandú×÷", "", "ΣΣ Σ", "q" * 500, "a\u0085b ́c \x00a\x1cb \x7f", "é" * 2000]
    texts += ["".join(map(chr, range(32, 127))), "".join(map(chr, range(192, 215))), " ".join(chr(c) + chr(c + 1) for c in range(33, 9000, 7))]
    with open(path, "rb") as file:
        words = curve_packing.Words(file.read(), "<u2")
    for text, own in zip(texts, words.ids([t.encode() for t in texts], 2)):
        assert np.frombuffer(own, dtype="<u2").tolist() == whole.encode(text, add_special_tokens=False).ids + [2]


def packed_rows(pieces):
    return sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))


@pytest.mark.parametrize("length", [64, 4096])
def test_pieces_restore_every_document(spark, length):
    from tokenizers import Tokenizer

    df = frame(spark)
    rows = packed_rows(curve_packing.pack(df, length=length))
    tokenizer = Tokenizer.from_file(curve_packing.vocabulary_path())
    plain = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()
    at = {}
    for r in rows:  # offsets have no gap, and no sequence is longer than allowed
        assert r.offset == at.get(r.sequence_id, 0) and len(r.ids) == 4 * r.length
        at[r.sequence_id] = r.offset + r.length
    assert sorted(at) == list(range(len(at)))
    assert all(n == length or n < length and n & (n - 1) == 0 for n in at.values())
    wanted, named = {}, {}
    for r in df.select("doc_id", "text").collect():
        wanted.setdefault(r.doc_id, []).append(plain(r.text))
    for r in rows:
        named.setdefault(r.id, []).append(r)
    assert set(named) == set(wanted)
    for i, texts in wanted.items():
        if len(texts) == 1:
            own = sorted(named[i], key=lambda r: r.start)
            assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
            assert b"".join(r.ids for r in own) == texts[0] and {r.doc_tokens for r in own} == {len(texts[0]) // 4}
        assert sum(r.length for r in named[i]) == sum(map(len, texts)) // 4
    assert curve_packing.pack(empty(spark)).count() == 0


def test_like_documents_lie_together(spark):
    rng, rows = random.Random(4), []
    topics = [[f"{t}{w}" for w in ("river", "stone", "cloud", "lamp", "garden", "wheel")] for t in ("north", "south", "east")]
    for i in range(90):
        rows.append((i, " ".join(rng.choice(topics[i % 3]) for _ in range(60)), "en", "s", 0))
    places = {r.id: r.sequence_id * 256 + r.offset for r in curve_packing.pack(frame(spark, rows, clash=False), length=256).where("start = 0").collect()}
    order = sorted(places, key=places.get)
    changes = sum(a % 3 != b % 3 for a, b in zip(order, order[1:]))
    assert changes < 30  # 60 if the order had nothing to do with the texts


def test_running_total(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("w"), F.lit("x").alias("_part")).repartition(5)
    got = {r.id: r.before for r in running_total(df, [F.col("id")], "w", "before", "test-total").collect()}
    assert got == dict(zip(range(1000), np.cumsum([0, *[i % 7 for i in range(999)]]).tolist()))


# search


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, k=10):
    bags = [(i, plain_terms(t)) for i, t in docs]
    n, total = sum(1 for _, w in bags if w), sum(len(w) for _, w in bags)
    df = {t: sum(t in set(w) for _, w in bags) for t in {t for _, x in items for t in plain_terms(x)}}
    out = []
    for item, text in items:
        found = []
        for i, w in bags:
            m = 25 + (75 * len(w) * n) // total if total else 0
            score = 0
            for t in plain_terms(text):
                if tf := w.count(t):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


def short_corpus():
    """Few different words, so that many scores are equal, and copies in every number."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("Alpha beta GAMMA delta é1 x-y".split()) for _ in range(rng.randint(1, 6))), "en", "s", 0) for i in range(150)]
    rows += [(200 + i, rows[0][1], "en", "s", 0) for i in range(30)] + [rows[3], rows[3], (None, rows[0][1], "en", "s", 0), (None, None, None, None, None), (400, "", "en", "s", 0)]
    return rows + [(401, "alpha " * 40_000, "en", "s", 0)]


ITEMS = [("i1", "alpha BETA beta"), ("i2", "nothing here"), ("i3", None), ("i4", ""), (None, "é1, x"), ("i5", "gamma " * 9000 + "delta"), ("i1", "alpha BETA beta")]


@pytest.mark.parametrize("tile, pass_bytes", [(512, 4 << 20), (7, 4 << 20), (7, 20)])
def test_search_equals_brute_force(spark, monkeypatch, tile, pass_bytes):
    monkeypatch.setattr(lexical_search, "DOCUMENTS", tile)
    rows = short_corpus()
    docs = frame(spark, rows)
    items = spark.createDataFrame(ITEMS, "item_id string, text string").withColumn("row", F.lit(1)).withColumn("pass", F.lit(1))
    got = lexical_search.top_documents(docs, items, k=10, pass_bytes=pass_bytes)
    key = lambda r: (r[0] or "", r[1], r[3], -1 if r[2] is None else r[2])
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(plain_search([(r[0], r[1]) for r in rows], ITEMS), key=key)


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert lexical_search.top_documents(empty(spark), items).count() == 0
    assert lexical_search.top_documents(frame(spark), items.limit(0)).count() == 0


def test_heavy_weights_are_dealt_to_columns():
    """Weights beyond the bound of a column are cut, and tiles of few columns add up to the same integers."""
    rng = np.random.default_rng(2)
    vocabulary = {bytes([97 + i]): i for i in range(8)}
    bags = [{bytes([97 + i]): int(rng.integers(1, 10**6)) for i in range(8)} for _ in range(5)]
    block = lexical_search.Block(bags, 0, vocabulary, np.full(8, 20_000))
    assert block.weight.max() <= lexical_search.HEAVIEST and len(block.term) > lexical_search.TERMS
    term, document = np.repeat(np.arange(8), 3), np.tile(np.arange(3), 8)
    impact = rng.integers(1, 10**6, 24)
    want = [[sum(bags[i][bytes([97 + t])] * 20_000 * int(impact[3 * t + d]) for t in range(8)) for d in range(3)] for i in range(5)]
    assert block.scores(document, term, impact, 3).tolist() == want


# runs


def plain_runs(w, shortest):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q):
                best[i, j + q] = min(best.get((i, j + q), q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def plain_collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("shortest", [1, 2, 5, 12, 20])
def test_runs_equal_brute_force(shortest):
    rng = random.Random(shortest)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.choice("abcdefgh"[: rng.choice((1, 2, 8))]) for _ in range(rng.randint(0, 70))]
            for _ in range(rng.randint(0, 3)):
                unit = [rng.choice("abcdef") for _ in range(rng.randint(1, 12))]
                at = rng.randint(0, len(w))
                w[at:at] = unit * rng.randint(2, 6) + unit[: rng.randint(0, len(unit))]
            docs.append(w)
        for w, (runs, collapsed) in zip(docs, periodic_runs.search([" ".join(w).encode() for w in docs], shortest)):
            want = plain_runs(w, shortest)
            assert runs == want and collapsed.decode() == plain_collapsed(w, want)


def test_runs_of_long_texts():
    """Work stays near linear for one repeated word, a repeated line between other words, and two letters at random."""
    rng = random.Random(1)
    line = " ".join("abcdefghijkl")
    texts = ["a " * 100_000, " ".join(f"x{i} {line}" for i in range(8000)), " ".join(rng.choice("ab") for _ in range(50_000))]
    found = [runs for runs, _ in periodic_runs.search([t.encode() for t in texts], 12)]
    assert found[0] == [(0, 100_000, 1)] and not found[1] and len(found[2]) > 500


def test_runs_of_rows(spark):
    df = frame(spark, corpus() + [(900, "x  y\tA b c d e f A b c d e f\nA b c d e", "en", "s", 0)])
    out = periodic_runs.find_runs(df)
    assert out.columns == df.columns + ["runs", "collapsed"] and out.count() == df.count()
    for r in out.collect():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", r.text or "") if x]
        want = plain_runs(w, 12) if len(w) < 1000 else []
        assert [tuple(x) for x in r.runs] == want and r.collapsed == plain_collapsed(w, want)
    assert periodic_runs.find_runs(empty(spark)).count() == 0


def test_query_of_runs_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc_id, text in docs:
        w, h = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x], zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        r, want = got[doc_id], plain_runs(w, 12)
        assert r.n_runs == len(want) and r.runs_sha256 == digest("".join(f"{a},{b},{c}\n" for a, b, c in want))
        assert r.collapsed_sha256 == digest(plain_collapsed(w, want))
        first = max(want, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*first, 1000 * first[1] // first[2]) if first else (None,) * 4)


def test_planted_repeats_of_awkward_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, "")] + [(i, None) for i in range(50)] + [(i, " ") for i in range(50)], "doc_id bigint, text string")
    assert {(r.t or "").strip() for r in df.select(planted_repeats(F.col("doc_id"), F.col("text")).alias("t")).collect()} == {"", "a b"}
