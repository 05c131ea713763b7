"""Language identification, secret scan, personal data and URL rules."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from assetpulse.llm import language_id, personal_data, secret_scan, url_filter
from assetpulse.llm.common import Ranges
from assetpulse.llm.queries import SITE_RULES

from .util import corpus, empty, frame


def grams_of(text):
    """The three n-grams of every letter, spelled out."""
    low = re.sub(r"[^\w]|[\d_]", " ", text.lower())
    low = " " + "".join(c if c.isalpha() else " " for c in low) + " "
    for i, c in enumerate(low):
        if c != " ":
            yield c
            yield low[i - 1 : i + 1]
            yield "3" + low[i - 1 : i + 2]


def test_language_equals_plain_naive_bayes(spark):
    rows = [r for r in corpus() if r[1] and len(r[1]) < 10_000]
    df = frame(spark, rows)
    model = language_id.fit(df, docs_per_label=10**9, buckets=1 << 20)
    got = {(r.doc_id, r.text): r for r in language_id.predict(df, model).collect()}
    train = [(t, l) for _, t, l, _, _ in rows if l]
    labels = sorted({l for _, l in train})
    counts = {l: Counter(g for t, k in train if k == l for g in grams_of(t)) for l in labels}
    sums = {l: sum(counts[l].values()) + 0.5 * (1 << 20) for l in labels}
    share = Counter(l for _, l in train)
    for i, text, *_ in rows:
        grams = list(grams_of(text))
        if not grams:
            assert got[(i, text)].lang_pred == "und" and got[(i, text)].score == 0
            continue
        logs = [math.log(share[l] / len(train)) + sum(math.log((counts[l][g] + 0.5) / sums[l]) for g in grams) for l in labels]
        assert got[(i, text)].lang_pred == labels[logs.index(max(logs))]
        assert got[(i, text)].score == pytest.approx(1 / sum(math.exp(x - max(logs)) for x in logs), abs=0.02)


def test_language_awkward_rows(spark):
    df = frame(spark)
    out = language_id.predict(df, language_id.fit(df))
    rows = out.collect()
    assert len(rows) == df.count() and out.columns.count("score") == 1 and "extra" in out.columns
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    right = [r.lang_pred == r.lang for r in rows if r.lang and r.text and any(c.isalpha() for c in r.text) and len(r.text) > 20]
    assert sum(right) / len(right) > 0.95
    none = language_id.fit(empty(spark))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}
    assert language_id.predict(empty(spark), none).count() == 0


def test_held_out_third(spark):
    rows = spark.range(300).select("id", language_id.is_held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
    assert not spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(language_id.is_held_out(F.col("id"))).first()[0]


def test_pieces_cut_between_words():
    text = "abc def " * 100 + "x" * 500
    parts = list(language_id.pieces(text, 50))
    assert "".join(parts) == text and all(len(p) <= 50 for p in parts)


# --- secrets

ASSIGN = re.compile(secret_scan.ASSIGN, re.I | re.A)


def plain_secrets(x):
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 12]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 18]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 16]
    return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(s)]


def scanner():
    with open(secret_scan.vocabulary_path(), "rb") as f:
        return secret_scan.Scanner(f.read(), 1.9, 20)


SCAN = scanner()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "\u017fecret", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "éa", ".", "-", "xy", "aaaabbbbcccc"]), max_size=14))
def test_known_secrets_equal_the_patterns(parts):
    text = "".join(parts)
    assert [s[:3] for s in SCAN.spans(text) if s[0] != "random"] == plain_secrets(text)


@pytest.mark.parametrize("text, found", [
    ("key wJalrXUtnFEMI/K7MDENGbPxRfiCYzEXAMPLEKEY7 end", 1),
    ("see getUserAccountByIdentifier and /usr/share/local/bin/python_scripts", 0),
    ("id 550e8400-e29b-41d4-a716-446655440000 here", 0),
    ("sum D41D8CD98F00B204E9800998ECF8427E here", 0),
    ("donaudampfschifffahrtsgesellschaft", 0),
    ("x" * 5000 + "1", 0),
])
def test_random_strings(text, found):
    assert sum(s[0] == "random" for s in SCAN.spans(text)) == found


def test_secret_rows(spark):
    df = frame(spark)
    out = secret_scan.find_secrets(df)
    assert out.count() == df.count() and secret_scan.find_secrets(empty(spark)).count() == 0
    for r in out.collect():
        assert [(s.kind, s.start, s.end) for s in r.secrets if s.kind != "random"] == plain_secrets(r.text or "")
        assert all(r.text[s.start : s.end] == s.value for s in r.secrets)


# --- personal data


def luhn(d):
    return sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(d[::-1])) % 10 == 0


def plain_personal(x):
    s = []
    if "@" in x:  # the pattern is quadratic in long runs
        s += [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    s += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            s.append((2, m.start(), m.end()))
    s += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(personal_data.KINDS[k], a, b) for k, a, b in sorted(s)]


FIND = personal_data.Finder()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["ab", "@", ".", "c-d", "é", " ", "+", "1", "22", "255", "256", "4111 1111 1111 1111", "-", "(", ")", "_", "x@y.z", "0001", "+49 30 1234567"]), max_size=16))
def test_known_personal_data_equal_the_patterns(parts):
    text = "".join(parts)
    got = [(c["kind"], c["start"], c["end"]) for c in FIND.candidates(text) if c["kind"] in personal_data.BASE]
    assert got == plain_personal(text)


def test_long_runs_stay_linear():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1." * 100_000, "+1" + " " * 100_000, "9" * 5000 + ".1.1.1"):
        FIND.candidates(text)


def test_ranges_equal_every_comparison():
    rng = random.Random(3)
    for _ in range(200):
        spans = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(8)))]
        have = Ranges(spans)
        for a in range(70):
            for b in (a + 1, a + 5):
                assert have.meets(a, b) == any(a < end and start < b for start, end in spans)


def test_texts_full_of_spans_stay_linear():
    """A text with 60,000 spans: comparing every span with every other would take minutes."""
    text = " ".join(f"call (212) 555-{i % 10_000:04d} or a{i}@mail.example.com" for i in range(30_000))
    begin = time.perf_counter()
    assert len(FIND.candidates(text)) >= 60_000
    keys = " ".join(f"{'%032x' % (i * 7919)} Zq{i % 10}xW9kLm4Tv7Rb2Ny8Hc{i:05d}" for i in range(30_000))
    found = SCAN.spans(keys)
    assert sum(kind == "hex" for kind, *_ in found) == 30_000 and any(kind == "random" for kind, *_ in found)
    assert time.perf_counter() - begin < 60


def test_reliabilities_and_classifier_separate_classes():
    p = personal_data.reliabilities([("++0000", 500), ("+00000", 100), ("0-0-00", 400), ("00000-", 50)])
    assert p["++0000"] > 0.9 > 0.5 > p["0-0-00"]
    w = personal_data.classifier([([0, 1, 1, 0, 1, 1], 90, 0.99), ([5, 2, 1, 1, 2, 1], 90, 0.02)])
    logit = [sum(w[i] for i in personal_data.columns_of(f)) + w[-1] for f in ([0, 1, 1, 0, 1, 1], [5, 2, 1, 1, 2, 1])]
    assert logit[0] > 1 and logit[1] < -1


def test_personal_rows(spark):
    extra = [
        (900, "Please call me on +1 (234) 555-7713 or write to jo.doe@mail.example.com, card 4111 1111 1111 1111, from host 10.0.0.255", "en", "s0", 1),
        (901, "invoice order 123-45-6789 and my social security number ssn 123-45-6789; version 1.2.3.4", "en", "s0", 1),
        (902, "dear Dr. Maria Lopez, reach me at jo (at) example (dot) com; iban account DE89 3704 0044 0532 0130 00", "en", "s0", 1),
    ]
    df = frame(spark, corpus() + extra)
    out = personal_data.find_personal_data(df, keep=("doc_id", "text", "spans")).collect()
    assert len(out) == df.count()
    for r in out:
        assert [(s.kind, s.start, s.end) for s in r.personal if s.kind in personal_data.BASE] == plain_personal(r.text or "")
        assert all(r.text[s.start : s.end] == s.value and 0 <= s.probability <= 1 for s in r.personal)
        if r.doc_id is not None and r.doc_id < 60:
            assert not r.personal
    assert personal_data.find_personal_data(empty(spark)).count() == 0


# --- URLs

URLS = [
    "http://a.example.net/en/1?x=/de/", "HTTP://WWW.Example.COM/de/2", "https://org/fr/", "https://a.org/fr", "http://net", "http://net/", "http://net?/", "x",
    None, "", "://", "http://www.cheap-pills.example.org/fr/1", "http://www.cheap-pills.example.org/x", "http://notexample.net/en/", "http://a.b.net/en/",
    "http://x.casino/", "http://example.com/DE/", "http://example.com#/de/", "ftp://é.net/ü", "http://net/", "http://spam-farm", "a://b://c/d",
]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    words = "|".join(h.removesuffix(".*") for _, h, _ in url_filter.UNWANTED)
    return host, path, None, "block" if re.search(rf"(^|\.)({words})\.", host) else "allow"


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "r", "v", 1) for i, u in enumerate(URLS)], "page_id bigint, url string, host string, rule string, verdict string, _subject int")
    got = {r.page_id: r for r in url_filter.judge(df, url_filter.rules(spark, SITE_RULES, url_filter.UNWANTED)).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        r = got[i]
        assert (r.host, r.path, r.rule if r["rank"] == 0 else None, r.verdict) == plain_verdict(u), u
    assert url_filter.judge(df.limit(0), url_filter.rules(spark, SITE_RULES)).count() == 0


def test_rules_without_tokens_and_rarest_token(spark):
    df = spark.createDataFrame([("http://a.b.com/x1",), ("http://é/",), ("http://b.com/",)], "url string")
    out = url_filter.judge(df, url_filter.rules(spark, (("block", "é", ""), ("block", "b.com", "/x")))).collect()
    assert {r.url: r.verdict for r in out} == {"http://a.b.com/x1": "block", "http://é/": "block", "http://b.com/": "allow"}
    rules = url_filter.rules(spark, (("block", "rare.com", ""),))
    subjects = spark.createDataFrame([("a.com/",)] * 3 + [("rare.com/",)], "subject string")
    assert url_filter.index(subjects, rules, 10).first().token == "rare"


def test_digest_of_spans(spark):
    from assetpulse.llm.common import span_text

    row = spark.sql("SELECT array(named_struct('kind', 'hex', 'start', 1, 'end', 17), named_struct('kind', 'hex', 'start', 20, 'end', 40)) AS s")
    text = row.select(span_text(F.col("s")), F.sha2(span_text(F.col("s")), 256)).first()
    assert text[0] == "hex:1:17,hex:20:40" and text[1] == hashlib.sha256(text[0].encode()).hexdigest()
