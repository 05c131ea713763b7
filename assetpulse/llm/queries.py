"""Registered queries of this package and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import use_utc
from . import (
    curve_packing, decontaminate, kdtree_search, language_id, lexical_search, mixing, periodic_runs, personal_data, secret_scan, sharding, simhash,
    token_rollup, url_filter,
)
from .common import SPACE, span_text, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(use_utc(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("op1_language_id")
def _language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.is_held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held_out))
    guessed = language_id.predict(docs.select("doc_id", "text"), model)
    return guessed.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _of_kinds(spans, *kinds: str):
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


@query("op2_secret_scan")
def _secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs).select("doc_id", "secrets")
    spans = F.col("secrets")
    counts = [F.size(_of_kinds(spans, k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.sha2(span_text(_of_kinds(spans, "assign", "access", "hex")), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), span_text(spans).alias("spans"))


@query("op3_personal_data")
def _personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, spans = personal_data.find_personal_data(docs), F.col("personal")
    counts = [F.size(_of_kinds(spans, k)).cast("long").alias(f"n_{k}") for k in personal_data.BASE]
    base = F.sha2(span_text(_of_kinds(spans, *personal_data.BASE)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), span_text(spans).alias("spans"))


@query("op7_simhash_dedup")
def _simhash_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, shingle=3, bits=2)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


#: the rules of the registered query
SITE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op8_decontaminate",
    rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all({ASCII.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT item_id, regexp_extract_all({ASCII.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS gram
      FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
    ),
    places AS (
      SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
    ),
    found AS (SELECT doc_id, item_id, p, n FROM places JOIN windows USING (n, gram)),
    hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
    listed AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
    """,
)
def _decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontaminate.contamination(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _mix_rounds(rounds: int = 3) -> str:
    """Rounds of taking documents in the order of their keys while their words fit what is left of the source."""
    out = []
    for r in range(rounds):
        out.append(f"""
    open{r} AS (
      SELECT k.*, left_words, sum(size) OVER (PARTITION BY k.source ORDER BY key, row ROWS UNBOUNDED PRECEDING) AS reached
      FROM keyed{r} k JOIN left{r} l ON k.source IS NOT DISTINCT FROM l.source WHERE size <= left_words
    ),
    took{r} AS (SELECT row, source, size FROM open{r} WHERE reached <= left_words),
    keyed{r + 1} AS (SELECT * FROM keyed{r} WHERE row NOT IN (SELECT row FROM took{r})),
    left{r + 1} AS (
      SELECT l.source, left_words - coalesce(used, 0) AS left_words
      FROM left{r} l LEFT JOIN (SELECT source, sum(size) AS used FROM took{r} GROUP BY source) u ON l.source IS NOT DISTINCT FROM u.source
    ),""")
    return "".join(out)


@query(
    "op6_mixing",
    rf"""
    WITH sized AS (
      SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
    ),
    drawn AS (
      SELECT *, (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
      FROM sized
    ),
    src AS (
      SELECT source, s, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
      FROM (SELECT source, sum(size)::BIGINT AS s FROM drawn GROUP BY source)
    ),
    levels AS (
      SELECT 2.0::DOUBLE * s / w AS ratio,
             (1.5::DOUBLE * (sum(s) OVER ())::DOUBLE - coalesce(sum(2 * s) OVER before, 0)::DOUBLE)
               / ((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
      FROM src WINDOW before AS (ORDER BY 2.0::DOUBLE * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    level AS (SELECT coalesce(arg_min(level, ratio) FILTER (WHERE level < ratio), max(ratio)) AS level FROM levels),
    aimed AS (SELECT source, s, least(2.0::DOUBLE * s, w::DOUBLE * level) AS target FROM src, level),
    rated AS (SELECT *, CASE WHEN s > 0 THEN target / s::DOUBLE ELSE 0 END AS rate FROM aimed),
    plan AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS p FROM rated),
    keyed0 AS (
      SELECT row, d.source, size, q / (1 + q) AS key
      FROM (SELECT row, d.source, size, p, (u / (1 - u)) / (p / (1 - p)) AS q FROM drawn d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source WHERE p > 0 AND size > 0) d
    ),
    left0 AS (SELECT source, target - whole * s::DOUBLE AS left_words FROM plan),
    {_mix_rounds()}
    extra AS (SELECT row FROM keyed0 WHERE row NOT IN (SELECT row FROM keyed3))
    SELECT doc_id, size, s AS source_size, target, (size * (whole + CASE WHEN e.row IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
    FROM drawn d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN extra e ON d.row = e.row
    """,
)
def _mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = mixing.mix(docs)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: byte limit of a shard in the registered query; loaders that read whole shards want small ones
SHARD_BYTES = 1 << 20


@query(
    "op10_sharding",
    f"""
    WITH d AS (
      SELECT row_number() OVER () AS row, doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
      FROM documents
    ),
    levels AS (SELECT row, doc_id, n_bytes, depth, h >> (60 - depth) AS prefix, h FROM d, (SELECT unnest(range(0, 31)) AS depth)),
    sums AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, prefix) AS bytes, count(*) OVER (PARTITION BY depth, prefix) AS n FROM levels),
    leaf AS (SELECT * FROM sums WHERE bytes <= {SHARD_BYTES} OR n = 1 QUALIFY row_number() OVER (PARTITION BY row ORDER BY depth) = 1)
    SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INTEGER, '0') END AS shard, bytes::BIGINT AS shard_bytes FROM leaf
    """,
)
def _sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", sharding.text_bytes(F.col("text")).alias("n_bytes"))
    return sharding.shards(docs, max_bytes=SHARD_BYTES)


@query(
    "op5_url_filter",
    f"""
    WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    placed AS (
      SELECT page_id, coalesce({ASCII.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM rest
    ),
    rules(verdict, rule_host, rule_path) AS (VALUES {", ".join(str(r) for r in SITE_RULES)}),
    fits AS (
      SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
      FROM (SELECT DISTINCT host, path FROM placed) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      GROUP BY ALL
    )
    SELECT page_id, host, path, rule,
           coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.])({"|".join(h.removesuffix(".*") for _, h, _ in url_filter.UNWANTED)})[.]') THEN 'block' ELSE 'allow' END) AS verdict
    FROM placed LEFT JOIN fits USING (host, path)
    """,
)
def _url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_filter.judge(pages, url_filter.rules(spark, SITE_RULES, url_filter.UNWANTED))
    return found.select("page_id", "host", "path", F.when(F.col("rank") == 0, F.col("rule")).alias("rule"), "verdict")


@query("op9_token_rollup")
def _token_rollup(spark, sf_dir):
    """Three batches: all documents with estimated counts, their revision by counted tokens, and the removal of exact copies."""
    counted = token_rollup.count_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    store = token_rollup.Rollup(spark, token_rollup.new_folder(spark))
    store.commit(0, token_rollup.signed(counted, 1, "estimate"))
    revision = token_rollup.signed(counted, -1, "estimate").union(token_rollup.signed(counted, 1, "tokens"))
    store.commit(1, revision)
    copies = token_rollup.signed(counted, -1, "tokens").union(token_rollup.signed(token_rollup.first_copies(counted), 1, "tokens"))
    store.commit(2, copies)
    store.commit(1, revision)  # a batch that is delivered again counts once
    return store.totals()


@query(
    "op4_topk_search",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
)
def _topk_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = kdtree_search.top_k(vectors, F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op11_curve_packing")
def _curve_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = curve_packing.pack(docs, length=4096, end=2)
    return found.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query(
    "op12_lexical_search",
    rf"""
    WITH d AS (
      SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({ASCII.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
    ),
    i AS (
      SELECT row_number() OVER () AS item, item_id, regexp_extract_all({ASCII.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
    ),
    wanted AS (SELECT item, term, count(*)::BIGINT AS times FROM (SELECT item, unnest(w) AS term FROM i) GROUP BY ALL),
    held AS (
      SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
    ),
    overall AS (SELECT count(*)::BIGINT AS n, coalesce(sum(len(w)), 0)::BIGINT AS l FROM d WHERE len(w) > 0),
    weight AS (
      SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
      FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), overall
    ),
    impact AS (
      SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w)::BIGINT * n) // l)) AS impact
      FROM held JOIN d USING (row), overall
    ),
    scored AS (
      SELECT item, row, doc_id, sum(times * weight * impact)::BIGINT AS score
      FROM wanted JOIN weight USING (term) JOIN impact USING (term) GROUP BY ALL
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked JOIN i USING (item) WHERE rank <= 10
    """,
)
def _lexical_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = lexical_search.top_documents(docs, items, k=10)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def planted_repeats(doc_id, text):
    """The text in which a tenth of the documents repeat a stretch of their words to the end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words):
        n = F.size(words).cast("long")
        start = F.pmod(g, n)
        period = 1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        unit = F.slice(words, (start + 1).cast("int"), period.cast("int"))
        times = F.ceil((n - start) / period).cast("int")
        again = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), (n - start).cast("int"))
        return F.array_join(F.concat(F.slice(words, F.lit(1), start.cast("int")), again), " ")

    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    one = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(F.lit("")))  # the words are split once
    return F.when(F.pmod(h, F.lit(10)) == 0, F.get(one, F.lit(0))).otherwise(text)


@query("op13_periodic_runs")
def _periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.find_runs(docs, min_length=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
