"""Small corpora with the awkward rows that every operator must take."""

import random

from pyspark.sql import functions as F, types as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ALPHABETS = {"en": "theandoringst", "de": "schneiüßrvzk", "fr": "éèçauxlereoi"}


def words(rng, lang, n):
    a = ALPHABETS[lang]
    return ["".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(n)]


def corpus(n=60, seed=1):
    """Texts in three languages, copies, near copies, a very long text, and rows with nulls, empties and repeats."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(ALPHABETS))
        text = " ".join(words(rng, lang, rng.randint(20, 120)))
        rows.append((i, text.capitalize() + ".", lang, f"s{i % 3}"))
    rows += [(n + 1, rows[3][1], rows[3][2], "s0"), (n + 2, rows[3][1].upper(), rows[3][2], "s1")]
    near = rows[5][1].split()
    near[len(near) // 2] = "other"
    rows.append((n + 3, " ".join(near), rows[5][2], "s2"))
    rows += [(n + 4, None, None, None), (n + 5, "", "en", "s1"), (n + 6, " .,;\n\t", "en", None), (n + 7, "12 34", None, "s2")]
    rows.append((n + 8, " ".join(words(rng, "en", 20_000)), "en", "s0"))
    rows.append((n + 9, "q" * 300_000, "en", "s0"))
    rows += [rows[0], rows[0], (None, "the thing and the string", "en", "s0"), (None, None, None, None)]
    return [(a, b, c, d, len(b) if b is not None else None) for a, b, c, d in rows]


def frame(spark, rows=None, clash=True):
    """A corpus with columns that are called like results and intermediate results, a map among them."""
    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)
    if clash:
        for name in ("score", "copies", "shard", "fp", "component_id", "_row_a", "_u", "host", "rank", "spans", "n_words"):
            df = df.withColumn(name, F.lit("x"))
        df = df.withColumn("extra", F.create_map(F.lit("k"), F.col("source")))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
