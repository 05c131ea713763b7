"""Mixes sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document's expected number of copies is its source's target over the source's
size; the whole part are certain copies. The rest is an order sample: with u a uniform number drawn from a hash of the
document and p the fractional part, documents are ranked by the ratio of odds (u / (1 - u)) / (p / (1 - p)), and the first
ones are taken until their words reach what the certain copies left open. What is then still open is smaller than the next
document; two more rounds rank the documents that still fit, which narrows the gap. After every round a source lacks fewer
words than one of its documents that the round left out, so the rounds bound nothing but the closeness within that.

A source may hold a third of all rows, so ranks are never computed by sorting it in one task. Words are summed by slices of
the key (two levels of 4,096), the slice in which the sum passes the target is refined, and only the documents of one such
slice of 1 / 2^24 are sorted. What results is one key bound per source and round; the decision on a row then follows from
its source, size and key alone, by a join with the small table of sources.

Rows that agree in source, id and size share one key. Where such a block does not fit as a whole, as many of its rows are
taken as fit, in the order of the MD5 of their texts and then of a stored row number. A source has at most one divided block
a round. The rows of divided blocks, and no others, are written to the shared folder once and numbered by a range sort.

Defined results: a null text has size 0 and takes nothing. A null source is a source of its own and comes last. A source
without words has target 0. Which of several rows with equal source, id and text an extra copy goes to is not defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize, number_rows
from .common import unused, without, word_count

WEIGHTS = (3.0, 1.0, 2.0)
#: slices of the key per level of refinement
SLICES = 4096
#: sources up to this number are joined by broadcast, with one row for each of their rounds at most
SMALL = 10_000
#: what a round takes of a source: documents of at most ``most`` words up to the key ``bound``, and ``some`` rows with the key ``part``
STEP = "struct<bound:double,most:double,part:double,some:bigint>"


def uniform(*parts: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) with 52 bits, drawn from the MD5 of the parts as text; a null part counts as a word of its own."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def pareto_key(u: Column, p: Column) -> Column:
    """The Pareto ratio q of odds as q / (1 + q), in (0, 1); small keys are taken first."""
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when(p > 0, q / (1 + q)).otherwise(F.lit(1.0))


def targets(sources: DataFrame, share: float, most: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    The targets are in proportion to the weights and sum to ``share`` of all sizes; one beyond ``most`` times its source's
    size stops there and the excess goes to the others by weight, until none is above. Each round is one aggregate.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked = number_rows(sources, order, "rank", "mix-sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = materialize(ranked.withColumn("weight", F.get(cycle, F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int"))), "mix-weights")
    cap = F.col("source_size") * F.lit(float(most))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        stopped = cap <= F.col("weight") * F.lit(level)
        r = weighed.agg(
            F.sum(F.when(stopped, cap).otherwise(0.0)).alias("held"), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(stopped & (F.col("source_size") > 0)).alias("n"),
        ).first()
        if r.n == capped or not r.open:
            break
        capped, level = r.n, (share * total - r.held) / r.open
    return weighed.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def bounds(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """(source, bound, part, some, words) for rows (source, key, size) and ``budget`` (source, left).

    The rows up to the key ``bound`` stay within the budget, and ``some`` of the rows with the next key, ``part``, which make
    ``words`` words. Sources without rows are left out.
    """
    first = F.floor(F.col("key") * SLICES)
    second = F.floor(F.col("key") * (SLICES * SLICES))

    def passing(sums: DataFrame, slice_col: str, left: DataFrame) -> DataFrame:
        """The slice of each source in which the sum passes what is left (or the last one), and what the slices before leave."""
        before = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return (
            sums.join(left.select(F.col("source").alias("of"), "left"), F.col("source").eqNullSafe(F.col("of")))
            .withColumn("rest", F.col("left") - before).where("rest >= 0")
            .groupBy("source").agg(F.max(F.struct(slice_col, "rest")).alias("m")).select("source", f"m.{slice_col}", F.col("m.rest").alias("left"))
        )

    def inside(at: DataFrame, *slices: str) -> DataFrame:
        match = F.col("source").eqNullSafe(F.col("of"))
        for name, value in zip(slices, (first, second)):
            match = match & (value == F.col(name))
        return rows.join(at.select(F.col("source").alias("of"), *slices), match, "left_semi")

    level1 = passing(rows.groupBy("source", first.alias("s1")).agg(F.sum("size").alias("size")), "s1", budget)
    level1 = materialize(level1, "mix-level1")
    level2 = passing(inside(level1, "s1").groupBy("source", second.alias("s2")).agg(F.sum("size").alias("size")), "s2", level1)
    level2 = materialize(level2.select("source", F.floor(F.col("s2") / SLICES).alias("s1"), "s2", "left"), "mix-level2")
    keys = inside(level2, "s1", "s2").groupBy("source", "key").agg(F.sum("size").alias("size"), F.max("size").alias("each"))
    reached = F.sum("size").over(W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow))
    within = keys.withColumn("reached", reached).join(level2.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    fits = F.col("reached") <= F.col("left")
    some = F.floor((F.col("left") - (F.col("reached") - F.col("size"))) / F.col("each"))
    last = within.groupBy("source").agg(
        F.max(F.when(fits, F.col("key"))).alias("bound"), F.min(F.when(~fits, F.struct("key", some.alias("some"), "each"))).alias("next")
    )
    # without a fitting key in that slice the bound lies before it
    floor = level2.select(F.col("source").alias("of"), (F.col("s2") / float(SLICES * SLICES)).alias("low"))
    return floor.join(last, F.col("of").eqNullSafe(F.col("source")), "left").select(
        F.col("of").alias("source"), F.coalesce("bound", F.col("low") - F.lit(2.0**-53)).alias("bound"),
        F.col("next.key").alias("part"), F.coalesce("next.some", F.lit(0)).alias("some"),
        F.coalesce(F.col("next.some") * F.col("next.each"), F.lit(0)).alias("words"),
    )


def mix(
    df: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", share: float = 1.5, most: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS, rounds: int = 3, seed: str = "mix",
) -> DataFrame:
    """``df`` with size, source_size, target and copies (how often the document is taken); the mix takes copies * size words.

    Sizes and draws are written to the shared folder once; the decision joins every row with its source's bounds.
    """
    size, (n, u, of, plan_of) = word_count(F.col(text_col)), unused(df, "_size", "_u", "_of", "_plan")
    drawn = df.withColumn(n, size).withColumn(u, uniform(F.col(id_col), F.col(n), seed=seed))
    rows = materialize(drawn.select(F.col(source_col).alias("source"), F.col(n).alias("size"), F.col(u).alias("u")), "mix-rows")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    sources = materialize(sources.select("source", "source_size", "target", "whole", "p"), "mix-targets")
    few = sources.count() <= SMALL
    plan = sources.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("steps", F.array().cast(f"array<{STEP}>"))
    keyed = rows.join(F.broadcast(sources) if few else sources, rows["source"].eqNullSafe(sources["source"])).where("p > 0 AND size > 0")
    keyed = materialize(keyed.select(rows["source"], "size", pareto_key(F.col("u"), F.col("p")).alias("key")), "mix-keys")
    plan = materialize(plan, "mix-plan")
    for _ in range(rounds):
        at = F.broadcast(plan) if few else plan
        open_rows = keyed.join(at.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        open_rows = open_rows.where((F.col("size") <= F.col("left")) & ~taken_in(F.col("steps"), F.col("key"), F.col("size"))).select("source", "size", "key")
        found = bounds(open_rows, plan.select("source", "left")).withColumnRenamed("source", "of")
        step = plan.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        step = materialize(step.withColumn("most", F.col("left")), "mix-step")
        used = open_rows.join((F.broadcast(step) if few else step).select(F.col("source").alias("of"), "bound"), F.col("source").eqNullSafe(F.col("of")))
        used = used.where("key <= bound").groupBy("of").agg(F.sum("size").alias("used"))
        plan = step.join(used, F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source", "source_size", "target", "whole", "p", (F.col("left") - F.coalesce("used", F.lit(0)) - F.coalesce("words", F.lit(0))).alias("left"),
            F.when(F.col("bound").isNotNull(), F.concat("steps", F.array(F.struct("bound", "most", "part", "some").cast(STEP)))).otherwise(F.col("steps")).alias("steps"),
        )
        plan = materialize(plan, "mix-plan")
    final = plan.select(F.col("source").alias(of), F.struct("source_size", "target", "whole", "p", "steps").alias(plan_of))
    joined = drawn.join(F.broadcast(final) if few else final, F.col(source_col).eqNullSafe(F.col(of)))
    of_source = F.col(plan_of)
    key, steps = pareto_key(F.col(u), of_source["p"]), of_source["steps"]
    sampled = (of_source["p"] > 0) & (F.col(n) > 0)
    outputs = ("size", "source_size", "target", "copies")
    kept = [F.col(f"`{c}`") for c in without(df, *outputs).columns]

    def decided(rows: DataFrame, extra: Column) -> DataFrame:
        return rows.select(
            *kept, F.col(n).alias("size"), of_source["source_size"].alias("source_size"), of_source["target"].alias("target"),
            (of_source["whole"] + F.when(extra, 1).otherwise(0)).cast("long").alias("copies"),
        )

    settled = taken_in(steps, key, F.col(n))
    if plan.where(F.exists("steps", lambda s: s["some"] > 0)).isEmpty():
        return decided(joined, sampled & settled)
    divided = sampled & F.exists(steps, lambda s: (s["some"] > 0) & (s["part"] == key))
    whole = decided(joined.where(~divided), sampled & settled)
    return whole.unionByName(decided(*first_of_blocks(joined.where(divided), F.col(of), key, steps, F.col(text_col), few)))


def first_of_blocks(rows: DataFrame, source: Column, key: Column, steps: Column, text: Column, few: bool) -> tuple[DataFrame, Column]:
    """``rows`` of divided blocks, written once and numbered, and whether a row is among those of its block that are taken.

    Texts are not moved: digests and numbers are sorted, and the last taken pair of each block goes back to the stored rows.
    """
    number, end = unused(rows, "_number", "_end")
    held = materialize(rows.withColumn(number, F.monotonically_increasing_id()), "mix-blocks")
    some = F.filter(steps, lambda s: (s["some"] > 0) & (s["part"] == key))[0]["some"]
    pairs = held.select(source.alias("source"), key.alias("key"), some.alias("some"), F.md5(text).alias("digest"), F.col(number).alias("number"))
    ranked = number_rows(pairs, ["source", "key", "digest", "number"], "rank", "mix-ranked")
    ends = ranked.groupBy("source", "key").agg((F.min("rank") + F.max("some") - 1).alias("end")).select(
        F.col("source").alias("of"), F.col("key").alias("of_key"), "end"
    )
    here = F.col("source").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")) & (F.col("rank") == F.col("end"))
    last = ranked.join(F.broadcast(ends) if few else ends, here).select("of", "of_key", F.struct("digest", "number").alias("pair"))
    last = materialize(last, "mix-ends").select(F.struct("of", "of_key", "pair").alias(end))
    at = F.col(end)
    found = held.join(F.broadcast(last) if few else last, source.eqNullSafe(at["of"]) & (key == at["of_key"]))
    return found, F.struct(F.md5(text).alias("digest"), F.col(number).alias("number")) <= at["pair"]


def taken_in(steps: Column, key: Column, size: Column) -> Column:
    """Whether one of the rounds took a row: its size fitted what was left, and its key is within the round's bound."""
    return F.exists(steps, lambda s: (size <= s["most"]) & (key <= s["bound"]))


def mixed(df: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of ``df``."""
    if {c.lower() for c in df.columns} & {"copies", "size", "source_size", "target"}:
        names = {c: f"_kept_{i}" for i, c in enumerate(df.columns)}
        back = {v: k for k, v in names.items()}
        columns = {k: options.pop(k, d) for k, d in (("text_col", "text"), ("source_col", "source"), ("id_col", "doc_id"))}
        renamed = df.toDF(*names.values())
        return mixed(renamed, **{k: names[v] for k, v in columns.items()}, **options).toDF(*back.values())
    taken = mix(df, **options)
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    (one,) = unused(taken, "_one")
    return taken.where("copies > 0").withColumn(one, again).select(*[F.col(f"`{c}`") for c in df.columns])
