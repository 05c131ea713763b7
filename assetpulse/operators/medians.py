"""Exact medians.

``percentile`` keeps every distinct value of a group in one task, which is fine for groups bounded by the time
axis (one sensor's cells). Groups that grow with the number of sensors or events use ``grouped_quantiles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

ACCURACY = 10_000


def median(value: Column) -> Column:
    """Exact median of a bounded group (also valid over a window frame)."""
    return F.percentile(value, F.lit(0.5))


def grouped_quantiles(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], top: str | None = None, accuracy: int = ACCURACY
) -> DataFrame:
    """Exact interpolated quantiles per group for groups of any size: ``keys``, ``n``, one column per entry of ``wanted``.

    One mergeable quantile sketch brackets all wanted ranks (and gives the maximum, as ``top``). The second pass counts what
    lies between the brackets and keeps only the distinct values inside them (all of a group of up to ``accuracy`` rows, about
    8 / ``accuracy`` of a larger one for each quantile), both with map-side combination, so no task ever holds a whole group.
    The counts tell whether the brackets hold the wanted ranks. The result, a row a group, is stored; only if it names groups
    where they do not is the input read again, for those groups, with brackets ten times as wide and then without bound.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).alias("_v"))
    qs = list(wanted.values())
    eps = 4.0 / accuracy  # sketch error plus the at most two ranks between rank definitions once n > accuracy
    good: DataFrame | None = None
    again = rows
    for reach in (eps, 10 * eps, 1.0):
        found = materialize(_in_brackets(again, keys, qs, reach, accuracy), "quantiles")
        good = found.where("_ok") if good is None else good.union(found.where("_ok"))
        failed = found.where("NOT _ok").select(*keys)
        if failed.isEmpty():
            break
        again = rows.join(failed, keys, "left_semi")
    extra = [F.col("_max").alias(top)] if top else []
    return good.select(*keys, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(wanted)], *extra)


def _in_brackets(rows: DataFrame, keys: list[str], qs: list[float], eps: float, accuracy: int) -> DataFrame:
    """(keys, n, _max, _q, _ok): quantiles from the values within eps of their ranks, and whether those hold the ranks.

    A value inside no bracket is counted at the end of the last bracket below it (null: below all), behind the values there.
    """
    ends = [x for q in qs for x in (max(q - eps, 0.0), min(q + eps, 1.0))]
    near = F.percentile_approx("_v", ends, accuracy)
    whole = (F.count("*") <= accuracy) if eps < 1 else F.lit(True)
    all_of_it = F.array(*[F.min("_v"), F.max("_v")] * len(qs))
    brackets = rows.groupBy(*keys).agg(
        F.when(whole, all_of_it).otherwise(near).alias("_b"), F.count("*").alias("n"), F.max("_v").alias("_max")
    )
    pairs = [(F.col("_b")[2 * i], F.col("_b")[2 * i + 1]) for i in range(len(qs))]
    kept = F.lit(False)
    for low, high in pairs:
        kept = kept | F.col("_v").between(low, high)
    passed = F.array_max(F.array(*[F.when(high < F.col("_v"), high) for _, high in pairs]))
    counted = (
        rows.join(brackets, keys)
        .where(F.col("_v") <= F.array_max("_b"))
        .withColumn("_beside", ~kept)
        .groupBy(*keys, "n", "_max", F.when(kept, F.col("_v")).otherwise(passed).alias("_at"), "_beside")
        .agg(F.count("*").alias("_c"))
        .withColumn("_upto", F.sum("_c").over(W.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_first(), "_beside")))
    )
    return _at_ranks(counted, keys, qs)


def _at_ranks(counted: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """(keys, n, _max, _q, _ok) from values ``_at`` with ``_upto``, the rows of their group up to and with them."""
    here = F.struct("_upto", "_at", "_beside")
    places = [(F.col("n") - 1) * q for q in qs]
    firsts = [
        F.min(F.when(F.col("_upto") > rank(place), here)).alias(f"_{side}{i}")
        for i, place in enumerate(places) for side, rank in (("l", F.floor), ("h", F.ceil))
    ]
    held, values = F.lit(True), []
    for i, place in enumerate(places):
        low, high, share = F.col(f"_l{i}"), F.col(f"_h{i}"), place - F.floor(place)
        held = held & F.coalesce(~low["_beside"] & ~high["_beside"], F.lit(False))
        values.append(low["_at"] * (1.0 - share) + high["_at"] * share)
    return counted.groupBy(*keys, "n", "_max").agg(*firsts).select(*keys, "n", "_max", F.array(*values).alias("_q"), held.alias("_ok"))


def counted_quantiles(
    df: DataFrame, keys: list[str], value: str, times: str, wanted: dict[str, float], top: str | None = None, accuracy: int = ACCURACY
) -> DataFrame:
    """``grouped_quantiles`` of rows that say how often (``times``, at least 1) their value comes.

    Equal values of a group are one row before anything is ranked. Only groups of more than ``accuracy`` distinct values are
    written out value by value again.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(times).alias("_c"))
    rows = materialize(rows, "quantile-counts")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_d"), F.sum("_c").alias("n"), F.max("_v").alias("_max"))
    sizes = materialize(sizes, "quantile-sizes")
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy("_v"))
    few = rows.join(sizes.where(F.col("_d") <= accuracy), keys).withColumns({"_upto": upto, "_at": F.col("_v"), "_beside": F.lit(False)})
    extra = [F.col("_max").alias(top)] if top else []
    found = _at_ranks(few, keys, list(wanted.values()))
    found = found.select(*keys, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(wanted)], *extra)
    many = sizes.where(F.col("_d") > accuracy).select(*keys)
    if many.isEmpty():
        return found
    steps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_c") - 1, F.lit(1000).cast("bigint")))
    every = rows.join(many, keys, "left_semi").withColumn("_k", steps)
    every = every.withColumn("_v", F.explode(F.array_repeat("_v", F.least(F.lit(1000), F.col("_c") - F.col("_k")).cast("int"))))
    return found.unionByName(grouped_quantiles(every.select(*keys, "_v"), keys, "_v", wanted, top, accuracy))


def grouped_quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str, accuracy: int = ACCURACY) -> DataFrame:
    """One exact quantile per group for groups of any size: ``keys``, ``n``, ``out``."""
    return grouped_quantiles(df, keys, value, {out: q}, accuracy=accuracy)


def grouped_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group for groups of any size."""
    return grouped_quantile(df, keys, value, 0.5, out)


def robust_scale(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and 1.4826 * MAD per key, for groups bounded by the axis (see ``grouped_median`` otherwise)."""
    from ..params import MAD_TO_SIGMA

    w = W.partitionBy(*keys)
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .withColumn("center", median(F.col(value)).over(w))
        .groupBy(*keys, "center")
        .agg((median(F.abs(F.col(value) - F.col("center"))) * MAD_TO_SIGMA).alias("sigma"))
    )
