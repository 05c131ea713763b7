"""Periodic runs of words: stretches that repeat themselves with a smallest period at least twice.

A run of period q and length n is a pair of equal stretches q words apart of n - q words each, with different words before
the two and after the two: a maximal pair whose distance is at most the length of its stretches. So no candidate has to be
extended. The maximal pairs of a text come from its LCP-interval tree, read bottom-up off the sorted suffixes: an interval is
the set of all places of one repeated stretch, and places of different children of an interval are followed by different
words. Every interval holds its places in order and by the word to their left (class lists). The children of an interval are
merged small into large; each place of the smaller set looks at its neighbours in the larger one within the length of the
stretch, and passes over those with its own left word as a block by means of their class list. Every other neighbour is a
maximal pair, so the work follows the size of the sets and the number of runs, not the number of equal stretches. A run of
exponent e also shows as a pair at 2q, 3q, ...; of pairs over one stretch the smallest distance is the period.

Texts of a batch are searched together, with word numbers of their own, so nothing is shared between documents. Only words
whose following ``ceil(min_length / 2)`` words occur twice in their text are sorted: no shorter stretch can make a run.

Defined results: a null text has no word. Words are what ASCII white space separates. Texts of any length are searched whole,
in one task each; repeated rows are searched each on its own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, unused, without

#: words of a batch that are searched together; a longer text is a group of its own
TOGETHER = 1 << 20


def word_numbers(words: list[bytes], offset: int) -> np.ndarray:
    """A number for each word, equal for equal words: the place of its first occurrence, counted from ``offset``."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, words, count(offset)), dtype=np.int64, count=len(words))


def pair_ranks(first: np.ndarray, second: np.ndarray, base: int) -> np.ndarray:
    """Ranks of pairs of ranks below ``base``; equal pairs share the rank of the first of them in the order."""
    keys = first * np.int64(base) + second
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    ranks = np.empty(len(keys), dtype=np.int64)
    ranks[order] = np.maximum.accumulate(np.where(starts, np.arange(len(keys)), 0))
    return ranks


def repeated(numbers: np.ndarray, least: int) -> np.ndarray:
    """Places whose next ``least`` words are found a second time by their hash (a chance hit costs time only)."""
    n = len(numbers) - least + 1
    if n <= 1:
        return np.zeros(0, dtype=np.int64)
    mixed = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    keys = np.zeros(n, dtype=np.uint64)
    for i in range(least):
        keys = (keys ^ mixed[i : i + n]) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(32)
    order = np.argsort(keys, kind="stable")
    twin = keys[order][1:] == keys[order][:-1]
    both = np.zeros(n, dtype=bool)
    both[1:] |= twin
    both[:-1] |= twin
    return np.sort(order[both])


def sorted_suffixes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, by doubling the compared length, and the common length of each with the one before (0 first)."""
    n, length = len(numbers), 1
    levels = [np.unique(numbers, return_inverse=True)[1] + 1]  # level k ranks the suffixes by their first 2^k words
    while levels[-1].max() < n or len(np.unique(levels[-1])) < n:
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - length, 0)] = levels[-1][length:]
        levels.append((pair_ranks(levels[-1].astype(np.int64), after, n + 2) + 1).astype(np.int32 if n < 1 << 31 else np.int64))
        length *= 2
    order = np.argsort(levels[-1], kind="stable")
    left, right, common = order[:-1].copy(), order[1:].copy(), np.zeros(n, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        open_ = np.flatnonzero((left < n) & (right < n))
        same = open_[levels[k][left[open_]] == levels[k][right[open_]]]
        common[same + 1] += 1 << k
        left[same] += 1 << k
        right[same] += 1 << k
    return order, common


class Places:
    """The places of an interval: in order, and by the word to their left."""

    __slots__ = ("all", "classes")

    def __init__(self, place: int, left: int):
        self.all, self.classes = [place], {left: [place]}


def neighbours(of: Places, place: int, left: int, reach: int) -> Iterator[int]:
    """The members within ``reach`` of ``place`` whose left word is another; blocks with the same one are passed over."""
    members, same = of.all, of.classes.get(left, ())
    for step in (1, -1):
        i = bisect_left(members, place) - (step < 0)
        while 0 <= i < len(members) and abs(members[i] - place) <= reach:
            k = bisect_left(same, members[i])
            if k == len(same) or same[k] != members[i]:
                yield members[i]
                i += step
            else:
                i += step * block(members, i, same, k, step)


def block(members: list[int], i: int, same: list[int], k: int, step: int) -> int:
    """How many members from ``i`` on, in the direction of ``step``, follow each other in the class list as well."""

    def agrees(t: int) -> bool:
        x, y = i + step * t, k + step * t
        return 0 <= x < len(members) and 0 <= y < len(same) and members[x] == same[y]

    low, high = 0, 1
    while agrees(high):
        low, high = high, high * 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if agrees(middle) else (low, middle)
    return high


def merged(large: list[int], small: list[int]) -> list[int]:
    """Two ordered lists as one: few places are inserted, many are sorted in, which finds the two ordered parts."""
    if len(small) * 32 < len(large):
        for place in small:
            large.insert(bisect_left(large, place), place)
    else:
        large.extend(small)
        large.sort()
    return large


def join(one: Places, other: Places, length: int, shortest: int, found: dict[tuple[int, int], int]) -> Places:
    """Merges two children of an interval of that ``length`` and notes the runs between them: (start, end) -> period."""
    large, small = (one, other) if len(one.all) >= len(other.all) else (other, one)
    for left, places in small.classes.items():
        for place in places:
            for near in neighbours(large, place, left, length):
                start, period = min(near, place), abs(near - place)
                if period + length >= shortest:
                    stretch = (start, start + period + length)
                    found[stretch] = min(period, found.get(stretch, period))
    large.all = merged(large.all, small.all)
    for left, places in small.classes.items():
        own = large.classes.get(left)
        if own is None:
            large.classes[left] = places
        else:
            large.classes[left] = merged(own, places) if len(own) >= len(places) else merged(places, own)
    return large


def runs_of(numbers: np.ndarray, starts: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``shortest`` words, by start and period.

    ``numbers`` are the words of texts that begin at ``starts``; equal words of different texts have different numbers.
    """
    least = (shortest + 1) // 2
    some = repeated(numbers, least)
    if not len(some):
        return []
    # only the stretches around repeated places are sorted, each closed by a number of its own
    turns = np.zeros(len(numbers) + 1, dtype=np.int64)
    np.add.at(turns, some, 1)
    np.add.at(turns, some + least, -1)
    inside = np.cumsum(turns)[:-1] > 0
    places = np.flatnonzero(inside)
    closing = np.searchsorted(places, np.flatnonzero(inside & ~np.append(inside[1:], False)), side="right")
    sequence = np.insert(numbers[places], closing, len(numbers) + 1 + np.arange(len(closing)))
    origin = np.insert(places, closing, -1)
    order, common = sorted_suffixes(sequence)
    lefts = np.append([-1], numbers[:-1])
    begins = starts[starts < len(numbers)]
    lefts[begins] = -1 - begins  # before a text stands nothing, which is unlike any word
    deep = common >= least
    wanted = np.flatnonzero(deep | np.append(deep[1:], False))
    where = origin[order[wanted]]
    found: dict[tuple[int, int], int] = {}
    intervals: list[tuple[int, Places]] = []  # open ones: common length, increasing, and the children so far
    child: Places | None = None  # the last child that is complete
    for place, left, length in zip(where.tolist(), lefts[where].tolist(), np.where(deep, common, 0)[wanted].tolist()):
        child = close(intervals, child, length, shortest, found)
        if length:
            if intervals and intervals[-1][0] == length:
                intervals[-1] = (length, join(intervals[-1][1], child, length, shortest, found))
            else:
                intervals.append((length, child))
        child = Places(place, left)
    close(intervals, child, 0, shortest, found)
    return sorted((start, end - start, period) for (start, end), period in found.items())


def close(intervals: list[tuple[int, Places]], child: Places | None, length: int, shortest: int, found: dict) -> Places | None:
    """Completes the open intervals longer than ``length``; each takes ``child`` as its last child and becomes the child."""
    while intervals and intervals[-1][0] > length:
        depth, own = intervals.pop()
        child = join(own, child, depth, shortest, found)
    return child


def search(texts: list[bytes | None], shortest: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """The runs of each text, and its words without what repeats within them, joined by one space."""
    split, at = [t.split() if t else [] for t in texts], 0
    while at < len(split):
        size, upto = len(split[at]), at + 1
        while upto < len(split) and size + len(split[upto]) <= TOGETHER:
            size, upto = size + len(split[upto]), upto + 1
        group = split[at:upto]
        starts = np.cumsum([0, *map(len, group)])
        numbers = np.concatenate([word_numbers(words, s) for words, s in zip(group, starts.tolist())])
        runs = runs_of(numbers, starts[:-1], shortest)
        owner = np.searchsorted(starts, [start for start, _, _ in runs], side="right") - 1  # empty texts begin where the next one does
        own: dict[int, list[tuple[int, int, int]]] = {}
        for text, (start, length, period) in zip(owner.tolist(), runs):
            own.setdefault(text, []).append((start - int(starts[text]), length, period))
        for i, words in enumerate(group):
            if i in own:
                keep = np.ones(len(words), dtype=bool)
                for start, length, period in own[i]:
                    keep[start + period : start + length] = False
                words = [words[k] for k in np.flatnonzero(keep).tolist()]
            yield own.get(i, []), b" ".join(words)
        at = upto


def find_runs(df: DataFrame, text_col: str = "text", min_length: int = 12, runs_out: str = "runs", collapsed_out: str = "collapsed") -> DataFrame:
    """``df`` with ``runs``, an array of (start, length, period) in words by start and period, and the ``collapsed`` text.

    A run has at least ``min_length`` words and two periods. The collapsed text leaves out what a run holds after its first
    period. A narrow step: rows are neither moved nor grouped.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf("struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:binary>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(search(batch.tolist(), min_length))
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own, _ in found]
            yield pd.DataFrame({"runs": runs, "collapsed": [text for _, text in found]})

    kept = without(df, runs_out, collapsed_out)
    (result,) = unused(df, "_runs")
    scanned = df.select(*[F.col(f"`{c}`") for c in kept.columns], scan(F.col(text_col).cast("binary")).alias(result))
    return scanned.select(
        *[F.col(f"`{c}`") for c in kept.columns], F.col(f"`{result}`.runs").alias(runs_out),
        F.col(f"`{result}`.collapsed").cast("string").alias(collapsed_out),
    )

