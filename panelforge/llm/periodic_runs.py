"""Runs (maximal repetitions) of words within texts, by the longest-previous-factor array.

For the word sequence of a text: suffix array (prefix doubling), adjacent common
prefixes, from both the longest previous factor of every word, and from that the
Lempel-Ziv blocks. Every run either holds or touches a block's border, and then
Main's extensions of that border to both sides find it (the reach to the left is
twice the block before plus the block itself), or it lies strictly inside a block,
and then it is a copy of a run inside the block's earlier occurrence: runs are
kept by start and copied block by block, left to right.

A run asked for here has at least ``least`` words and ``times`` periods, so its
words after the first period repeat ``shortest_repeat(least, times)`` words at
least: texts in which no stretch of so many words occurs twice have none and are
not looked at further, and neither are borders whose reach is shorter than ``least``.

Everything is a map over texts: no shuffle, and nothing is held beyond a batch of
texts. The longest text sets the memory (about 300 bytes a word while it is worked on).

Defined cases. A null or empty text, or one of white space only, has no words, no
runs, and the empty text as collapsed text. Repeated rows and equal ids are rows of
their own. A null id is returned as null; the planted rewriting of the query leaves
its text alone. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import SMALL_SLICE_BYTES, mapped, mixed, slices, table, words

#: What a run has at least: words, and periods.
LEAST, TIMES = 24, 3
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def shortest_repeat(least: int = LEAST, times: int = TIMES) -> int:
    """A run of ``least`` words and ``times`` periods, less its first period, has so many words at least."""
    return min(max(least - q, (times - 1) * q) for q in range(1, max(least, 1) + 1))


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``x`` in ascending order: ranks of prefixes, doubled until all differ."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        np.cumsum(np.diff(key[order]) != 0, out=new[1:])
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        step *= 2


def common_prefixes(x: list[int], order: list[int]) -> list[int]:
    """Of every suffix in ``order``, the words it shares at its start with the one before it (Kasai's scan)."""
    n = len(x)
    rank, out, h = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        if not (r := rank[i]):
            h = 0
            continue
        j = order[r - 1]
        end = n - max(i, j)
        while h < end and x[i + h] == x[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out


def previous_factors(order: list[int], shared: list[int]) -> tuple[list[int], list[int]]:
    """For every place: the longest stretch from it that also starts earlier, and where."""
    n = len(order)
    longest, source = [0] * n, [0] * n
    places, heights = [], []
    for r in range(n + 1):
        i, low = (order[r], shared[r]) if r < n else (-1, 0)
        while places and i < places[-1]:
            at, h = places.pop(), heights.pop()
            if h >= low:
                longest[at], source[at] = h, places[-1] if places else -1
            else:
                longest[at], source[at] = low, i
            low = min(low, h)
        places.append(i)
        heights.append(low)
    return longest, source


def blocks(longest: list[int]) -> list[int]:
    """Starts of the Lempel-Ziv blocks, and the end."""
    out, at, n = [], 0, len(longest)
    while at < n:
        out.append(at)
        at += longest[at] or 1
    return [*out, n]


def matches(x: list[int]) -> list[int]:
    """Of every place, how far ``x`` from there agrees with its own start (the place 0 counts as 0)."""
    n = len(x)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _across(x: list[int], border: int, reach: int, end: int, least: int, times: int, out: dict) -> None:
    """Puts the runs that hold or touch ``border``, start within ``reach`` to the left and end at ``end`` or before."""
    t, v = x[border - reach : border], x[border:end]
    nt, nv = len(t), len(v)
    back, n = t[::-1], len(x)
    ahead, behind = matches(v), matches(back)
    to_left = matches(back + [-1] + v[::-1] + back)  # from nt + 1 + nv - q: back from border + q
    to_right = matches(v + [-1] + t + v)  # from nv + 1 + nt - q: on from border - q
    for q in range(1, nv + 1):
        a, b = border - min(to_left[nt + 1 + nv - q], nt), border + q + (ahead[q] if q < nv else 0)
        _keep(x, a, b, q, n, least, times, out)
    for q in range(1, nt + 1):
        a, b = border - q - (behind[q] if q < nt else 0), border + min(to_right[nv + 1 + nt - q], nv)
        _keep(x, a, b, q, n, least, times, out)


def _keep(x: list[int], a: int, b: int, q: int, n: int, least: int, times: int, out: dict) -> None:
    """Keeps [a, b) of period q if it is long enough and really ends where the search stopped."""
    if b - a >= max(least, times * q) and (not a or x[a - 1] != x[a - 1 + q]) and (b == n or x[b] != x[b - q]) and q < out.get((a, b), n):
        out[a, b] = q


def runs(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of ``least`` words and ``times`` (2 or more) periods, by start, then period."""
    n = len(codes)
    if n < max(least, times):
        return []
    order = suffix_array(codes)
    x, order = codes.tolist(), order.tolist()
    longest, source = previous_factors(order, common_prefixes(x, order))
    cuts = blocks(longest)
    found: dict[tuple[int, int], int] = {}
    for k in range(1, len(cuts)):
        border, end = cuts[k], cuts[min(k + 1, len(cuts) - 1)]
        reach = min(border, 2 * (border - cuts[k - 1]) + end - border)
        if reach + end - border >= least:
            _across(x, border, reach, end, least, times, found)
    starts = sorted((a, b - a, q) for (a, b), q in found.items())
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a < least or not longest[a]:
            continue
        at, shift = bisect_right(starts, (source[a], n, n)), a - source[a]
        while at < len(starts) and starts[at][0] + shift < b:  # copies may fall into the source of later ones
            s, length, q = starts[at]
            if s + length + shift < b and (s + shift, s + shift + length) not in found:
                found[s + shift, s + shift + length] = q
                insort(starts, (s + shift, length, q))
            at += 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def repeating(codes: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """For each text (cut of ``codes`` at ``bounds``) whether some ``width`` words in a row occur in it twice (by a hash: now
    and then true for another text)."""
    n_texts, n = len(bounds) - 1, len(codes)
    if n < width:
        return np.zeros(n_texts, bool)
    h, size = mixed(codes.astype(np.uint64) + np.uint64(1)), 1
    odd = np.uint64(0x9E3779B97F4A7C15)
    while size < width:  # of stretches of size words; the last step may overlap
        step = min(size, width - size)
        h = mixed(h[: len(h) - step] * odd + h[step:])
        size += step
    rows = np.repeat(np.arange(n_texts), np.diff(bounds))
    inside = rows[: len(h)] == rows[width - 1 : width - 1 + len(h)]
    rows = rows[: len(h)][inside]
    keys = h[inside] ^ mixed(rows.astype(np.uint64) + np.uint64(1 << 40))
    by = np.argsort(keys)
    same = (keys[by][1:] == keys[by][:-1]) & (rows[by][1:] == rows[by][:-1])
    out = np.zeros(n_texts, bool)
    out[rows[by][1:][same]] = True
    return out


def _worker(least: int, times: int, rewrite: Callable | None):
    width = shortest_repeat(least, times)

    def run(batches):
        for batch in batches:
            for cut in slices(batch, "text", SMALL_SLICE_BYTES):
                ids, split = cut.column("doc_id").to_pylist(), words(cut.column("text"), lower=False)
                codes, bounds = split.codes, split.bounds
                if rewrite:
                    codes = codes.copy()
                    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        codes[a:b] = rewrite(ids[i], codes[a:b])
                chosen = repeating(codes, bounds, width)
                vocab, found, kept = np.array(split.vocab, object), [], []
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    own = codes[a:b]
                    found.append(runs(own, least, times) if chosen[i] else [])
                    if found[-1]:
                        drop = np.zeros(b - a + 1, np.int64)
                        for s, length, q in found[-1]:
                            drop[s + q] += 1
                            drop[s + length] -= 1
                        own = own[np.cumsum(drop)[:-1] == 0]
                    kept.append(" ".join(vocab[own]))
                flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
                parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), parts)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(np.diff(bounds)), "runs": lists, "collapsed": pa.array(kept, pa.string())})

    return run


def word_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, rewrite: Callable | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the words that no run holds after its first period, joined
    by one space) of every row. ``rewrite(id, codes)`` may give the word codes of a text another order before."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _worker(least, times, rewrite), SCHEMA)


def planted(doc_id: int | None, codes: np.ndarray) -> np.ndarray:
    """The query's rewriting: from some word on, one text in ten repeats its own words with a period."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(codes)
    if h % 10 or not n:
        return codes
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return codes[np.where(i >= a, a + (i - a) % p, i)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    # the run with the greatest length/period: cross products of integers, so the comparison is exact
    best = F.reduce(
        "runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"),
        lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
