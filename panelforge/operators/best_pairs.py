"""The k most similar rows of every query, exactly, by matrix products of blocks.

Rows and queries are dealt to blocks of some thousands and every block of the one meets every
block of the other in a group of its own, so a task holds two blocks whatever the tables' sizes.
A product of two blocks finds, with a margin for its rounding, what may be among a query's best;
these are scored again, element by element in order, so a score does not depend on the blocks.
Copies of a vector are scored once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows and queries of a block, at most on average, and the groups to cut a table into where it has rows for them.
ROWS, QUERIES, GROUPS = 32_768, 8_192, 48
#: More than the rounding of a product of unit vectors; the numbers that a step holds.
MARGIN, STEP = 1e-9, 1 << 22


def matrices(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Width -> (places, rows) of the vectors that are not null, not empty and hold no null."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if not len(vectors):
        return {}
    sizes = np.array(vectors.value_lengths().fill_null(0))
    flat = vectors.flatten()  # without what lies under nulls
    gaps = np.array(flat.is_null())
    numbers = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    holes = np.concatenate([[0], np.cumsum(gaps)])
    whole = (sizes > 0) & (holes[ends] == holes[ends - sizes])
    found = {}
    for width in np.unique(sizes[whole]).tolist():
        at = np.flatnonzero(whole & (sizes == width))
        found[width] = at, numbers[(ends[at] - width)[:, None] + np.arange(width)]
    return found


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1])  # in order, as a running sum has it


def _best(x: np.ndarray, keys: np.ndarray, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): the k best rows of each query above ``least``, ties by the smaller key. A NaN is above all numbers."""
    order = np.argsort(keys, kind="stable")
    _, first, code = np.unique(np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    u = x[order][first]
    by_code = np.argsort(code, kind="stable")  # copies of a vector, by key
    begin = np.searchsorted(code[by_code], np.arange(len(u) + 1))
    n_u, n_q = _lengths(u), _lengths(q)
    with np.errstate(all="ignore"):
        unit_u, unit_q = u / n_u[:, None], q / n_q[:, None]
    odd_u, odd_q = ~np.isfinite(unit_u).all(axis=1), ~np.isfinite(unit_q).all(axis=1)
    unit_u[odd_u], unit_q[odd_q] = 0.0, 0.0
    out = []
    for a in range(0, len(q), max(1, STEP // len(u))):
        part = slice(a, a + max(1, STEP // len(u)))
        score = unit_q[part] @ unit_u.T
        score[:, odd_u] = np.inf  # looked at below in any case
        score[odd_q[part]] = np.inf
        bound = np.partition(score, len(u) - k, axis=1)[:, len(u) - k] if len(u) > k else np.full(len(score), -np.inf)
        asked, hit = np.nonzero(score >= np.maximum(bound, least)[:, None] - MARGIN)
        del score
        exact = np.empty(len(asked))
        for b in range(0, len(asked), max(1, STEP // u.shape[1])):
            at = slice(b, b + max(1, STEP // u.shape[1]))
            with np.errstate(all="ignore"):
                total = np.cumsum(u[hit[at]] * q[part][asked[at]], axis=1)[:, -1]
                exact[at] = total / n_u[hit[at]] / n_q[part][asked[at]]
        stays = (exact > least) | np.isnan(exact)
        asked, hit, exact = asked[stays], hit[stays], exact[stays]
        copies = np.minimum(begin[hit + 1] - begin[hit], k)
        nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        asked, exact, row = np.repeat(asked, copies), np.repeat(exact, copies), order[by_code[np.repeat(begin[hit], copies) + nth]]
        ranked = np.lexsort((keys[row], np.where(np.isnan(exact), -np.inf, -exact), asked))
        asked, exact, row = asked[ranked], exact[ranked], row[ranked]
        kept = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
        out.append((asked[kept] + a, row[kept], exact[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def best_pairs(rows: DataFrame, queries: DataFrame, k: int, least: float, vector: str = "embedding", key: str = "vec_id", on: Sequence[str] = ()) -> DataFrame:
    """The columns of ``rows`` but the vector, those of ``queries`` (``__q`` is the vector, ``query`` its key), and score: the ``k``
    rows of most similar direction for each query, above ``least``, ties by the smaller key; only rows that agree with the
    query in the columns ``on``, which come once. Vectors that are null, hold nulls or only zeros are found by nothing, as
    are those of another width."""
    rows, queries = rows.filter(F.col(vector).isNotNull()), queries.filter("__q is not null")
    most = lambda df: df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("g")).first()
    n, asked = most(rows), most(queries)
    across = max(1, -(-(asked["n"] or 0) // QUERIES))
    down = max(1, -(-(n["n"] or 0) // ROWS), min(-(-GROUPS // max(1, across * n["g"])), -(-(n["n"] or 0) // 1024)))
    kept = [f for f in rows.schema.fields if f.name != vector]
    more = [f for f in queries.schema.fields if f.name not in ("__q", *on)]
    place = lambda blocks, *c: F.pmod(F.xxhash64(*c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # A key that many rows share is dealt by their vectors too.
    left = rows.withColumn("__i", place(down, key, vector)).withColumn("__j", every(across))
    right = queries.withColumn("__j", place(across, "query", "__q")).withColumn("__i", every(down))
    schema = T.StructType([*kept, *more, T.StructField("score", T.DoubleType())])
    names = [f.name for f in kept], [f.name for f in more]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found_rows, found_queries = matrices(a.column(vector)), matrices(b.column("__q"))
        parts = []
        for width in found_rows.keys() & found_queries.keys():
            (at_a, x), (at_b, q) = found_rows[width], found_queries[width]
            some_a, some_b = _lengths(x) != 0, _lengths(q) != 0
            if some_a.any() and some_b.any():
                at_a, at_b = at_a[some_a], at_b[some_b]
                keys = a.column(key).take(pa.array(at_a)).combine_chunks().to_numpy(zero_copy_only=False)
                asked, row, score = _best(x[some_a], keys, q[some_b], k, least)
                parts.append((at_b[asked], at_a[row], score))
        asked, row, score = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, int),) * 2 + (np.zeros(0),)
        mine, theirs = a.select(names[0]).take(pa.array(row)), b.select(names[1]).take(pa.array(asked))
        return pa.Table.from_arrays([*mine.columns, *theirs.columns, pa.array(score)], names=[*names[0], *names[1], "score"])

    own = [*on, "__i", "__j"]
    groups = max(1, down * across * max(1, n["g"]))
    left, right = (df.repartition(groups, *own).groupBy(*own) for df in (left, right))
    found = left.cogroup(right).applyInArrow(run, schema)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col(key))
    return found.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= k).drop("__n")
