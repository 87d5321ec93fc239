"""An inverted-file index over vectors: rows lie in the list of their nearest centre, a search reads the nearest lists only.

Centres are fitted on ``sample`` rows at most, those with the smallest hash of their
key; every row is then assigned and written, partitioned by list. A search joins the
queries to the lists they probe and scores exactly: by products of blocks within a list
or, with a condition, which is applied before the best are taken, by an equi-join on the list.
Probing all lists is the exact search. A list that outgrows the others is cut into blocks,
or split by adaptive execution in that join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.operators.best_pairs import best_pairs, matrices
from panelforge.operators.facts import dot, unit


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows at length 1; a null or empty vector, or one of zeros, is a row of zeros."""
    found = matrices(vectors)
    sizes = vectors.value_lengths().drop_null()
    first = next((n for n in sizes.to_pylist() if n), 1)
    x = np.zeros((len(vectors), first))
    if first in found:
        at, rows = found[first]
        x[at] = np.nan_to_num(rows)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fitted_centres(vectors: DataFrame, lists: int = 64, vector: str = "embedding", key: str = "vec_id", sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Centres of ``lists`` lists (fewer for fewer rows) by k-means on unit vectors of a bounded sample."""
    rows = vectors.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).toArrow()
    if not rows.num_rows:
        return np.zeros((1, 1))
    x = _matrix(rows.column(0).combine_chunks())
    centres = [x[0]]
    far = 1 - x @ x[0]
    for _ in range(min(lists, len(x)) - 1):  # each start far from those before
        centres.append(x[int(far.argmax())])
        far = np.minimum(far, 1 - x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def with_lists(df: DataFrame, centres: np.ndarray, vector: str, probes: int = 1) -> DataFrame:
    """Adds ``list``; a row for each of the ``probes`` nearest centres. Null vectors are in list 0."""
    shared = df.sparkSession.sparkContext.broadcast(centres)  # lists x width numbers, fixed by the index

    def run(batches):
        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(batch.schema.get_field_index(vector)))
            score = x @ c.T if x.shape[1] == c.shape[1] else np.zeros((len(x), len(c)))
            best = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            rows = batch.take(pa.array(np.repeat(np.arange(len(x)), best.shape[1])))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(best.ravel().astype(np.int32))], names=[*batch.schema.names, "list"])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("list", T.IntegerType())]))


def build(vectors: DataFrame, centres: np.ndarray, path: str, vector: str = "embedding") -> DataFrame:
    """Writes every row of ``vectors`` under its list, with the vector at length 1 as ``__u``."""
    rows = with_lists(vectors, centres, vector)
    rows.withColumn("__u", unit(F.col(vector))).drop(vector).write.partitionBy("list").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 8, least: float = 0.3, condition: Column | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query, q_..., columns of the index, score): the ``k`` best rows of each query above ``least`` that meet ``condition``
    (columns of the index against q_<column> of the query), among the ``probes`` nearest lists."""
    q = with_lists(queries, centres, vector, probes)
    if condition is None:
        q = q.select(*[F.col(c).alias(c if c in ("query", "list") else f"q_{c}") for c in q.columns if c != vector], F.col(vector).alias("__q"))
        return best_pairs(index, q, k, least, "__u", key, ["list"]).drop("list")
    q = q.select(*[F.col(c).alias(c if c in ("query", "list") else f"q_{c}") for c in q.columns if c != vector], unit(F.col(vector)).alias("__q"))
    pairs = index.join(q, "list")
    if condition is not None:
        pairs = pairs.filter(condition)
    pairs = pairs.withColumn("score", dot(F.col("__u"), F.col("__q"))).filter(F.col("score") > least).drop("__u", "__q", "list")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col(key))
    return pairs.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= k).drop("__n")


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: the share of the exact answers that ``found`` has."""
    both = exact.select("query", key).join(found.select("query", key).withColumn("__hit", F.lit(1.0)), ["query", key], "left")
    return both.agg(F.avg(F.coalesce("__hit", F.lit(0.0))).alias("recall"))


def with_year_before(similar: DataFrame, facts: DataFrame, queries: DataFrame, quarter: str = "q", entity: str = "ticker", key: str = "vec_id") -> DataFrame:
    """(query, key, score, found): what a search found, and every fact of the query's entity four quarters before (score 1)."""
    asked = queries.select("query", F.col(entity).alias("__e"), (F.col(quarter) - 4).alias("__q"))
    before = facts.join(asked, (F.col(entity) == F.col("__e")) & (F.col(quarter) == F.col("__q")))
    return similar.select("query", key, "score", F.lit("similar").alias("found")).unionByName(before.select("query", key, F.lit(1.0).alias("score"), F.lit("year before").alias("found")))
