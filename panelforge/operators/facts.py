"""Fact tables in place of a property graph, quarters, statements, and vector top-k search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.panel import nonzero
from panelforge.operators.best_pairs import best_pairs
from panelforge.sources.scratch import written


def quarter_key(q: Column) -> Column:
    """A number that orders YYYY-Qn labels; 0 for others."""
    y, n = (F.regexp_extract(q, r"^(\d{4})-Q([1-4])$", i).try_cast("int") for i in (1, 2))
    return F.coalesce(y * 4 + n - 1, F.lit(0))


def quarter_label(key: Column) -> Column:
    return F.concat(F.floor(key / 4).cast("string"), F.lit("-Q"), (key % 4 + 1).cast("string"))


def year_before(q: Column) -> Column:
    return F.when(quarter_key(q) > 0, quarter_label(quarter_key(q) - 4))


def quarters_back(q: Column, n: int) -> Column:
    """The quarter and the n - 1 before it."""
    return F.when(quarter_key(q) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: quarter_label(quarter_key(q) - i)))


def graph_tables(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of facts (ticker, quarter, metric, value, reason): merged nodes by label and name, and links of
    every fact to them. Facts are written first: their ids hash their values, and a sum of doubles that is worked out
    again may end in other digits."""
    facts = written(facts.withColumn("fact", F.sha2(F.to_json(F.struct("ticker", "quarter", "metric", "value", "reason")), 256)))
    links = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(c).cast("string").alias("name")) for label, c in (("Ticker", "ticker"), ("Quarter", "quarter"), ("Metric", "metric"), ("Value", "value"), ("Reason", "reason"))]))
    edges = facts.select("fact", links.alias("to")).select("fact", "to.label", "to.name").filter("name is not null").distinct()
    nodes = edges.select("label", "name").distinct().unionByName(facts.select(F.lit("Fact").alias("label"), F.col("fact").alias("name")).distinct())
    return nodes, edges


def quarter_changes(facts: DataFrame, steps: int = 1) -> DataFrame:
    """Facts with the same ticker's and metric's value ``steps`` quarters before, and the change."""
    rows = facts.withColumn("__q", quarter_key(F.col("quarter")))
    before = rows.select("ticker", "metric", (F.col("__q") + steps).alias("__q"), F.col("value").alias("previous"))
    return rows.join(before, ["ticker", "metric", "__q"]).withColumn("change", F.col("value") - F.col("previous")).drop("__q")


def decumulated(facts: DataFrame, value: str = "value", by_year: bool = True) -> DataFrame:
    """Values that add up over the year as values of the quarter alone."""
    rows = facts.withColumns({"__q": quarter_key(F.col("quarter")), "__y": F.substring("quarter", 1, 4)})
    w = Window.partitionBy("ticker", "metric", *(["__y"] if by_year else [])).orderBy("__q")
    return rows.withColumn("single", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0))).drop("__q", "__y")


def preferred(facts: DataFrame, kind: str, ranks: list[str]) -> DataFrame:
    """One row by (ticker, metric, quarter): of the report kind that comes first in ``ranks``."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(kind)), F.lit(0))
    w = Window.partitionBy("ticker", "metric", "quarter").orderBy(F.when(rank == 0, len(ranks) + 1).otherwise(rank), F.col(kind))
    return facts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def statement_rows(wide: DataFrame, keys: list[str], as_of: Column, n: int = 6) -> DataFrame:
    """The date columns of a wide statement as rows (date, value): the latest ``n`` before ``as_of``."""
    names = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(keys, names, "date", "value").withColumn("date", F.col("date").try_cast("date")).filter(F.col("value").isNotNull() & (F.col("date") < as_of))
    return long.withColumn("__n", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col("date").desc()))).filter(F.col("__n") <= n).drop("__n")


def mapped(x: Column, synonyms: dict[str, str]) -> Column:
    """The standard name of a metric, else its own."""
    pairs = [F.lit(v) for kv in synonyms.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), x), x) if pairs else x


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector at length 1."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), nonzero(length)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.3, vector: str = "embedding", key: str = "vec_id", condition: Column | None = None, first_top: bool = True, most_queries: int = 10_000) -> DataFrame:
    """(query, key, score): cosine top-k of every query against all rows, scores above ``least``.

    ``queries`` (query, vector, ...) is a stated set. ``condition`` compares the columns of a row with q_<column> of the
    query. By default it is applied to the global top k, so fewer may come back, and the pairs are found by products of
    blocks; ``first_top=False`` applies it before: then the queries are broadcast in blocks of ``most_queries``.
    """
    named = lambda df: [F.col(c).alias("query" if c == "query" else f"q_{c}") for c in df.columns if c != vector]
    if condition is None or first_top:
        top = best_pairs(vectors, queries.select(*named(queries), F.col(vector).alias("__q")), k, least, vector, key)
        return top if condition is None else top.filter(condition)
    blocks = max(1, -(-queries.count() // most_queries))
    rows = vectors.withColumn("__u", unit(F.col(vector)))
    out = None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        q = part.select(*named(part), unit(F.col(vector)).alias("__q"))
        pairs = rows.join(F.broadcast(q), F.lit(True)).withColumn("score", dot(F.col("__u"), F.col("__q"))).filter(condition)
        keep = [c for c in pairs.columns if c not in (vector, "__u", "__q")]
        w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col(key))
        top = pairs.select(*keep).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k)
        top = top.filter(F.col("score") > least).drop("__n")
        out = top if out is None else out.unionByName(top)
    return out


def by_tool(items: DataFrame, key: str, tools: str) -> DataFrame:
    """tool -> facts from fact -> tools."""
    return items.select(key, F.explode(tools).alias("tool")).groupBy("tool").agg(F.array_sort(F.collect_set(key)).alias("facts"))


def usage_cost(log: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Tokens and cost by agent from a log (agent, model, input_tokens, output_tokens); prices per million tokens, by
    the exact model name."""
    rate = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, float(p[i]))]), F.col("model"))
    cost = (F.col("input_tokens") * rate(0) + F.col("output_tokens") * rate(1)) / 1e6
    return log.groupBy("agent").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(cost).alias("cost"))


def optional_links(found: DataFrame, edges: DataFrame, labels: dict[str, str], key: str = "fact") -> DataFrame:
    """``found`` with what each fact is linked to by edges (fact, label, name): label -> new column, null where there is no
    such edge; one row for each combination where there are several."""
    for label, new in labels.items():
        found = found.join(edges.filter(F.col("label") == label).select(F.col("fact").alias(key), F.col("name").alias(new)), key, "left")
    return found
