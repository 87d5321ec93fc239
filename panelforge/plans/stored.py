"""Queries of what is kept between runs or fitted first: vector index, graph store, upsert log, frozen ranks, .npy files."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.panel import KEYS
from panelforge.operators import book as O
from panelforge.operators import frozen as Z
from panelforge.operators import signals as S
from panelforge.operators import vector_index as V
from panelforge.plans import flows
from panelforge.plans.catalogue import BARS_SQL, FACTS_SQL, MOMENTUM, ORACLES, QUERIES, SERIES, call, facts, query, stamp, table, weekly_bars  # noqa: F401
from panelforge.sources.npy import NpySource
from panelforge.sources.scratch import shared_folder, written
from panelforge.sources.store import GraphStore
from panelforge.streaming import stream as T
from panelforge.streaming import upsert as U


def _index(spark, sf_dir):
    """(index, centres, facts, queries): facts of a ticker (label) in one of twelve quarters; every 20th row asks."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("ticker"), (F.col("vec_id") % 12).alias("q"), "embedding")
    centres = V.fitted_centres(rows, 32)
    index = V.build(rows, centres, shared_folder(spark))
    return index, centres, rows, rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query")


@query(
    "similar_history",
    """WITH u AS (SELECT vec_id, label AS ticker, vec_id % 12 AS q, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings),
a AS (SELECT * FROM u WHERE vec_id % 20 = 0),
p AS (SELECT a.vec_id AS query, u.vec_id, list_sum(list_transform(list_zip(u.embedding, a.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / u.n / a.n AS score FROM a JOIN u ON u.ticker = a.ticker AND u.q < a.q),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS k FROM p WHERE score > 0.3)
SELECT query, vec_id, round(score + 1e-8, 5) + 0.0 AS score, 'similar' AS found FROM t WHERE k <= 5
UNION ALL SELECT a.vec_id, u.vec_id, 1.0, 'year before' FROM a JOIN u ON u.ticker = a.ticker AND u.q = a.q - 4""",
)
def similar_history(spark, sf_dir):
    """The five most similar facts of the same ticker's earlier quarters, by all lists of the index, and those of a year before."""
    index, centres, rows, asked = _index(spark, sf_dir)
    earlier = (F.col("ticker") == F.col("q_ticker")) & (F.col("q") < F.col("q_q"))
    found = V.search(index, centres, asked, 5, len(centres), 0.3, earlier)
    out = V.with_year_before(found, rows, asked)
    return out.select("query", "vec_id", (F.round(F.col("score") + 1e-8, 5) + F.lit(0.0)).alias("score"), "found")


@query("index_recall", "SELECT count(*) FILTER (vec_id % 20 = 0) AS queries, count(*) AS indexed, true AS enough FROM embeddings")
def index_recall(spark, sf_dir):
    """Rows that ask, rows in the index, and whether probing three quarters of its lists finds nine tenths of the true ten
    nearest. These vectors lie in all directions alike, so a few lists do not do (8 of 32 find 0.66 to 0.78)."""
    index, centres, rows, asked = _index(spark, sf_dir)
    got = V.recall(V.search(index, centres, asked, 10, 24, -2.0), V.search(index, centres, asked, 10, len(centres), -2.0))
    counts = index.agg(F.count(F.lit(1)).alias("indexed")).crossJoin(asked.agg(F.count(F.lit(1)).alias("queries")))  # one row each
    return counts.crossJoin(got).select("queries", "indexed", (F.col("recall") >= 0.9).alias("enough"))


MERGED_SQL = FACTS_SQL + """, l AS (SELECT 'Ticker' AS label, CAST(ticker AS VARCHAR) AS name FROM f UNION ALL SELECT 'Quarter', quarter FROM f UNION ALL SELECT 'Metric', metric FROM f)
SELECT label, name, count(*) AS links FROM l GROUP BY ALL UNION ALL SELECT 'Value', NULL, count(*) FROM f WHERE value IS NOT NULL UNION ALL SELECT 'Fact', NULL, count(*) FROM f"""


@query("merged_graph", MERGED_SQL)
def merged_graph(spark, sf_dir):
    """Facts merged into a stored graph in three batches, out of order, two of them overlapping and one replayed."""
    rows = written(facts(spark, sf_dir).withColumn("reason", F.lit(None).cast("string")))
    third = F.pmod(F.xxhash64("ticker", "quarter", "metric"), F.lit(3))
    store = GraphStore(spark, shared_folder(spark), 8)
    for name, own in (("c", third == 2), ("a", third <= 1), ("c", third == 2), ("b", third >= 1)):
        store.merge(name, rows.filter(own))
    nodes, edges = store.table("nodes"), store.table("edges")
    links = edges.groupBy("label", "name").agg(F.count(F.lit(1)).alias("links"))
    named = nodes.filter("label IN ('Ticker', 'Quarter', 'Metric')").join(links, ["label", "name"])
    values = links.filter("label = 'Value'").agg(F.sum("links").alias("links")).select(F.lit("Value").alias("label"), F.lit(None).cast("string").alias("name"), "links")
    whole = nodes.filter("label = 'Fact'").agg(F.count(F.lit(1)).alias("links")).select(F.lit("Fact").alias("label"), F.lit(None).cast("string").alias("name"), "links")
    return named.unionByName(values).unionByName(whole)


@query("upsert_log", "SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM (SELECT * FROM events ORDER BY ts, event_id) GROUP BY 1")
def upsert_log(spark, sf_dir):
    """The latest event of every user, through a log that is fed in three goes, out of order, with a restart between them."""
    base = shared_folder(spark)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    for go in (1, 2, 0):
        events.filter(F.col("event_id") % 3 == go).write.mode("append").parquet(f"{base}/feed")
        feed = T.read_events(spark, f"{base}/feed", events.schema)
        U.upsert(feed, "user_id", F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"), f"{base}/log", f"{base}/state")
    return U.current(spark.read.schema(U.CHANGE).parquet(f"{base}/log"), "user_id bigint, event_id bigint, event_type string, value double")


@query("unprocessed_users", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 50)")
def unprocessed_users(spark, sf_dir):
    """Users that a log of processed ones lacks."""
    base = shared_folder(spark)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    events.filter("event_type = 'signup' AND value > 50").write.parquet(f"{base}/feed")
    U.upsert(T.read_events(spark, f"{base}/feed", events.schema), "user_id", F.col("event_id"), F.lit(0), f"{base}/log", f"{base}/state")
    return U.pending(events.select("user_id").distinct(), "user_id", spark.read.schema(U.CHANGE).parquet(f"{base}/log"))


TRAIN = "event_id % 2 = 0"


@query("streamed_rank", f"WITH r AS (SELECT event_id, sum(CAST({TRAIN} AS INTEGER)) OVER (ORDER BY value RANGE UNBOUNDED PRECEDING) - sum(CAST({TRAIN} AS INTEGER)) OVER (PARTITION BY value) AS below, (SELECT count(*) FROM events WHERE {TRAIN} AND value IS NOT NULL) AS n FROM events WHERE value IS NOT NULL) SELECT event_id, round(below / n + 1e-9, 6) AS rank FROM r")
def streamed_rank(spark, sf_dir):
    """The share of training values below every value of a stream, by a join with frozen ranges."""
    events = table(spark, sf_dir, "events")
    frozen = Z.frozen_counts(events.filter(TRAIN), "value", each=100)
    base = shared_folder(spark)
    rows = T.read_events(spark, f"{sf_dir}/event[s].parquet", events.schema).filter("value IS NOT NULL")
    T.into_table(Z.placed(rows, frozen, "value").select("event_id", (F.col("below") / F.col("total")).alias("rank")), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("event_id", F.round(F.col("rank") + 1e-9, 6).alias("rank"))


@query(
    "fitted_rank",
    """WITH e AS (SELECT *, ts < TIMESTAMP '2024-01-21' AS train FROM events WHERE value IS NOT NULL),
r AS (SELECT event_id, train, sum(CAST(train AS INTEGER)) OVER (PARTITION BY event_type ORDER BY value RANGE UNBOUNDED PRECEDING) - sum(CAST(train AS INTEGER)) OVER (PARTITION BY event_type, value) AS below,
sum(CAST(train AS INTEGER)) OVER (PARTITION BY event_type, value) AS same, sum(CAST(train AS INTEGER)) OVER (PARTITION BY event_type) AS n FROM e)
SELECT event_id, round((below + CASE WHEN train THEN same / 2 ELSE 0.5 END) / n + 1e-9, 6) AS rank FROM r""",
)
def fitted_rank(spark, sf_dir):
    """Ranks by event type, fitted on the first twenty days: average ranks there, places among them later."""
    events = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    out = Z.fitted_ranks(events, F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz"), "value", ["event_type"])
    return out.select("event_id", F.round(F.col("rank") + 1e-9, 6).alias("rank"))


LEAK_DAYS = "(VALUES (DATE '1996-01-01'), (DATE '1997-06-02'), (DATE '1999-03-01')) v(day)"


@query("leak_report", BARS_SQL + f", n AS (SELECT *, lead(ts) OVER {SERIES} AS after FROM bars) SELECT 'peeking' AS factor, 'leak' AS status, (SELECT count(*) FROM n JOIN {LEAK_DAYS} ON n.ts = v.day WHERE after IS NOT NULL) AS changes UNION ALL SELECT unnest(['momentum', 'level']), 'clean', 0 UNION ALL SELECT unnest(['unknown call', 'missing column']), 'error', NULL")
def leak_report(spark, sf_dir):
    """A dictionary of clean, peeking and erroring factors, judged in one job."""
    import datetime

    factors = {
        "momentum": MOMENTUM, "level": call("cs_rank", "volume"), "peeking": lambda df, new: df.withColumn(new, F.lead("close").over(KEYS.series())),
        "unknown call": call("no_such_call", "close"), "missing column": lambda df, new: df.withColumn(new, F.col("no_such_column")),
    }
    times = [datetime.date(1996, 1, 1), datetime.date(1997, 6, 2), datetime.date(1999, 3, 1)]
    return flows.leak_report(weekly_bars(spark, sf_dir), factors, ["close"], times, tolerance=0.0)


HOURS_SQL = """WITH h AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS hour, last(value ORDER BY ts, event_id) AS p FROM events GROUP BY ALL),
g AS (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS pos FROM (SELECT DISTINCT hour FROM h)),
r AS (SELECT h.ticker, g.pos, CASE WHEN h.ticker = 'view' AND h.p < 20 THEN -1 ELSE h.p / lag(h.p) OVER (PARTITION BY h.ticker ORDER BY h.hour) - 1 END AS r FROM h JOIN g USING (hour)),
c AS (SELECT event_id, ts, CASE WHEN user_id % 7 = 0 THEN 'none' ELSE ['click', 'error', 'purchase', 'signup', 'view'][user_id % 5 + 1] END AS ticker,
date_trunc('hour', ts) + CASE WHEN ts > date_trunc('hour', ts) THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS up FROM events WHERE event_type = 'signup'),
t AS (SELECT c.*, (SELECT min(pos) FROM g WHERE g.hour >= c.up) AS pos, c.ticker IN (SELECT ticker FROM h) AS known, (SELECT count(*) FROM g) AS n FROM c),
x AS (SELECT t.event_id, t.ticker, t.pos, any_value(known) AS known, any_value(n) AS n, coalesce(product(1 + r.r) FILTER (r.pos <= t.pos + 20), 1) - 1 AS a, coalesce(product(1 + r.r), 1) - 1 AS b
FROM t LEFT JOIN r ON r.ticker = t.ticker AND r.pos > t.pos AND r.pos <= t.pos + 40 AND r.r IS NOT NULL GROUP BY t.event_id, t.ticker, t.pos)
SELECT event_id, CASE WHEN known THEN strftime(g.hour, '%Y-%m-%d %H:%M:%S') END AS t, CASE WHEN known AND x.pos + 20 < n THEN round(a + 1e-8, 4) + 0.0 END AS return_20, CASE WHEN known AND x.pos + 40 < n THEN round(b + 1e-8, 4) + 0.0 END AS return_40 FROM x LEFT JOIN g ON g.pos = x.pos"""


@query("horizon_returns", HOURS_SQL)
def horizon_returns(spark, sf_dir):
    """Compounded hourly returns over T+1..T+20 and T+1..T+40 after every signup; a view below 20 is a total loss."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    hours = e.groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("hour")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("p"))
    change = F.try_divide("p", F.nullif(F.lag("p").over(Window.partitionBy("ticker").orderBy("hour")), F.lit(0.0))) - 1
    returns = hours.withColumn("r", F.when((F.col("ticker") == "view") & (F.col("p") < 20), F.lit(-1.0)).otherwise(change))
    names = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    calls = e.filter("event_type = 'signup'").select("event_id", "ts", F.when(F.col("user_id") % 7 == 0, "none").otherwise(F.get(names, (F.col("user_id") % 5).cast("int"))).alias("ticker"))
    out = S.horizon_returns(calls, returns, "ticker", "ts", "hour", "r", [20, 40])
    r4 = lambda c: (F.round(F.col(c) + 1e-8, 4) + F.lit(0.0)).alias(c)
    return out.select("event_id", stamp("T_timestamp").alias("t"), r4("return_20"), r4("return_40"))


@query("ticker_flow", "WITH d AS (SELECT doc_id % 3 = 0 AND lang IS NOT NULL AS a, doc_id % 5 = 0 AND lang IS NOT NULL AS b, doc_id % 4 <> 2 AS z FROM documents) SELECT count(*) AS original_rows, count(*) FILTER (NOT (a OR b)) AS no_ticker_dropped, count(*) FILTER ((a OR b) AND NOT z) AS non_et_timezone_dropped, count(*) FILTER ((a OR b) AND z) AS final_rows, count(*) FILTER (a) AS title_source_count, count(*) FILTER (b AND NOT a) AS transcript_source_count FROM d")
def ticker_flow(spark, sf_dir):
    """Counts of the ticker flow over all documents, gathered while it writes what it keeps."""
    code = F.upper(F.substring("lang", 1, 2))
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Report ("), code, F.lit(") of the year"))).alias("title"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Acme, NASDAQ: "), code, F.lit("QZ, speaks"))).alias("text"),
        F.concat(F.lit("2024-01-01 10:00:00 "), F.get(F.array(*[F.lit(z) for z in ("ET", "EDT", "GMT", "EST")]), (F.col("doc_id") % 4).cast("int"))).alias("stamp"),
    )
    return flows.with_tickers(d, "title", "text", "stamp", shared_folder(spark))


@query("npy_scan", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) + 1e-8, 5) + 0.0 AS total, round(CAST(embedding[3] AS DOUBLE), 6) AS third FROM embeddings")
def npy_scan(spark, sf_dir):
    """Embeddings written as .npy matrices (the id as first column), read in row ranges, whole and one column of them."""
    spark.dataSource.register(NpySource)
    path = shared_folder(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>")).alias("values"))
    rows.write.format("npy").mode("append").save(path)
    whole = spark.read.format("npy").option("rows", 200).load(path)
    third = spark.read.format("npy").option("rows", 300).option("columns", "3").load(path).select("file", "row", F.col("values")[0].alias("third"))
    both = whole.join(third, ["file", "row"])
    total = F.aggregate(F.slice("values", 2, 1_000_000), F.lit(0.0), lambda a, x: a + x)
    return both.select(F.col("values")[0].cast("long").alias("vec_id"), (F.round(total + 1e-8, 5) + F.lit(0.0)).alias("total"), F.round("third", 6).alias("third"))


@query(
    "day_blocks",
    """WITH d AS (SELECT DISTINCT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS day FROM orders),
n AS (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY ticker) AS days FROM d),
b AS (SELECT *, len(list_filter(range(0, 61), lambda i: floor(i * (days / 60.0::DOUBLE)) <= k)) - 1 AS block FROM n WHERE days >= 60)
SELECT o_orderkey, CAST(block AS INTEGER) AS block, CASE WHEN block % 2 = 1 THEN 'train' WHEN block / 2 < 15 THEN 'valid' ELSE 'test' END AS split
FROM orders JOIN b ON ticker = o_orderpriority AND day = CAST(o_orderdate AS DATE)""",
)
def day_blocks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return O.day_blocks(orders, "o_orderdate", "o_orderpriority").select("o_orderkey", "block", "split")
