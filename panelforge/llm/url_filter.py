"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame and SQL functions only. The model is fitted by Spark ML on the small
labelled table below (its size does not depend on the data) and applied as one
expression over an array literal of weights, so the judged table is read once,
two columns wide, without a shuffle or Python worker.

Defined cases. A null url, or one without ``://``, has empty host and path, fits
no rule, and is judged by the intercept alone (allow). Ports and user names stay
part of the host. Of fitting rules the longest (host and path together) wins;
equal lengths: the first in order. Repeated rows are judged alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import table

#: (verdict, host, path prefix), the list that the query applies.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BUCKETS, SIZES = 4096, (3, 4, 5)

#: Labelled hosts; labelled() joins them with prefixes, ends and paths. None of them is a host of the sample pages.
UNWANTED_HOSTS = """casinoroyal best-casino online-casino vegas-slots lucky-slots jackpot-city poker-room free-poker
sure-bets bet-now sportsbet betting-tips adult-cams xxx-videos hot-porn pornhq sex-chat nude-pics live-cams
spam-mail link-farm click-farm viagra-shop pharma-pills payday-loans quick-loans get-rich crypto-doubler
free-iphone win-prizes lottery-win warez-zone crack-keys keygen-hub malware-site phish-login hack-tools torrent-warez""".split()
WANTED_HOSTS = """daily-news city-library open-museum river-school garden-club weather-now math-notes history-lab cooking-home
travel-guide bike-tours music-review film-archive science-daily health-advice law-journal tech-blog code-forum data-atlas
photo-album poem-corner green-energy space-watch chess-club rail-times farm-market book-shelf art-house kids-learning wiki-pages
northern thames thistle ringer hearth tinsh stone ander estion rethan handle other reading winter shore
thatch enders theater heron ingle orient sanden ledger atlas entire nation wholen theory blend tenor rationale""".split()
PATHS = ("/", "/en/articles/21", "/fr/825", "/news/2020/03/story.html", "/de/511", "/docs/guide", "/es/103/", "/en/99", "/about", "/blog/post-17.html")
UNWANTED_PATHS = ("/bonus/signup", "/win/free-spins", "/xxx/hot", "/offer/click", "/buy-now/pills", "/casino/play", "/adult/videos", "/betting/odds")
PREFIXES, ENDS = ("", "www.", "blog.", "m."), ("example.com", "example.org", "example.net", "com", "org", "net")

def labelled() -> list[tuple[str, str, int]]:
    """The labelled URL table as (host, path, unwanted) rows. Prefixes, ends and everyday paths are shared out alike
    over both labels, so that what the model learns is in the names."""
    rows = []
    for label, hosts in ((1, UNWANTED_HOSTS), (0, WANTED_HOSTS)):
        for i, host in enumerate(hosts):
            for k in range(4 if i < 80 else 1):
                rows.append((f"{PREFIXES[(i + k) % 4]}{host}.{ENDS[(i + 2 * k + i // 6) % 6]}", PATHS[(i + 3 * k) % len(PATHS)], label))
    rows += [(f"{PREFIXES[i % 4]}{h}.{ENDS[i % 6]}", UNWANTED_PATHS[i % len(UNWANTED_PATHS)], 1) for i, h in enumerate(UNWANTED_HOSTS)]
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    upper = "".join(map(chr, range(65, 91)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(text: Column, mark: str) -> Column:
    """Distinct buckets of the character n-grams of ``text`` between end marks; mark keeps host and path apart."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

    def of(n: int) -> Column:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: (F.crc32(F.concat(F.lit(mark), F.array_join(F.slice(chars, i, n), "")).cast("binary")) % BUCKETS).cast("int"))

    return F.concat(*[of(n) for n in SIZES])


def features(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(_grams(host, "h"), F.when(path == "", F.array().cast("array<int>")).otherwise(_grams(path, "p"))))


@lru_cache(maxsize=4)
def _fitted(rows: tuple, penalty: float) -> tuple[float, tuple[float, ...]]:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    spark = SparkSession.getActiveSession()
    table_ = json.dumps([{"host": h, "path": p, "label": float(y)} for h, p, y in rows])
    given = spark.range(1).select(F.inline(F.from_json(F.lit(table_), "array<struct<host:string,path:string,label:double>>")))
    found = given.select("label", features(F.col("host"), F.col("path")).cast("array<string>").alias("buckets")).repartition(1)
    vectors = CountVectorizerModel.from_vocabulary([str(b) for b in range(BUCKETS)], "buckets", "features", binary=True).transform(found)
    model = LogisticRegression(regParam=penalty, standardization=False, maxIter=60).fit(vectors)
    return model.intercept, tuple(model.coefficients.toArray().tolist())


def score(host: Column, path: Column, rows: list | None = None, penalty: float = 0.0005) -> Column:
    """The probability that a URL is unwanted, by the model fitted on ``rows``."""
    intercept, weights = _fitted(tuple(rows or labelled()), penalty)
    table_ = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate(features(host, path), F.lit(float(intercept)), lambda a, b: a + F.element_at(table_, b + 1))
    return 1 / (1 + F.exp(-total))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, else null."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(ranked):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, score, verdict of every row."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).withColumn("score", score(F.col("host"), F.col("path")))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), by_model).alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLES: dict[str, str] = {}
