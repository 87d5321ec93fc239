"""Text Columns: tickers, timestamps, numbers, lexicon counts, scores, JSON replies, chunks."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words that are never a ticker, the patterns that find one, the
# zones and the score patterns decide results and are stated as they must be.
NEVER_TICKERS = """
NYSE NASDAQ NASD OTC OTCBB TSX LSE AMEX
ET EST EDT PT PST PDT CT CST CDT MT MST MDT GMT UTC BST CET JST
CEO CFO CTO COO CRO CMO CIO CLO
GAAP EBITDA CAPEX OPEX ROI ROE EPS Q1 Q2 Q3 Q4 FY YOY QOQ YTD
USA USD US UK EU CA AU CN JP
INC LLC LTD CORP CO LP PC PLC
THE AND FOR WITH FROM INTO OVER UNDER ABOUT ABOVE BELOW AFTER BEFORE SINCE UNTIL
HTTPS HTTP WWW COM NET ORG GOV EDU
CALL CONF MEET WEBCAST LIVE EVENT
GROUP TEAM STAFF BOARD PANEL
YEAR MONTH WEEK DAY TODAY TOMORROW
MILLION BILLION THOUSAND PERCENT
FIRST SECOND THIRD FOURTH FIFTH SIXTH
GROWTH REVENUE PROFIT MARGIN SALES LOSS
GOOD THANK THANKS HELLO WELCOME PLEASE
CONFERENCE MEETING SESSION PRESENTATION UPDATE
ATION MENT TION SION NESS ABLE IBLE
""".split()
TICKER_PATTERNS = (
    r"\b[A-Za-z][^()]*\(([A-Z]{1,5})\)",
    r"^([A-Z]{2,5})\s+(?:Q[1-4]\s+\d{4}|earnings|call|results|reports|announces)",
    r"(?:NYSE|NASDAQ):\s*([A-Z]{2,5})\b",
    r"(?:Symbol|Ticker):\s*([A-Z]{2,5})\b",
    r"\b([A-Z]{2,5})\s+(?:Incorporated|Inc\.?|Corporation|Corp\.?|Company|Co\.?|Ltd\.?)(?:\s+\([^)]*\))?",
    r"\b([A-Z]{2,5})\s+Q[1-4]\s+\d{4}",
    r"\b([A-Z]{2,5})\s+(?:Reports?|Announces?|Delivers?|Releases?|Beats?|Misses?)",
)
ZONES = {"GMT": "UTC", "UTC": "UTC", "EDT": "America/New_York", "EST": "America/New_York", "ET": "America/New_York", "JST": "Asia/Tokyo"}
SCORE_PATTERNS = (r"[Dd]irection[:\s]*(\d+)", r"[Dd]irectional\s*score[:\s]*(\d+)", r"[Ss]core[:\s]*(\d+)")
UNIT_FACTORS = {("Hundred million", "Ten thousand"): 10000.0, ("Ten thousand", "Hundred million"): 0.0001}
# End of the fixed values.

MARKET_ZONE = "America/New_York"


def _found(x: Column) -> Column:
    return F.when(x != "", x)


def ticker_in_title(title: Column) -> Column:
    """The first one to five capitals in parentheses."""
    return _found(F.regexp_extract(title, r"\(([A-Z]{1,5})\)", 1))


def ticker_in_text(text: Column, prefix: int = 1000) -> Column:
    """By the first pattern with a match of two to five letters that is not a stop word; the head of a transcript names its company."""
    head = F.substring(F.trim(text), 1, prefix)
    found = []
    for p in TICKER_PATTERNS:
        hits = F.transform(F.regexp_extract_all(head, F.lit(f"(?i){p}"), 1), F.upper)
        fits = F.filter(hits, lambda h: h.rlike("^[A-Z]{2,5}$") & ~h.isin(*NEVER_TICKERS))
        found.append(F.try_element_at(fits, F.lit(1)))
    return F.coalesce(*found)


def ticker(title: Column, text: Column) -> tuple[Column, Column]:
    """(ticker, where it was found): the title's, else the text's."""
    a, b = ticker_in_title(title), ticker_in_text(text)
    return F.coalesce(a, b), F.when(a.isNotNull(), "title").when(b.isNotNull(), "transcript")


def has_eastern_zone(x: Column) -> Column:
    return F.coalesce(x.rlike(r"\b(ET|EST|EDT)\b"), F.lit(False))


def eastern_label(x: Column) -> Column:
    """EST and EDT as ET."""
    return F.regexp_replace(x, r"\b(EST|EDT)\b", "ET")


def to_eastern(x: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss ZONE' as market wall time (timestamp without zone); null for N/A or no known zone."""
    zone = F.regexp_extract(x, r"\b(GMT|UTC|EDT|EST|ET|JST)$", 1)
    wall = F.try_to_timestamp(F.regexp_extract(x, r"^\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    out = F.lit(None).cast("timestamp_ntz")
    for name, region in ZONES.items():
        out = F.when(zone == name, F.convert_timezone(F.lit(region), F.lit(MARKET_ZONE), wall)).otherwise(out)
    return out


def plain_text(x: Column) -> Column:
    """ASCII only, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\x00-\x7F]+", " "), r"\s+", " "))


def visible_text(x: Column) -> Column:
    """Without control and zero-width characters; line breaks and tabs stay."""
    return F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F​-‏  ﻿]", "")


def first_number(x: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(x, ",", ""), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def number_unit(x: Column) -> Column:
    """What follows the first number."""
    return F.when(first_number(x).isNotNull(), F.trim(F.regexp_extract(F.regexp_replace(x, ",", ""), r"-?\d+(?:\.\d+)?(.*)$", 1)))


def in_unit(value: Column, have: Column, want: Column) -> Column:
    out = value
    for (a, b), factor in UNIT_FACTORS.items():
        out = F.when((have == a) & (want == b), value * factor).otherwise(out)
    return out


def ticker_head(x: Column) -> Column:
    """The part before a space, a bracket or a dot."""
    return _found(F.regexp_extract(F.trim(x), r"^([^\s(.]+)", 1))


def exchange_code(x: Column) -> Column:
    """Six digits with their exchange in front: SH for those that start with 6 or 9, else SZ."""
    six = F.lpad(x.cast("string"), 6, "0")
    return F.concat(F.when(six.rlike("^[69]"), "SH.").otherwise("SZ."), six)


def words(x: Column) -> Column:
    return F.regexp_extract_all(F.upper(F.coalesce(x, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def lexicon_counts(tokens: Column, positive: list[str], negative: list[str]) -> dict[str, Column]:
    """Counts, polarity, label and ratio of a text's words by short word lists (long ones: ``lexicon_scores``)."""
    p, n = F.size(F.filter(tokens, lambda t: t.isin(*positive))), F.size(F.filter(tokens, lambda t: t.isin(*negative)))
    return {
        "positive": p, "negative": n, "words": F.size(tokens), "polarity": p - n,
        "label": F.when(p > n, "Positive").when(p < n, "Negative").otherwise("Neutral"),
        "ratio": F.coalesce(F.try_divide(p - n, F.size(tokens)), F.lit(0.0)),
    }


def lexicon_scores(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """The same by a lexicon table (word, sign): words are counted by row first, then joined."""
    counts = df.select(key, F.explode(words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("c"))
    signed = counts.join(lexicon.select(F.upper("word").alias("word"), "sign"), "word", "left")
    return signed.groupBy(key).agg(F.sum("c").alias("words"), F.coalesce(F.sum(F.col("c") * F.col("sign")), F.lit(0)).alias("polarity"))


def directional_score(note: Column) -> Column:
    """The first score from 0 to 10 by the patterns in order."""
    found = []
    for p in SCORE_PATTERNS:
        v = F.regexp_extract(note, p, 1).try_cast("int")
        found.append(F.when(v.between(0, 10), v))
    return F.coalesce(*found)


def direction(x: Column, limit: float) -> Column:
    return F.when(x > limit, 1).otherwise(-1)


def numbered_scores(reply: Column, n: int = 50, fill: float = 5.0) -> Column:
    """The values of 'n. score' pairs in order of appearance, within 0..10, padded with ``fill`` to ``n``."""
    got = F.transform(F.regexp_extract_all(reply, F.lit(r"\d+\.\s*(\d+(?:\.\d+)?)"), 1), lambda v: F.least(F.greatest(v.cast("double"), F.lit(0.0)), F.lit(10.0)))
    return F.slice(F.concat(F.coalesce(got, F.array().cast("array<double>")), F.array_repeat(F.lit(fill), n)), 1, n)


def json_body(reply: Column) -> Column:
    """The fenced JSON of a reply, else from the first brace to the last."""
    fenced = _found(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1))
    return F.coalesce(fenced, _found(F.regexp_extract(reply, r"(?s)(\{.*\})", 1)))


REPLY = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("date", T.StringType()), T.StructField("scores", T.ArrayType(T.DoubleType()))])


def scored_reply(reply: Column, n: int = 50) -> Column:
    """The parsed reply if it names ticker and date and has ``n`` scores from 0 to 10, else null."""
    r = F.from_json(json_body(reply), REPLY)
    whole = r["ticker"].isNotNull() & r["date"].isNotNull() & (F.size(r["scores"]) == n) & F.forall(r["scores"], lambda s: s.between(0, 10))
    return F.when(whole, r)


def looks_complete(text: Column) -> Column:
    """Braces and brackets balance and the text ends with a closing one."""
    count = lambda ch: F.length(text) - F.length(F.translate(text, ch, ""))
    return (count("{") == count("}")) & (count("[") == count("]")) & F.trim(text).rlike(r"[}\]]$")


def task_section(reply: Column, k: int) -> Column:
    """What a reply says under 'Task k:'."""
    return _found(F.regexp_replace(F.regexp_extract(reply, rf"(?s)Task {k}:(.*?)(?=Task {k + 1}:|\z)", 1), r"^\s+|\s+$", ""))


def word_chunks(text: Column, size: int = 100) -> Column:
    """The words of a text in chunks of ``size``."""
    words = F.filter(F.split(text, r"\s+"), lambda t: t != "")

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))

    # The words are bound by an outer lambda: inside an inner one the split would be done again for every chunk.
    return F.transform(F.array(words), cut)[0]


def fields(block: Column) -> Column:
    """A map of the 'key: value' lines of a block, as of list items."""
    lines = F.filter(F.split(block, r"\n"), lambda line: line.rlike(r"^[\s*\-]*\**\w[\w ]*\**\s*:"))
    part = lambda i: F.transform(lines, lambda line: F.trim(F.regexp_replace(F.regexp_extract(line, r"^[\s*\-]*\**(\w[\w ]*?)\**\s*:\**\s*(.*)$", i), r"\*+$", "")))
    return F.map_from_entries(F.array_distinct(F.arrays_zip(F.transform(part(1), F.lower), part(2))))


def sections(text: Column, header: str) -> Column:
    """The parts of a text under each header that the pattern ``header`` matches."""
    return F.filter(F.transform(F.slice(F.split(text, header), 2, 1 << 30), F.trim), lambda s: s != "")


def without_common_chunks(df: DataFrame, text: str, other: str, new: str, size: int = 100, similarity: float = 0.8) -> DataFrame:
    """Drops the chunks of ``text`` whose matching-blocks ratio to some chunk of ``other`` reaches ``similarity``.

    The worker cuts the chunks of ``word_chunks`` itself: Spark may not know a Python function with lambdas in its
    arguments again when it plans it, and then tries to evaluate it in the JVM."""

    def chunks(t) -> list[str]:
        words = [] if t is None else re.findall(r"[^ \t\n\x0b\f\r]+", t)
        return [" ".join(words[i : i + size]) for i in range(0, len(words), size)]

    @F.pandas_udf(T.StringType())
    def kept(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(mine, theirs) -> str:
            out = []
            for chunk in mine:
                m = difflib.SequenceMatcher(None, "", chunk, autojunk=False)
                for o in theirs:
                    m.set_seq1(o)
                    if m.real_quick_ratio() >= similarity and m.quick_ratio() >= similarity and m.ratio() >= similarity:
                        break
                else:
                    out.append(chunk)
            return " ".join(out)

        return pd.Series([one(chunks(x), chunks(y)) for x, y in zip(a, b, strict=True)])

    return df.withColumn(new, kept(F.col(text), F.col(other)))


def first_words(text: Column, n: int) -> Column:
    """The first ``n`` white-space separated words, a stand-in for cutting at a number of model tokens."""
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda t: t != ""), 1, n), " ")


@F.pandas_udf(T.StringType())
def compatible_text(x: pd.Series) -> pd.Series:
    """Unicode compatibility form (NFKD), without control and zero-width characters."""
    import unicodedata

    def one(t):
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if c in "\n\t\r" or unicodedata.category(c) not in ("Cc", "Cf"))

    return x.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def char_chunks(x: pd.Series, size: pd.Series) -> pd.Series:
    """Chunks of at most ``size`` characters, cut at the last white space where there is one."""

    def one(t, n):
        if t is None:
            return None
        out, t = [], t.strip()
        while len(t) > n:
            at = t.rfind(" ", 0, n + 1)
            at = at if at > 0 else n
            out.append(t[:at].rstrip())
            t = t[at:].lstrip()
        return out + [t] if t else out

    return pd.Series([one(t, int(n)) for t, n in zip(x, size, strict=True)])


@F.pandas_udf(T.StringType())
def repaired_json(x: pd.Series) -> pd.Series:
    """JSON text with common slips mended (typographic quotes, trailing commas, bare keys, open ends); null if it still
    does not parse."""
    import json
    import re

    def one(t):
        if t is None:
            return None
        t = t.strip().translate({0x201C: '"', 0x201D: '"', 0x2018: "'", 0x2019: "'"})
        t = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', t)
        t = re.sub(r",\s*([}\]])", r"\1", t)
        closing = []
        for c in re.sub(r'"(?:[^"\\]|\\.)*"', "", t):
            if c in "{[":
                closing.append("}" if c == "{" else "]")
            elif c in "}]" and closing:
                closing.pop()
        t = re.sub(r",\s*$", "", t) + "".join(reversed(closing))
        try:
            json.loads(t)
        except ValueError:
            return None
        return t

    return x.map(one)


# The patterns of report fields, in order.
REPORT_TICKERS = (r"\b([A-Z]{1,5})\s+(?:US|HK|LN|TT|CH|SS|SZ)", r"\b([A-Z]{2,5})\s*\.\s*(?:US|HK|L|T|SS|SZ)", r"\(([A-Z]{1,5})\)", r"\b([A-Z]{1,5})\s+Inc", r"\b([A-Z]{1,5})\s+Corp", r"\b([A-Z]{1,5}\.[A-Z]{1,2})\b")
REPORT_DATES = (r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})", r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{4})", r"\b(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{4})", r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{1,2},?\s+\d{4})")
REPORT_ANALYSTS = (r"(?:by|analyst|author)[:]\s*([A-Z][a-z]+\s+[A-Z][a-z]+)", r"\b([A-Z][a-z]+\s+[A-Z][a-z]+),?\s+(?:analyst|research)", r"(?:contact|analyst)[:]\s*([A-Z][a-z]+\s+[A-Z][a-z]+)", r"([A-Z][a-z]+\s+[A-Z][a-z]+)\s*,\s*(?:CFA|analyst)")
REPORT_EMAIL = r"([a-z.]+)@[a-z.]+\.com"
REPORT_TARGETS = {
    "price_target_mid": (r"(?:price target|target price|PT)[:]\s*\$?(\d+(?:\.\d+)?)", r"(?:base case|mid case)[:]\s*\$?(\d+(?:\.\d+)?)"),
    "price_target_bull": (r"(?:bull case|upside|optimistic)[:]\s*\$?(\d+(?:\.\d+)?)",),
    "price_target_bear": (r"(?:bear case|downside|pessimistic)[:]\s*\$?(\d+(?:\.\d+)?)",),
    "eps_target_mid": (r"(?:EPS|earnings per share)[:]\s*\$?(\d+(?:\.\d+)?)", r"(?:base case EPS|mid case EPS)[:]\s*\$?(\d+(?:\.\d+)?)"),
    "eps_target_bull": (r"(?:bull case EPS|upside EPS)[:]\s*\$?(\d+(?:\.\d+)?)",),
    "eps_target_bear": (r"(?:bear case EPS|downside EPS)[:]\s*\$?(\d+(?:\.\d+)?)",),
}
REPORT_ESTIMATES = {"% Change YoY": "revenue|sales", "Operating Profit": "operating profit|EBIT", "Operating Costs": "operating costs|expenses", "Year-end AuM's (ex JVs)": "AuM|assets under management", "Flows": "flows|net flows", "Free Float": "free float"}
# End of the fixed values.


def report_fields(text: Column) -> dict[str, Column]:
    """The fields of a research note by patterns: tickers and analysts (sorted), date, price and earnings targets (null
    where there is none), and a map of estimates. Names and dates stand in the note's head."""
    head, wider = F.substring(text, 1, 1000), F.substring(text, 1, 1500)
    every = lambda x, p: F.regexp_extract_all(x, F.lit(p), 1)
    tickers = F.filter(F.flatten(F.array(*[every(head, p) for p in REPORT_TICKERS])), lambda t: F.length(t) >= 2)
    dates = F.coalesce(*[_found(F.regexp_extract(head, f"(?i){p}", 1)) for p in REPORT_DATES], F.lit(""))
    named = F.flatten(F.array(*[every(wider, f"(?i){p}") for p in REPORT_ANALYSTS]))
    mailed = F.transform(every(wider, f"(?i){REPORT_EMAIL}"), lambda x: F.initcap(F.replace(x, F.lit("."), F.lit(" "))))
    analysts = F.filter(F.concat(named, mailed), lambda a: F.size(F.filter(F.split(a, r"\s+"), lambda w: w != "")) == 2)
    first = lambda p: _found(F.regexp_extract(text, f"(?i){p}", 1))
    targets = {k: F.coalesce(*[first(p).try_cast("double") for p in patterns]) for k, patterns in REPORT_TARGETS.items()}
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.trim(F.regexp_extract(text, rf"(?i)(?:{p})[:]\s*([+\-]?\d*\.?\d*%?[+\-]*)", 1)).alias("value")) for k, p in REPORT_ESTIMATES.items()])
    estimates = F.map_from_entries(F.filter(pairs, lambda e: e["value"] != ""))
    return {"tickers": F.array_sort(F.array_distinct(tickers)), "date": dates, "analysts": F.array_sort(F.array_distinct(analysts)), **targets, "estimates": estimates}


def masked(text: Column, spans: Column, masks: dict[str, str]) -> Column:
    """The text with every span (start, end, label; code points, end exclusive, not overlapping) whose label has a mask
    replaced by it, from the last to the first. The spans come from whatever tagger there is."""
    table = F.create_map(*[F.lit(x) for kv in masks.items() for x in kv])
    known = F.filter(F.array_sort(spans), lambda s: F.try_element_at(table, s["label"]).isNotNull())
    cut = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.element_at(table, s["label"]), F.substring(t, s["end"] + 1, F.length(t)))
    return F.aggregate(F.reverse(known), text, cut)


def series_file(x: Column) -> Column:
    """'SZ.301365.csv' as '301365_transformed.parquet'."""
    return F.concat(F.replace(F.try_element_at(F.split(x, r"\."), F.lit(2)), F.lit(".csv"), F.lit("")), F.lit("_transformed.parquet"))
