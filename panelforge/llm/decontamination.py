"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of test items.

The test items are the index; every passage of every training document is a
query. Passages are windows of words, half overlapping, wide enough that a run of
one and a half times the longest item lies whole in one of them.

An item's threshold is proved from the overlap looked for: a passage that holds
four fifths of the item's five-word shingles lacks at most so many of its words,
and even without the heaviest of those its BM25 score reaches the threshold. So
retrieving all passages above it misses none. Items are grouped in blocks; the
index keeps, for each term and block, the largest impact. A passage skips a block
when the sum of its terms' block maxima stays below the block's least threshold;
the most frequent terms, whose maxima together cannot decide, enter as a constant
of the block, so that only the occurrences of the other terms are looked at. What
is left is scored in full, and the shingles of question (all sentences but the
last) and answer (the last) are counted in the passage. A document is contaminated
when some passage holds ``overlap`` of an item's shingles, and PART of those of its
question and of its answer each.

The pruning is WAND's test (upper bounds against a threshold) on block maxima; as
thousands of passages are queries at once, it is made for all passages and blocks
together, as sums over arrays, and not with a pivot that moves through one query's
lists. What it lets pass is the same.

The index is broadcast in parts of bounded size (``ITEMS_PER_INDEX`` items); a
larger benchmark is searched part by part in one chain of maps.

Defined cases. Items without words are never found; items shorter than five words
count as one shingle. Null or empty texts hold nothing. Repeated rows are judged
alike, ties between items go to the smaller id, an empty table gives an empty
result, an empty benchmark contaminates nothing, other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import mapped, slices, solid, table, whole, words

SHINGLE, OVERLAP, PART, K1, B = 5, 0.8, 0.5, 1.2, 0.75
BLOCK_ITEMS, ITEMS_PER_INDEX = 16, 20_000
EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
SENTENCES = regex.compile(r"(?<=[.!?])\s+|\n+")


def bare(word: str) -> str:
    return word if word.isalnum() else EDGES.sub("", word)


def plain_words(text: str) -> list[str]:
    """The lower-case words of a text without punctuation at their edges."""
    lower = pc.utf8_lower(pa.scalar(text, pa.large_string())).as_py()  # as ``plain`` does: str.lower differs on a few letters
    return [b for w in lower.split() if (b := bare(w))]


def word_shingles(tokens: list[str]) -> list[tuple[str, ...]]:
    """The shingles at each place; a shorter sequence is one shingle."""
    return [tuple(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))] if tokens else []


class Index:
    """An inverted index of items with impacts, block maxima and thresholds; plain arrays, made to be broadcast."""

    def __init__(self, items: list[tuple[int | None, str]], overlap: float = OVERLAP):
        kept = [(i, t, plain_words(t)) for i, t in items]
        kept = [x for x in kept if x[2]]
        self.overlap = overlap
        self.longest = max((len(x[2]) for x in kept), default=0)
        df = Counter(w for _, _, t in kept for w in set(t))
        # Frequent terms first, so that a prefix of the numbers can be set aside.
        self.terms = {w: n for n, w in enumerate(sorted(df, key=lambda w: (-df[w], w)))}
        # Items with the same frequent terms stand together: their block's maxima say more.
        kept.sort(key=lambda x: (sorted(self.terms[w] for w in set(x[2]))[:4], x[0] is None, x[0] or 0))
        self.ids = [x[0] for x in kept]
        n, mean = len(kept), sum(len(x[2]) for x in kept) / max(1, len(kept))
        self.item_terms, self.impacts, self.least, self.shingles, self.answers = [], [], [], [], []
        for _, text, tokens in kept:
            tf = Counter(tokens)
            norm = K1 * (1 - B + B * len(tokens) / mean)
            numbers = np.array(sorted(self.terms[w] for w in tf), np.int64)
            by_number = {self.terms[w]: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            impact = np.array([by_number[k] for k in numbers])
            at = Counter(word_shingles(tokens))
            # Shingles that may be missing, each with all its places; so many words may be missing at most.
            may_miss = int(len(at) - np.ceil(overlap * len(at) - 1e-9))
            gone = sum(sorted(at.values(), reverse=True)[:may_miss])
            self.item_terms.append(numbers)
            self.impacts.append(impact)
            self.least.append(float(np.sort(impact)[: max(0, len(impact) - gone)].sum()) * (1 - 1e-9))
            self.shingles.append(frozenset(at))
            last = plain_words(SENTENCES.split(text.strip())[-1])
            self.answers.append(frozenset(word_shingles(tokens)[-max(1, len(last) - SHINGLE + 1) :]) if last else frozenset())
        self.sizes = {len(x) for s in self.shingles for x in s}
        self._block()

    def _block(self) -> None:
        n, terms = len(self.ids), len(self.terms)
        blocks = -(-n // BLOCK_ITEMS)
        least = np.array(self.least)
        self.block_least = np.array([least[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS].min() for b in range(blocks)])
        # Postings by term: the item and its impact; and the largest impact of each block.
        item = np.repeat(np.arange(n), [len(t) for t in self.item_terms]) if n else np.zeros(0, np.int64)
        term, impact = (np.concatenate(x) if n else np.zeros(0) for x in (self.item_terms, self.impacts))
        order = np.lexsort((item, term))
        self.post_item, term, self.post_impact = item[order], term[order].astype(np.int64), impact[order]
        self.post_start = np.searchsorted(term, np.arange(terms + 1))
        keys, inverse = np.unique(term * max(1, blocks) + self.post_item // BLOCK_ITEMS, return_inverse=True)
        self.block_max = np.zeros(len(keys))
        np.maximum.at(self.block_max, inverse, self.post_impact)
        self.block_of = keys % max(1, blocks)
        self.block_start = np.searchsorted(keys // max(1, blocks), np.arange(terms + 1))
        # Frequent terms are set aside as long as no item's share of them nears its threshold.
        self.deciding, self.constant = np.ones(terms, bool), np.zeros(n)
        for t in range(terms):
            part = slice(self.post_start[t], self.post_start[t + 1])
            if part.stop - part.start <= max(2, n // 50):
                break
            i = self.post_item[part]
            if (self.constant[i] + self.post_impact[part] <= 0.7 * least[i]).all():
                self.constant[i] += self.post_impact[part]
                self.deciding[t] = False
        self.block_constant = np.array([self.constant[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS].max() for b in range(blocks)])

    def _summed(self, half, term, start, target, value, size, wanted=None):
        """Sums over the occurrences (half, term) by window and posting target; a window is its half and the next one,
        so an occurrence counts for its own half's window and the one before. ``wanted`` picks the keys to sum."""
        counts = start[term + 1] - start[term]
        which = np.repeat(start[term] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        at = np.repeat(half, counts) * size + target[which]
        at, value = np.concatenate([at, at - size]), np.tile(value[which], 2)
        if wanted is not None:
            keep = wanted(at)
            at, value = at[keep], value[keep]
        keys, inverse = np.unique(at, return_inverse=True)
        return keys, np.bincount(inverse, value, len(keys))

    def search(self, tokens: np.ndarray, rows: np.ndarray, vocab: list[str]) -> list[tuple[int, int, float, float, float, float]]:
        """(text, item place, score, overlap, of the question, of the answer) of every passage above an item's
        threshold whose shingles confirm it. ``tokens`` are numbers into ``vocab``, ``rows`` their texts, in order."""
        if not len(tokens) or not self.ids:
            return []
        stride = max(32, -(-3 * self.longest // 2))
        number = np.array([self.terms.get(w, -1) for w in vocab], np.int64)[tokens]
        first = np.searchsorted(rows, rows, side="left")
        # Half windows are numbered through; a text takes one more than it has, so that windows never span texts.
        halves_of = np.bincount(rows, minlength=int(rows[-1]) + 1)
        base = np.concatenate([[0], np.cumsum(-(-halves_of // stride) + 1)])[rows]
        half = base + (np.arange(len(tokens)) - first) // stride
        inside = number >= 0
        inside[inside] = self.deciding[number[inside]]
        pairs = np.unique(half[inside] * len(self.terms) + number[inside])
        halves, terms = pairs // len(self.terms), pairs % len(self.terms)
        blocks, n = len(self.block_least), len(self.ids)
        keys, total = self._summed(halves, terms, self.block_start, self.block_of, self.block_max, blocks)
        passed = keys[(keys >= 0) & (total + self.block_constant[keys % blocks] >= self.block_least[keys % blocks])]
        if not len(passed):
            return []
        # The windows and blocks that passed: their items' own sums, still with the constant for the terms set aside.
        windows = np.unique(passed // blocks)
        near = np.isin(halves, np.concatenate([windows, windows + 1]))
        in_passed = lambda at: np.isin(at // n * blocks + at % n // BLOCK_ITEMS, passed)
        keys, total = self._summed(halves[near], terms[near], self.post_start, self.post_item, self.post_impact, n, in_passed)
        passed = keys[total + self.constant[keys % n] >= np.array(self.least)[keys % n]]
        found = []
        present = np.zeros(len(self.terms), bool)
        for window in np.unique(passed // n).tolist():
            a, z = np.searchsorted(half, window), np.searchsorted(half, window + 2)
            own = number[a:z][number[a:z] >= 0]
            present[own] = True
            held = None
            for i in (passed[passed // n == window] % n).tolist():
                score = float(self.impacts[i][present[self.item_terms[i]]].sum())
                if score >= self.least[i]:
                    if held is None:
                        inside = [vocab[k] for k in tokens[a:z]]
                        held = {tuple(inside[k : k + n_]) for n_ in self.sizes for k in range(len(inside) - n_ + 1)}
                    whole_, answer = self.shingles[i], self.answers[i]
                    question = whole_ - answer
                    shared, in_answer = len(whole_ & held), len(answer & held)
                    share = lambda n, s: n / len(s) if s else 1.0
                    in_question, in_answer = share(len(question & held), question), share(in_answer, answer)
                    if shared >= self.overlap * len(whole_) - 1e-9 and min(in_question, in_answer) >= PART:
                        found.append((int(rows[a]), i, score, shared / len(whole_), in_question, in_answer))
            present[own] = False
        return found


def plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word numbers, their texts, vocabulary) of many texts, as ``plain_words`` has them."""
    w = words(pc.utf8_lower(solid(texts)), lower=False, split=pc.utf8_split_whitespace)
    vocab = [bare(v) for v in w.vocab]
    real = np.array([bool(v) for v in vocab], bool)
    keep = real[w.codes] if len(w.codes) else np.zeros(0, bool)
    return w.codes[keep], w.rows[keep], vocab


HITS = "array<struct<item_id:bigint,score:double,overlap:double,question:double,answer:double>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), *((x, pa.float64()) for x in ("score", "overlap", "question", "answer"))]))


def _hits(index: Index, texts: pa.Array) -> list[list[dict]]:
    """For every text the items found, best passage first taken, in order of item id."""
    best: list[dict[int, tuple]] = [{} for _ in range(len(texts))]
    for row, i, *figures in index.search(*plain(texts)):
        if i not in best[row] or (figures[1], figures[0]) > (best[row][i][1], best[row][i][0]):
            best[row][i] = tuple(figures)
    names = ("score", "overlap", "question", "answer")
    return [sorted(({"item_id": index.ids[i], **dict(zip(names, x, strict=True))} for i, x in found.items()), key=lambda h: (h["item_id"] is None, h["item_id"] or 0)) for found in best]


def _searched(shared):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                new = _hits(shared.value, part.column("text"))
                old = part.column("hits").to_pylist()
                yield part.set_column(part.schema.get_field_index("hits"), "hits", pa.array([(a or []) + b for a, b in zip(old, new, strict=True)], _HIT))

    return run


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[Index]:
    """The benchmark as indexes of at most about ITEMS_PER_INDEX items each."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), whole(text_col).alias("t"))
    parts = max(1, -(-items.count() // ITEMS_PER_INDEX))
    cut = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    return [Index([(r["i"], r["t"]) for r in items.filter(cut == p).collect()]) for p in range(parts)]


def searched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text and hits (items found, with figures) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("hits", F.array().cast(HITS))
    for index in indexes(benchmark):
        rows = mapped(rows, _searched(docs.sparkSession.sparkContext.broadcast(index)), rows.schema)
    return rows


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each input row: whether it is contaminated, by which items, and the best match's figures."""
    best = F.reduce("hits", F.lit(None).cast(HITS[6:-1]), lambda a, h: F.when(a.isNull() | (h["overlap"] > a["overlap"]), h).otherwise(a))
    rows = searched(docs, benchmark).select("doc_id", "hits", best.alias("best"))
    return rows.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.col("hits.item_id").alias("item_ids"),
        F.col("best.item_id").alias("best_item"), F.col("best.score").alias("bm25"), F.col("best.overlap").alias("overlap"),
        F.col("best.question").alias("question_overlap"), F.col("best.answer").alias("answer_overlap"),
    )


def _clean(shared, text_col: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array([not h for h in _hits(shared.value, part.column(text_col))], pa.bool_()))

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; maps only."""
    for index in indexes(benchmark):
        docs = mapped(docs, _clean(docs.sparkSession.sparkContext.broadcast(index), text_col), docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES: dict[str, str] = {}
