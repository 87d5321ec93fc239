"""Language identification by unigram models that sum over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary
(estimated by expectation maximisation from labelled texts). The probability of
a word is the sum, over every way to cut it into pieces, of the product of the
pieces' probabilities, found by the forward algorithm; a text's is the product
over its words. Words are the runs of letters, lower-cased, each with the
vocabulary's word-start mark in front, so a word's probability is worked out
once and used wherever the word recurs.

The fit uses a sample of labelled rows bounded by ``docs_per_language`` and
``words_per_language``; scoring is a map over whole texts with a broadcast model
(pieces x languages, a fixed size), no shuffle.

Defined cases. Null or letterless text: ``und`` with score 0. Without any
labelled row every text is ``und``. Ties between languages go to the first in
alphabetical order. Repeated rows are scored alike, an empty table gives an empty
result, other columns are not read. Characters outside the vocabulary have a
small fixed probability in every language. A word of any length is scored whole; one
of more than LONG characters takes memory for a stretch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import held_out, mapped, slices, table, words

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
MAX_PIECE = 16
UNKNOWN = 1e-7
#: Characters of a word that the fit takes together, and beyond which a word is scored stretch by stretch.
STRETCH, LONG = 24, 4096
SEED = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of a sentencepiece model that stand for characters, lower-case ones only (texts are lower-cased)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path())
    every = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return sorted({p for p in every if p == p.lower() and 0 < len(p) <= MAX_PIECE})


def _hash_steps(points: np.ndarray):
    """For each length the hashes of the strings of that length starting at every point."""
    h = np.zeros(len(points), np.uint64)
    for size in range(1, MAX_PIECE + 1):
        if size > len(points):
            return
        h = h[: len(points) - size + 1] * SEED + points[size - 1 :] + np.uint64(1)
        yield size, h


class Pieces:
    """The vocabulary as sorted hashes by length."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, MAX_PIECE + 1):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == size], np.int64)
            if len(ids):
                points = np.frombuffer("".join(pieces[i] for i in ids).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, size)
                h = np.zeros(len(ids), np.uint64)
                for k in range(size):
                    h = h * SEED + points[:, k] + np.uint64(1)
                order = np.argsort(h)
                self.by_size[size] = h[order], ids[order]

    def found(self, points: np.ndarray, size: np.ndarray, start: np.ndarray) -> "Found":
        """The pieces of every word (given by ``size`` and first point ``start``, longest first), by the place they end at."""
        left = np.repeat(start + size, size) - np.arange(len(points))
        ends, words_, lengths, ids = [], [], [], []
        of_word = np.repeat(np.arange(len(size)), size)
        for ell, h in _hash_steps(points):
            at = np.flatnonzero(left[: len(h)] >= ell)
            if not len(at):
                break
            which = np.full(len(at), -1, np.int64)
            if ell in self.by_size:
                known, own = self.by_size[ell]
                place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
                which = np.where(known[place] == h[at], own[place], -1)
            if ell == 1:
                which[which < 0] = self.n  # an unknown character
            else:
                at, which = at[which >= 0], which[which >= 0]
            ends.append(at - start[of_word[at]] + ell)
            words_.append(of_word[at])
            lengths.append(np.full(len(at), ell))
            ids.append(which)
        return Found(int(size[0]), *map(np.concatenate, (ends, lengths, words_, ids)))


class Found:
    """Uses of pieces in words; ``at(p)`` gives those that end at place p, length by length: (length, words, pieces)."""

    def __init__(self, longest, ends, lengths, words_, ids):
        key = ends * (MAX_PIECE + 1) + lengths
        order = np.argsort(key, kind="stable")
        self.words, self.ids = words_[order], ids[order]
        self.cuts = np.searchsorted(key[order], np.arange((longest + 1) * (MAX_PIECE + 1) + 1))

    def at(self, p: int):
        for ell in range(1, min(p, MAX_PIECE) + 1):
            k = p * (MAX_PIECE + 1) + ell
            if self.cuts[k] < self.cuts[k + 1]:
                part = slice(self.cuts[k], self.cuts[k + 1])
                yield ell, self.words[part], self.ids[part]


def lattice(pieces: Pieces, tokens: list[str]):
    """Tokens sorted by length (longest first) in buckets: (token numbers, lengths, pieces found)."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        longest = lengths[order[at]]
        end = at + int(np.searchsorted(-lengths[order[at:]], -(longest // 2), side="left"))
        end = min(max(end, at + 1), at + max(1, 1_000_000 // int(longest)))
        part = order[at:end]
        size = lengths[part]
        points = np.frombuffer("".join(tokens[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        yield part, size, pieces.found(points, size, start)
        at = end


def forward(size: np.ndarray, found: Found, probs: np.ndarray) -> np.ndarray:
    """The log probability of every word in each language: a sum over all its segmentations."""
    n, longest, langs = len(size), int(size[0]), probs.shape[1]
    alpha = np.zeros((longest + 1, n, langs))
    alpha[0] = 1
    scale, total = np.zeros((n, langs)), np.zeros((n, langs))
    for p in range(1, longest + 1):
        for ell, which, ids in found.at(p):
            alpha[p, which] += alpha[p - ell, which] * probs[ids]
        k = int(np.searchsorted(-size, -p, side="right"))  # words of p characters and more
        if p % 8 == 0:  # the last places are scaled up again before they get too small
            first = max(0, p - MAX_PIECE + 1)
            top = alpha[first : p + 1, :k].max(axis=0)
            alpha[first : p + 1, :k] /= top
            scale[:k] += np.log(top)
        done = int(np.searchsorted(-size, -p, side="left"))
        if done < k:
            total[done:k] = np.log(alpha[p, done:k]) + scale[done:k]
    return total


def expected(pieces: Pieces, tokens: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in ``tokens`` (of at most 24 characters) under one language's ``probs``."""
    uses = np.zeros(pieces.n + 1)
    for part, size, found in lattice(pieces, tokens):
        n, longest = len(size), int(size[0])
        alpha, beta = np.zeros((longest + 1, n)), np.zeros((longest + 1, n))
        alpha[0] = 1
        for p in range(1, longest + 1):
            for ell, which, ids in found.at(p):
                alpha[p, which] += alpha[p - ell, which] * probs[ids]
        beta[size, np.arange(n)] = 1
        weight = counts[part] / alpha[size, np.arange(n)]
        for p in range(longest, 0, -1):
            for ell, which, ids in found.at(p):
                share = probs[ids] * beta[p, which]
                beta[p - ell, which] += share
                uses += np.bincount(ids, alpha[p - ell, which] * share * weight[which], pieces.n + 1)
    return uses


class LanguageModel:
    """``langs`` and, for every piece, its probability in each (the last row: an unknown character)."""

    def __init__(self, vocab: list[str], langs: list[str], probs: np.ndarray):
        self.vocab, self.langs, self.probs = vocab, langs, probs

    def __getstate__(self):
        return {"vocab": self.vocab, "langs": self.langs, "probs": self.probs}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.pieces, self.known = Pieces(self.vocab), {}

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        """Log probability of every token in each language."""
        out = np.zeros((len(tokens), len(self.langs)))
        long = np.array([len(t) > LONG for t in tokens], bool)
        short = np.flatnonzero(~long)
        for part, size, found in lattice(self.pieces, [tokens[i] for i in short]):
            out[short[part]] = forward(size, found, self.probs)
        for i in np.flatnonzero(long):
            out[i] = self._long(tokens[i])
        return out

    def _long(self, token: str) -> np.ndarray:
        """The same for one long token, a stretch at a time: only the last places' sums are carried on."""
        scale = np.zeros(len(self.langs))
        for c in range(0, len(token), LONG):
            off = min(c, MAX_PIECE)
            part = token[c - off : c + LONG]
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            found = self.pieces.found(points, np.array([len(part)]), np.array([0]))
            alpha = np.zeros((len(part) + 1, len(self.langs)))
            alpha[: off + 1] = tail[-(off + 1) :] if c else 1
            for p in range(off + 1, len(part) + 1):
                for ell, _, ids in found.at(p):
                    alpha[p] += alpha[p - ell] * self.probs[ids[0]]
                if p % 8 == 0:
                    top = alpha[max(0, p - MAX_PIECE + 1) : p + 1].max(axis=0)
                    alpha[max(0, p - MAX_PIECE + 1) : p + 1] /= top
                    scale += np.log(top)
            tail = alpha[-(MAX_PIECE + 1) :].copy()
        return np.log(tail[-1]) + scale


def fit(samples: dict[str, dict[str, int]], path: str | None = None, rounds: int = 3, smoothing: float = 0.05) -> LanguageModel:
    """The model of ``samples``: for each language its words and their counts."""
    vocab, langs = vocabulary(path), sorted(samples)
    pieces = Pieces(vocab)
    probs = np.zeros((pieces.n + 1, len(langs)))
    for k, lang in enumerate(langs):
        given: dict[str, int] = {}
        for w, c in samples[lang].items():  # a longer word counts in stretches, which keeps its sums within a double's range
            for i in range(0, len(w), STRETCH):
                given[w[i : i + STRETCH]] = given.get(w[i : i + STRETCH], 0) + c
        tokens, counts = list(given), np.array(list(given.values()), float)
        p = np.full(pieces.n + 1, 1 / pieces.n)
        p[-1] = UNKNOWN
        for _ in range(rounds):
            uses = expected(pieces, tokens, counts, p)[: pieces.n] if tokens else np.zeros(pieces.n)
            p[: pieces.n] = (uses + smoothing) / (uses.sum() + smoothing * pieces.n)
        probs[:, k] = p
    model = LanguageModel(vocab, langs, probs)
    model.__setstate__(model.__getstate__())
    return model


def _chunk_tokens(chunk: str) -> list[str]:
    return [MARK + w for w in LETTERS.findall(chunk.lower())]


#: Scores of chunks seen before, by worker; emptied when it holds so many.
KNOWN_CHUNKS = 600_000


def chunk_scores(model: LanguageModel, vocab: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(log probabilities by language, whether it holds a letter) of every white-space separated chunk."""
    known = model.known
    if len(known) > KNOWN_CHUNKS:
        known.clear()
    new = [c for c in vocab if c not in known]
    split = [_chunk_tokens(c) for c in new]
    flat = {t: i for i, t in enumerate(dict.fromkeys(t for s in split for t in s))}
    scores = model.token_scores(list(flat)).astype(np.float32)
    nothing = np.zeros(len(model.langs), np.float32)
    for c, s in zip(new, split, strict=True):
        known[c] = (scores[flat[s[0]]] if len(s) == 1 else scores[[flat[t] for t in s]].sum(0)) if s else None
    values = [known[c] for c in vocab]
    return np.array([nothing if v is None else v for v in values], float).reshape(len(vocab), len(model.langs)), np.array([v is not None for v in values], bool)


def predictor(shared):
    """A mapInArrow function that predicts with the broadcast model ``shared``."""

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), lower=False)
                n = part.num_rows
                total, letters = np.zeros((n, len(model.langs))), np.zeros(n, bool)
                if len(w.codes) and model.langs:
                    scores, has = chunk_scores(model, w.vocab)
                    rows = w.rows
                    for k in range(len(model.langs)):
                        total[:, k] = np.bincount(rows, scores[w.codes, k], n)
                    letters = np.bincount(rows, has[w.codes], n) > 0
                if model.langs:
                    share = np.exp(total - total.max(axis=1, keepdims=True))
                    share /= share.sum(axis=1, keepdims=True)
                    best = total.argmax(axis=1)
                    pred = [model.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                    score = np.where(letters, share[np.arange(n), best], 0.0)
                else:
                    pred, score = ["und"] * n, np.zeros(n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _word_counts(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column("text"), lower=False)
            langs, lang_codes = np.unique(np.array(part.column("lang").to_pylist(), dtype=object), return_inverse=True)
            pairs, n = np.unique(lang_codes[w.rows] * len(w.vocab) + w.codes, return_counts=True)
            out: dict[tuple[str, str], int] = {}
            for pair, count in zip(pairs.tolist(), n.tolist(), strict=True):
                for t in _chunk_tokens(w.vocab[pair % len(w.vocab)]):
                    key = langs[pair // len(w.vocab)], t
                    out[key] = out.get(key, 0) + count
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(out.values(), pa.int64())], names=["lang", "word", "n"])


def train(docs: DataFrame, docs_per_language: int = 400, words_per_language: int = 60_000, path: str | None = None) -> LanguageModel:
    """Fits on labelled rows outside the held-out fold: about ``docs_per_language`` rows, chosen by a hash of the
    id, and of each language's words the ``words_per_language`` most frequent."""
    given = docs.select("doc_id", "lang", "text").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in given.groupBy("lang").count().collect()}
    samples: dict[str, dict[str, int]] = {k: {} for k in sizes}
    if sizes:
        share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, docs_per_language / n)))])
        chosen = given.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
        counts = mapped(chosen.select("lang", "text"), _word_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
        for r in counts.withColumn("rank", rank).filter(F.col("rank") <= words_per_language).orderBy("lang", "rank").toLocalIterator():
            samples[r["lang"]][r["word"]] = r["n"]
    return fit(samples, path)


def predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return mapped(rows, predictor(shared), "doc_id bigint, held_out boolean, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, train(docs))


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
