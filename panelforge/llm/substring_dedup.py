"""Removal of byte strings that also start in an earlier document, by suffix arrays of two-stage sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document
with a smaller id. Strings do not cross documents and are judged on the input.

1. Texts are packed into parts of some MB, written once as a table bucketed by part.
   Of equal texts only rows with the smallest id go on: any other row loses everything.
2. Every string of LENGTH bytes has a mark: the least hash of its stretches of
   ``STRETCH`` bytes. Equal strings have equal marks, and neighbouring strings mostly
   share one, so a text falls into windows of one mark. Parts send their distinct marks,
   packed by hash; those met in two documents or more come back.
3. Windows with such marks are sent to the bucket of their mark, once for each part and
   content. So all places of a string that several documents hold meet in one bucket.
   If more than ``HOT`` documents hold a mark, its strings are dealt one by one, by a hash
   of their own, so that no bucket grows with it.
4. A bucket's windows are joined into one text whose suffixes are sorted in two
   stages: suffixes smaller than their successor directly, word by word; all others by
   scanning the buckets of first bytes in order, each placing the suffixes one byte
   longer. Sorting and comparing stop at LENGTH bytes. Adjacent suffixes that share LENGTH
   bytes are places of one string; its least id goes back to the parts that hold it.
5. Parts take out the bytes of strings with a smaller id elsewhere.

Only marks, windows and answers are shuffled; texts stay in the bucketed table. A mark's
hash only decides what is looked at: everything found is compared byte by byte.

Defined cases. Null text counts as empty. A null id is smaller than any other.
Rows with equal ids are no earlier documents for one another, whatever their texts.
Texts shorter than LENGTH lose nothing. An empty table gives an empty result. Other
columns are not read. Very long texts are a part of their own, gone through in stretches.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import bounded, input_bytes, joined_by_weight, mapped, parts_by_bytes, shared_folder, slices, solid, table, written

LENGTH, STRETCH = 50, 24
#: Bytes of text in a part, and of corpus files for each bucket of windows.
PART_BYTES, BUCKET_BYTES = 4 << 20, 512 << 10
#: Documents that hold a mark before its strings are dealt one by one.
HOT = 4096
#: Strings whose marks are worked out at once.
AT_ONCE = 1 << 18
END = 0xFF  # no byte of UTF-8
NULL_ID = -(1 << 63)

PART_SCHEMA = "part bigint, ids array<bigint>, digests array<binary>, texts array<string>"
ANSWER = "part bigint, kind int, a binary, b binary"
COPIES, SHARED, FOUND = range(3)
RUN = np.dtype([("item", "<u4"), ("from", "<u4"), ("to", "<u4"), ("id", "<i8")])


def words_at(data: np.ndarray, extra: int = 0) -> np.ndarray:
    """The eight bytes from every place of ``data`` as one big-endian number (zeros beyond the end), and ``extra`` zeros."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.zeros(n + extra, np.uint64)
    for r in range(min(8, n)):
        count = (n - r + 7) // 8
        out[r:n:8] = np.frombuffer(padded, ">u8", count, r)
    return out


def marks(data: np.ndarray, length: int = LENGTH, stretch: int = STRETCH) -> np.ndarray:
    """For every string of ``length`` bytes in ``data``: the least hash of its stretches of ``stretch`` (a multiple of 8) bytes."""
    n = len(data) - stretch + 1
    w = words_at(data)
    h = np.zeros(max(n, 0), np.uint64)
    for k, factor in zip(range(0, stretch, 8), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD), strict=False):
        h += w[k : k + n] * np.uint64(factor)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    size, width = 1, length - stretch + 1
    while size < width:
        step = min(size, width - size)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return h


def suffixes(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The places of ``text`` (its last byte is END) in an order of their suffixes that holds for ``depth`` bytes at least."""
    n = len(text)
    w = words_at(text, 64 + depth)
    # smaller than the successor: the next other byte is greater
    runs = np.flatnonzero(np.diff(text)) + 1
    first = np.concatenate([[0], runs])  # of each run of one byte
    sizes = np.diff(np.append(first, n))
    rising = np.append(text[first[1:]] > text[first[1:] - 1], False)
    start_of = np.repeat(first, sizes)
    direct = np.flatnonzero(np.repeat(rising, sizes))
    # first stage: by eight bytes, then ties by the next eight
    direct = direct[np.argsort(w[direct], kind="stable")]
    fresh = np.ones(len(direct), bool)
    fresh[1:] = w[direct[1:]] != w[direct[:-1]]
    for at in range(8, depth, 8):
        tied = ~fresh | ~np.append(fresh[1:], True)
        places = np.flatnonzero(tied)
        if not len(places):
            break
        group, own = np.cumsum(fresh)[places], direct[places]
        by = np.lexsort((w[own + at], group))
        own = own[by]
        direct[places] = own
        key = w[own + at]
        fresh[places[1:]] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    borders = np.searchsorted(text[direct], np.arange(257))
    # second stage: bytes in ascending order; each place puts the one before it into the bucket of that byte
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in np.unique(text).tolist():
        induced = np.concatenate([*waiting[c], np.zeros(0, np.int64)]).astype(np.int64)
        waiting[c] = []
        before = induced - start_of[induced]  # as many of the same byte stand before it
        again = np.repeat(np.arange(len(induced)), before)
        level = np.arange(len(again)) - np.repeat(np.cumsum(before) - before, before) + 1
        by = np.argsort(level, kind="stable")
        bucket = np.concatenate([induced, induced[again[by]] - level[by], direct[borders[c] : borders[c + 1]]])
        out.append(bucket)
        longer = bucket[bucket > 0] - 1
        byte = text[longer]
        longer, byte = longer[byte > c], byte[byte > c]
        by = np.argsort(byte, kind="stable")
        longer, cuts = longer[by], np.searchsorted(byte[by], np.arange(257))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            waiting[b].append(longer[cuts[b] : cuts[b + 1]])
    return np.concatenate(out)


def adjacent_agree(w: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each of ``order`` but the first, whether it shares ``length`` bytes (8 or more) with the one before. ``w``: ``words_at``."""
    a, b = order[:-1], order[1:]
    left = np.arange(len(a))
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        left = left[w[a[left] + at] == w[b[left] + at]]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def least_ids(items: list[bytes], ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For the strings of ``length`` bytes in ``items`` (distinct byte strings, the least id of each): RUN rows by item, and where
    each item's begin (one more for the end). ``id``: the least of all items that hold the string."""
    sizes = np.array([len(x) for x in items], np.int64)
    text = np.frombuffer(b"".join(x + b"\xff" for x in items), np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    item = np.repeat(np.arange(len(items)), sizes + 1)
    inside = np.arange(len(text)) - first[item] <= sizes[item] - length
    order = suffixes(text, length)
    order = order[inside[order]]
    same = adjacent_agree(words_at(text, length), order, length)
    group = np.concatenate([[0], np.cumsum(~same)])
    least = np.minimum.reduceat(ids[item[order]], np.flatnonzero(np.concatenate([[True], ~same])))
    found = np.zeros(len(text), np.int64)
    found[order] = least[group]
    at = np.flatnonzero(inside)
    change = np.flatnonzero(np.concatenate([[True], (item[at][1:] != item[at][:-1]) | (found[at][1:] != found[at][:-1])]))
    rows = np.zeros(len(change), RUN)
    rows["item"], rows["id"] = item[at[change]], found[at[change]]
    rows["from"] = at[change] - first[rows["item"]]
    rows["to"] = rows["from"] + np.diff(np.append(change, len(at)))
    return rows, np.searchsorted(rows["item"], np.arange(len(items) + 1))


class Part:
    """The texts of a part, their windows of one mark, and what the answers say."""

    def __init__(self, rows: pa.Table, answers: pa.Table, length: int, stretch: int):
        self.number, self.length = rows.column("part")[0].as_py(), length
        self.doc_ids = rows.column("ids")[0].values.to_pylist()
        self.ids = np.array([NULL_ID if i is None else i for i in self.doc_ids], np.int64)
        texts = rows.column("texts")[0].values
        ends = solid(texts)
        self.bounds = ends.buffers()[1] and np.frombuffer(ends.buffers()[1], np.int64, len(ends) + 1)
        self.raw = ends.buffers()[2].to_pybytes()[: self.bounds[-1]] if ends.buffers()[2] else b""
        self.data = np.frombuffer(self.raw, np.uint8)
        got: list[list] = [[], [], []]
        for kind, a, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True):
            got[kind].append((a, b))
        self.copy = np.zeros(len(self.ids), bool)
        for a, _ in got[COPIES]:
            self.copy[np.frombuffer(a, "<i4")] = True
        self._shared = got[SHARED]
        self._found = got[FOUND]
        self._cut(stretch)

    def _cut(self, stretch: int) -> None:
        """``first``, ``count``, ``mark``, ``doc`` of the windows: strings in a row with one mark; not those of copies."""
        starts, values = [], []
        n = len(self.data) - self.length + 1
        for at in range(0, n, AT_ONCE):
            own = marks(self.data[at : at + AT_ONCE + self.length - 1], self.length, stretch)
            new = np.concatenate([[True], own[1:] != own[:-1]])
            starts.append(at + np.flatnonzero(new))
            values.append(own[new])
        last = self.bounds[1:] - self.length + 1  # beyond the last string of each text
        starts, values = (np.concatenate([*x, np.zeros(0, t)]).astype(t) for x, t in ((starts, np.int64), (values, np.uint64)))
        cuts = np.union1d(starts, np.concatenate([self.bounds[:-1], np.maximum(last, 0)]))
        cuts = cuts[cuts < max(n, 0)]
        doc = np.searchsorted(self.bounds, cuts, "right") - 1
        ends = np.minimum(np.append(cuts[1:], max(n, 0)), last[doc])
        good = (cuts < last[doc]) & ~self.copy[doc]
        mark = values[np.searchsorted(starts, cuts, "right") - 1] if len(starts) else np.zeros(len(cuts), np.uint64)
        cuts, ends, doc, mark = cuts[good], ends[good], doc[good], mark[good]
        new = np.concatenate([np.ones(min(1, len(cuts)), bool), (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])])
        self.first, self.mark, self.doc = cuts[new], mark[new], doc[new]
        self.count = np.append(ends, 0)[np.append(np.flatnonzero(new)[1:], len(cuts)) - 1] - self.first if len(cuts) else np.zeros(0, np.int64)

    def distinct_marks(self) -> tuple[np.ndarray, np.ndarray]:
        """(marks in ascending order, documents of this part that hold each)."""
        by = np.lexsort((self.doc, self.mark))
        mark, doc = self.mark[by], self.doc[by]
        once = np.concatenate([np.ones(min(1, len(by)), bool), (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])])
        return np.unique(mark[once], return_counts=True)

    def items(self, buckets: int):
        """({content: number}, bucket, least id, greatest id of every number, [(number, place, document) of all windows]) of the
        windows with shared marks; always in the same order."""
        shared = np.concatenate([*(np.frombuffer(a, "<u8") for a, _ in self._shared), np.zeros(0, np.uint64)])
        hot = np.concatenate([*(np.frombuffer(b, np.uint8) for _, b in self._shared), np.zeros(0, np.uint8)])
        by = np.argsort(shared)
        shared, hot = shared[by], hot[by]
        numbers: dict[bytes, int] = {}
        bucket, least, greatest, where = [], [], [], []
        at = np.searchsorted(shared, self.mark)
        chosen = np.flatnonzero(np.append(shared, 0)[at] == self.mark) if len(shared) else []
        chosen = chosen[at[chosen] < len(shared)] if len(shared) else []
        ids, raw, more = self.ids.tolist(), self.raw, self.length - 1
        for s, r, d, m, h in zip(self.first[chosen].tolist(), self.count[chosen].tolist(), self.doc[chosen].tolist(), self.mark[chosen].tolist(), hot[at[chosen]].tolist() if len(shared) else [], strict=True):
            own = ids[d]
            for place, size in [(s + k, 1) for k in range(r)] if h else [(s, r)]:
                content = raw[place : place + size + more]
                i = numbers.setdefault(content, len(numbers))
                if i == len(least):
                    bucket.append((zlib.crc32(content) if h else m) % buckets)
                    least.append(own)
                    greatest.append(own)
                elif own < least[i]:
                    least[i] = own
                elif own > greatest[i]:
                    greatest[i] = own
                where.append((i, place, d))
        return numbers, bucket, least, greatest, where

    def removed(self, buckets: int) -> np.ndarray:
        """For every byte of the part, whether it goes."""
        where = np.array(self.items(buckets)[4], np.int64).reshape(-1, 3)
        rows = np.concatenate([*(np.frombuffer(a, RUN) for a, _ in self._found), np.zeros(0, RUN)])
        rows = rows[np.argsort(rows["item"], kind="stable")]
        low, high = np.searchsorted(rows["item"], where[:, 0]), np.searchsorted(rows["item"], where[:, 0], "right")
        window = np.repeat(np.arange(len(where)), high - low)
        run = rows[np.arange(len(window)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[window]]
        earlier = run["id"] < self.ids[where[window, 2]]
        window, run = window[earlier], run[earlier]
        change = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(change, where[window, 1] + run["from"], 1)
        np.add.at(change, where[window, 1] + run["to"] + self.length - 1, -1)
        gone = np.cumsum(change)[:-1] > 0
        for d in np.flatnonzero(self.copy & (np.diff(self.bounds) >= self.length)):
            gone[self.bounds[d] : self.bounds[d + 1]] = True
        return gone


def _packed(batches):
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for cut in slices(batch, "text", PART_BYTES):
            texts = solid(cut.column("text")).cast(pa.string())
            digests = [hashlib.sha256(x.encode()).digest() for x in texts.to_pylist()]
            one = pa.array([0, len(texts)], pa.int32())
            yield pa.RecordBatch.from_pydict({"part": pa.array([task << 24 | n], pa.int64()), "ids": pa.ListArray.from_arrays(one, cut.column("doc_id").cast(pa.int64())), "digests": pa.ListArray.from_arrays(one, pa.array(digests, pa.binary())), "texts": pa.ListArray.from_arrays(one, texts)})
            n += 1


def _marks_of(length: int, stretch: int, buckets: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows:
            part = Part(rows, answers, length, stretch)
            mark, docs = part.distinct_marks()
            bucket = (mark % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            out = [(b, part.number, mark[own].astype("<u8").tobytes(), docs[own].astype("<u4").tobytes()) for b in np.unique(bucket).tolist() for own in [by[cuts[b] : cuts[b + 1]]]]
        return pa.table(dict(zip(("bucket", "part", "marks", "docs"), (list(c) for c in zip(*out, strict=True)) if out else [[]] * 4, strict=True)), schema=pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("marks", pa.binary()), ("docs", pa.binary())]))

    return run


ANSWER_TYPE = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _shared_marks(hot: int):
    def run(rows: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, "<u8") for x in rows.column("marks").to_pylist()]
        mark, docs = np.concatenate(lists), np.concatenate([np.frombuffer(x, "<u4") for x in rows.column("docs").to_pylist()])
        _, which = np.unique(mark, return_inverse=True)
        total = np.bincount(which, weights=docs)[which]
        ends, out = np.cumsum([0, *map(len, lists)]), []
        for part, a, b in zip(rows.column("part").to_pylist(), ends, ends[1:], strict=False):
            own = a + np.flatnonzero(total[a:b] >= 2)
            if len(own):
                out.append((part, SHARED, mark[own].tobytes(), (total[own] > hot).astype(np.uint8).tobytes()))
        return pa.Table.from_pylist([dict(zip(ANSWER_TYPE.names, r, strict=True)) for r in out], ANSWER_TYPE)

    return run


WINDOWS = "bucket bigint, part bigint, numbers binary, sizes binary, least binary, greatest binary, body binary"


def _windows_of(length: int, stretch: int, buckets: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows:
            part = Part(rows, answers, length, stretch)
            numbers, bucket, least, greatest, _ = part.items(buckets)
            contents, bucket = list(numbers), np.array(bucket, np.int64)
            least, greatest = np.array(least, "<i8"), np.array(greatest, "<i8")
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(np.concatenate([[-1], bucket[by], [-1]])))
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = by[a:b]
                texts = [contents[i] for i in own.tolist()]
                out.append((int(bucket[own[0]]), part.number, own.astype("<u4").tobytes(), np.array([len(x) for x in texts], "<u4").tobytes(), least[own].tobytes(), greatest[own].tobytes(), b"".join(texts)))
        names = ("bucket", "part", "numbers", "sizes", "least", "greatest", "body")
        return pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in out], pa.schema([(c, pa.int64() if c in names[:2] else pa.binary()) for c in names]))

    return run


def _earlier(length: int):
    """Worker: of the windows of a bucket, the strings that a smaller id than the part's greatest holds."""

    def run(rows: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        ids: list[int] = []
        which, asked = [], []
        for numbers, sizes, least, greatest, body in zip(*(rows.column(c).to_pylist() for c in ("numbers", "sizes", "least", "greatest", "body")), strict=True):
            ends, own = np.cumsum(np.frombuffer(sizes, "<u4")).tolist(), []
            for a, b, i in zip([0, *ends], ends, np.frombuffer(least, "<i8").tolist(), strict=False):
                k = seen.setdefault(body[a:b], len(seen))
                if k == len(ids):
                    ids.append(i)
                elif i < ids[k]:
                    ids[k] = i
                own.append(k)
            which.append(np.array(own, np.int64))
            asked.append((np.frombuffer(numbers, "<u4"), np.frombuffer(greatest, "<i8")))
        runs, at = least_ids(list(seen), np.array(ids, np.int64), length)
        out = []
        for part, own, (numbers, greatest) in zip(rows.column("part").to_pylist(), which, asked, strict=True):
            many = at[own + 1] - at[own]
            window = np.repeat(np.arange(len(own)), many)
            got = runs[np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many) + at[own][window]]
            keep = got["id"] < greatest[window]
            got, window = got[keep].copy(), window[keep]
            got["item"] = numbers[window]
            if len(got):
                out.append((part, FOUND, got.tobytes(), None))
        return pa.Table.from_pylist([dict(zip(ANSWER_TYPE.names, r, strict=True)) for r in out], ANSWER_TYPE)

    return run


RESULT = "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, length: bigint>>, kept binary"


def _result(length: int, stretch: int, buckets: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64())])
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(kind)), ("kept", pa.binary())])
        if not rows.num_rows:
            return schema.empty_table()
        part = Part(rows, answers, length, stretch)
        gone, bounds = part.removed(buckets), part.bounds
        edge = gone & ~np.concatenate([[False], gone])[:-1]
        edge[bounds[:-1][bounds[:-1] < len(gone)]] = gone[bounds[:-1][bounds[:-1] < len(gone)]]
        starts = np.flatnonzero(edge)
        owner = np.searchsorted(bounds, starts, "right") - 1
        stays = np.concatenate([[0], np.cumsum(~gone)])
        rest = np.flatnonzero(~gone)  # a span ends at the next byte that stays, the next span or its text's end
        after = np.append(rest, len(gone))[stays[starts]] if len(starts) else starts
        ends = np.minimum(np.minimum(after, np.append(starts[1:], len(gone))), bounds[1:][owner])
        spans = pa.StructArray.from_arrays([pa.array(starts - bounds[owner]), pa.array(ends - starts)], ["start", "length"])
        kept, cuts = part.data[~gone].tobytes(), stays[bounds]
        return pa.table(
            [pa.array(part.doc_ids, pa.int64()), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(bounds))), pa.int32()), spans), pa.array([kept[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())],
            schema=schema,
        )

    return run


def _bucketed(df: DataFrame, folder: str, n: int) -> DataFrame:
    """``df`` as a table of ``n`` buckets by part, so that joins on part leave it where it is."""
    name = "parts_" + folder.rsplit("/", 1)[-1]
    df.write.bucketBy(n, "part").option("path", folder).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def without_repeats(docs: DataFrame, length: int = LENGTH, stretch: int = STRETCH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed stretches of bytes, in order) and kept (the bytes that are left) of every row."""
    if stretch % 8 or not 8 <= stretch <= min(40, length):
        raise ValueError("stretch: 8, 16, 24, 32 or 40, and no longer than length")
    bounded(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, buckets = parts_by_bytes(rows, 64 << 20), max(16, input_bytes(rows) // BUCKET_BYTES)
    parts = _bucketed(mapped(rows, _packed, PART_SCHEMA), shared_folder(docs.sparkSession), n)
    own = parts.select("part", F.posexplode(F.arrays_zip("ids", "digests"))).select("part", "pos", F.coalesce("col.ids", F.lit(NULL_ID)).alias("id"), F.col("col.digests").alias("digest"))
    several = written(own.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    later = joined_by_weight(own, several, "digest", "n").filter("id > least")
    copies = written(mapped(later.groupBy("part").agg(F.collect_list("pos").alias("pos")), _positions, ANSWER))
    of_part = lambda df: df.repartition(n, "part").groupBy("part")
    texts = parts.select("part", "ids", "texts").groupBy("part")
    asked = texts.cogroup(of_part(copies)).applyInArrow(_marks_of(length, stretch, n), "bucket bigint, part bigint, marks binary, docs binary")
    shared = written(asked.groupBy("bucket").applyInArrow(_shared_marks(hot), ANSWER))
    windows = texts.cogroup(of_part(copies.unionAll(shared))).applyInArrow(_windows_of(length, stretch, buckets), WINDOWS)
    found = written(windows.groupBy("bucket").applyInArrow(_earlier(length), ANSWER))
    return texts.cogroup(of_part(copies.unionAll(shared).unionAll(found))).applyInArrow(_result(length, stretch, buckets), RESULT)


def _positions(batches):
    for batch in batches:
        places = [np.array(p, "<i4").tobytes() for p in batch.column("pos").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array([COPIES] * len(places), pa.int32()), pa.array(places, pa.binary()), pa.nulls(len(places), pa.binary())], names=ANSWER_TYPE.names)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op11_substring_dedup": op11_substring_dedup}
#: SQL would list every string of every text: the tests hold the query against a brute-force version.
ORACLES: dict[str, str] = {}
