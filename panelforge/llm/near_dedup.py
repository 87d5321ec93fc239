"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

1. One map over the texts gives each document the distinct hashes of its word
   shingles, their MinHash samples, band keys, and an odd sketch: the samples
   folded into a parity bitmap, so that the XOR of two sketches counts the
   samples that differ. Sets are not kept, only their size and digest.
2. Documents with equal sets form a class; its least id stands for it.
3. Representatives that share a band key are candidates. A bucket links every
   member to one centre (the member of the largest class), so a bucket gives as
   many pairs as members. Pairs whose sketches allow the similarity, with a wide
   margin, are confirmed on the full sets, worked out again from the texts.
4. Where members of a bucket are still in different components, the members
   outside the component that most of them are in are compared by sketch with those
   whose sets are of a size near enough, in blocks of bounded size inside a worker, and
   what the sketches allow is confirmed on full sets; a block returns a spanning
   forest, never all pairs. So no pair that shares a band and is similar enough
   is left unexamined. This step grows with (members outside) x (members of like
   size) of a bucket: fast where copies of a text agree, slow where very many
   different texts of one size share a band without being near copies.
5. Components come from alternating star steps.

With the bands chosen, a pair at the threshold shares no band with probability
below 1e-6 (``bands_for``); everything after that is exact up to 64-bit hashes.

Defined cases. Null, empty or wordless texts have no shingles and are linked with
nothing. With fewer words than a shingle, the whole sequence is one. Rows with one
id are one document: repeated rows share an answer, and where the texts differ,
what is linked with one of them is linked with all (rows without shingles aside).
A row without id belongs to its class's
representative; if no row of the class has an id, component_id is null and it is
kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import bounded, joined_by_weight, mapped, mixed, slices, table, whole, words, written
from panelforge.llm.components import components

SAMPLES, SKETCH_BITS = 130, 512
#: How far below the threshold a sketch's estimate may fall (more than five standard errors).
MARGIN = 0.2
#: Members and shingles of one side of a block, about. A member is copied into a block for each CHUNK members that it meets.
CHUNK, CHUNK_SHINGLES = 2048, 1_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float) -> tuple[int, int]:
    """(bands, samples in each): the longest bands under which a pair at the threshold is missed below 1e-6."""
    fit = [(SAMPLES // r, r) for r in range(1, 9) if (1 - similarity**r) ** (SAMPLES // r) <= 1e-6]
    return max(fit, key=lambda x: x[1])


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    w = words(texts)
    h = np.array([xxhash.xxh64_intdigest(v) for v in w.vocab], np.uint64)[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    n = len(h)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        rolled = mixed(rolled * STEP + h[i : n - k + 1 + i]) if n >= k else rolled
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            one = np.uint64(xxhash.xxh64_intdigest(h[a:b].tobytes(), seed=b - a))
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def samples(own: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):
        least = np.minimum(least, (own[at : at + 2048, None] * _MULTIPLIERS).min(axis=0))
    return least


def sketch(sample: np.ndarray) -> bytes:
    """The odd sketch of MinHash samples: each flips one bit, chosen by its value and number."""
    bit = (mixed(sample + np.arange(SAMPLES, dtype=np.uint64) * STEP) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    return np.packbits((np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def estimate(differing: np.ndarray) -> np.ndarray:
    """The similarity that a count of differing sketch bits speaks for."""
    share = np.minimum(2 * np.asarray(differing) / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(1 - share)


def most_differing(similarity: float) -> int:
    """The most sketch bits in which a pair worth confirming may differ."""
    return int(np.flatnonzero(estimate(np.arange(SKETCH_BITS // 2)) >= similarity - MARGIN).max())


def _prepared(k: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingles(part.column("text"), k)
                keys, marks, classes = [], [], []
                for own in sets:
                    if not len(own):
                        keys.append([])
                        marks.append([])
                        classes.append(None)
                        continue
                    sample = samples(own)
                    band = np.arange(bands, dtype=np.uint64) * STEP
                    for i in range(rows):
                        band = mixed(band + sample[i : bands * rows : rows])
                    keys.append(band.view(np.int64))
                    marks.append(np.frombuffer(sketch(sample), np.int64))
                    classes.append(xxhash.xxh3_128_digest(own.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "class", "bands", "sketch"],
                )

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                own = [s.tobytes() for s in shingles(part.column("text"), k)]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(own, pa.binary())], names=["rep", "own"])

    return run


def _common(a: bytes | np.ndarray, b: bytes | np.ndarray) -> tuple[int, int]:
    """(size of the intersection, of the union) of two sorted sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared, len(x) + len(y) - shared


def _linked(a: bytes, b: bytes, percent: int) -> bool:
    shared, union = _common(a, b)
    return 100 * shared >= percent * union


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            own = zip(batch.column("own_a").to_pylist(), batch.column("own_b").to_pylist(), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([_linked(x, y, percent) for x, y in own], pa.bool_()))

    return run


def _matrix(block: pd.DataFrame, column: str) -> np.ndarray:
    return np.array([np.asarray(x) for x in block[column]], np.int64).reshape(len(block), -1)


def _possible(probes: pd.DataFrame, others: pd.DataFrame, percent: int) -> np.ndarray:
    """Which (probe, other) pairs to confirm here: of different components, allowed by sizes and sketches, and with no
    earlier band in common, as that band's bucket sees the pair too."""
    most = most_differing(percent / 100)
    pn, on = probes["n"].to_numpy()[:, None], others["n"].to_numpy()[None]
    fits = (probes["component"].to_numpy()[:, None] != others["component"].to_numpy()[None]) & (100 * np.minimum(pn, on) >= percent * np.maximum(pn, on))
    if not fits.any():
        return fits
    p, o = _matrix(probes, "bands"), _matrix(others, "bands")
    for band in range(int(np.flatnonzero(p[0] == probes["key"].iloc[0])[0])):
        fits &= p[:, band, None] != o[None, :, band]
    p, o = _matrix(probes, "sketch").view(np.uint64), _matrix(others, "sketch").view(np.uint64)  # signed numbers are counted without their sign
    for at in range(0, len(p), 64):
        rows = slice(at, at + 64)
        if fits[rows].any():
            fits[rows] &= np.bitwise_count(p[rows, None] ^ o[None]).sum(axis=2, dtype=np.int64) <= most
    return fits


BLOCK = "slot bigint, i int, j int, key bigint, rep bigint, component bigint, n bigint, bands array<bigint>, sketch array<bigint>, probe boolean"


def _sides(block: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return block[block["probe"]].reset_index(drop=True), block[~block["probe"]].reset_index(drop=True)


def _screened(percent: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        probes, others = _sides(block)
        if not len(probes) or not len(others):
            return block.iloc[:0]
        fits = _possible(probes, others, percent)
        return pd.concat([probes[fits.any(axis=1)], others[fits.any(axis=0)]])[list(block.columns)]

    return run


#: Cells of a tile's membership matrix up to which all its intersections are one product; beyond, pair by pair.
MATRIX_CELLS, TILE = 6_000_000, 128


def _links(probes: list[np.ndarray], others: list[np.ndarray], fits: np.ndarray, percent: int) -> np.ndarray:
    """The pairs of ``fits`` that are similar enough on the full sets, tile by tile."""
    out = np.zeros_like(fits)
    for i in range(0, len(probes), TILE):
        for j in range(0, len(others), TILE):
            own = np.s_[i : i + TILE, j : j + TILE]
            if fits[own].any():
                out[own] = _tile(probes[i : i + TILE], others[j : j + TILE], fits[own], percent)
    return out


def _tile(probes: list[np.ndarray], others: list[np.ndarray], fits: np.ndarray, percent: int) -> np.ndarray:
    sets = [*probes, *others]
    sizes = np.array([len(x) for x in sets])
    if fits.sum() > len(sets) and sizes.sum() <= MATRIX_CELLS:
        vocab, at = np.unique(np.concatenate(sets), return_inverse=True)
        if len(sets) * len(vocab) <= MATRIX_CELLS:
            held = np.zeros((len(sets), len(vocab)), np.float32)
            held[np.repeat(np.arange(len(sets)), sizes), at] = 1
            shared = np.rint(held[: len(probes)] @ held[len(probes) :].T).astype(np.int64)
            union = sizes[: len(probes), None] + sizes[None, len(probes) :] - shared
            return fits & (100 * shared >= percent * union)
    out = np.zeros_like(fits)
    for i, j in zip(*np.nonzero(fits), strict=True):
        out[i, j] = _linked(probes[i], others[j], percent)
    return out


def _forest(percent: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        probes, others = _sides(block)
        empty = pd.DataFrame({"a": [], "b": []}, dtype="int64")
        if not len(probes) or not len(others):
            return empty
        own = [[np.frombuffer(x, np.uint64) for x in side["own"]] for side in (probes, others)]
        i, j = np.nonzero(_links(*own, _possible(probes, others, percent), percent))
        if not len(i):
            return empty
        # One link for each pair of components, then a spanning forest of those.
        a, b = probes["component"].to_numpy()[i], others["component"].to_numpy()[j]
        ends, first = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_index=True)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        edges = []
        for (x, y), t in zip(ends.T.tolist(), first, strict=True):
            if (x := find(x)) != (y := find(y)):
                root[max(x, y)] = min(x, y)
                edges.append((probes["rep"].iloc[i[t]], others["rep"].iloc[j[t]]))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def _of_one_id(prepared: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the representatives of the texts that rows with one id have."""
    several = prepared.filter("class is not null and doc_id is not null").withColumn("h", F.xxhash64("class")).groupBy("doc_id").agg(F.min("h").alias("x"), F.max("h").alias("y")).filter("x <> y")
    several = written(several.select("doc_id"))
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    texts = prepared.select("doc_id", "class").join(several, "doc_id").distinct().join(classes.select("class", "rep"), "class")
    return texts.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))


def _outside(placed: DataFrame, percent: int) -> DataFrame:
    """The rows of ``placed`` in buckets of several components, with their class of sizes (cls) and ``probe``: whether
    they are outside the component that most members of the bucket are in. Only pairs with a probe can add a link."""
    tally = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    main = tally.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("members")).filter("members > top.m")
    main = written(main.select("key", F.col("top.component").alias("main"), "members"))
    # Similar sets differ in size by less than one class: a probe meets its own class and the two beside it.
    cls = F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100)).cast("int").alias("cls")
    return written(joined_by_weight(placed, main, "key", "members").select("key", "rep", "n", "component", (F.col("component") != F.col("main")).alias("probe"), cls))


def _meetings(placed: DataFrame, percent: int) -> DataFrame:
    """A row for each (key, cls) with rows of ``placed`` to compare: their number ``o``, their slot as others of probes
    (own) and the slots in which its probes meet others of a size near enough (targets), each with its numbers of chunks."""
    probe_n = F.when(F.col("probe"), F.col("n"))
    count = placed.groupBy("key", "cls").agg(
        *(F.count(probe_n).alias("p"), F.sum(probe_n).alias("pn"), F.min(probe_n).alias("p_least"), F.max(probe_n).alias("p_most")),
        *(F.count("n").alias("o"), F.sum("n").alias("on"), F.min("n").alias("least"), F.max("n").alias("most")),
    )
    count = written(count)
    near = count.filter("p > 0").select("key", F.col("cls").alias("of"), "p", "pn", "p_least", "p_most", F.explode(F.array(*[F.col("cls") + d for d in (-1, 0, 1)])).alias("cls"))
    near = near.join(count.select("key", "cls", "o", "on", "least", "most"), ["key", "cls"])
    near = written(near.filter(f"100 * most >= {percent} * p_least and 100 * p_most >= {percent} * least and (cls <> of or o > 1)"))
    chunks = lambda rows, total: F.greatest(F.ceil(F.col(rows) / CHUNK), F.ceil(F.col(total) / CHUNK_SHINGLES)).cast("int")
    slots = near.groupBy("key", "cls").agg(F.sum("p").alias("p"), F.sum("pn").alias("pn"), F.first("o").alias("o"), F.first("on").alias("on"))
    slots = slots.select("key", "cls", F.struct(F.xxhash64("key", "cls").alias("slot"), chunks("p", "pn").alias("rows"), chunks("o", "on").alias("columns")).alias("own"))
    targets = near.select("key", "cls", "of").join(slots, ["key", "cls"]).groupBy("key", F.col("of").alias("cls")).agg(F.collect_list("own").alias("targets"))
    both = count.select("key", "cls", "o").join(slots, ["key", "cls"], "left").join(targets, ["key", "cls"], "left")
    return written(both.filter("own is not null or targets is not null"))


#: The blocks of a row: as one of the others of its slot, and as a probe in its targets.
_PLACES = """concat(
    if(own is null, array(), transform(sequence(0, own.rows - 1), i -> named_struct('slot', own.slot, 'i', i, 'j', cast(pmod(h, own.columns) as int), 'probe', false))),
    if(not probe or targets is null, array(), flatten(transform(targets, t -> transform(sequence(0, t.columns - 1), j -> named_struct('slot', t.slot, 'i', cast(pmod(h, t.rows) as int), 'j', j, 'probe', true))))))"""


def _blocks(placed: DataFrame, meetings: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of every block (slot, i, j): a probe is in each chunk of the others of its targets, and the reverse."""
    dealt = joined_by_weight(placed, meetings, ["key", "cls"], "o").drop("n").join(reps.select("rep", "n", "bands", "sketch"), "rep")
    dealt = dealt.filter("array_contains(bands, key)").withColumn("h", F.xxhash64("rep")).withColumn("places", F.expr(_PLACES))
    return dealt.drop("probe").select("*", F.inline("places")).select(*[x.split()[0] for x in BLOCK.split(", ")])


#: Members of a bucket that share a copy of its centre's sketch and set.
PAIRS_A_COPY = 1000
#: Ids up to so many are broadcast to pick their texts where they lie; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def _set_table(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(rep, own): the sets of the documents ``ids`` (rep). A repeated row gives its set again, which adds no link."""
    ids = written(ids.distinct())
    few = ids.count() <= BROADCAST_IDS
    rows = texts.join(F.broadcast(ids) if few else ids, texts["doc_id"] == ids["rep"]).select("rep", "text")
    return written(mapped(rows, _sets(k), "rep bigint, own binary"))


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: documents are linked from ``percent`` hundredths of
    Jaccard similarity between their sets of ``shingle``-word shingles."""
    bounded(docs.sparkSession)
    bands, rows = bands_for(percent / 100)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    prepared = written(mapped(texts, _prepared(shingle, bands, rows), "doc_id bigint, n bigint, class binary, bands array<bigint>, sketch array<bigint>"))

    classes = written(prepared.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")))
    chosen = classes.filter("rep is not null")
    reps = written(prepared.join(chosen, (prepared["class"] == chosen["class"]) & (prepared["doc_id"] == chosen["rep"])).select("rep", prepared["class"].alias("class"), "size", "n", "bands", "sketch").dropDuplicates(["rep", "class"]))

    # Buckets of two and more members, each with its centre.
    keyed = reps.select("rep", "size", "n", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.max(F.struct("size", (-F.col("rep")).alias("r"))).alias("top"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    buckets = written(buckets.select("key", (-F.col("top.r")).alias("centre"), "members"))
    members = written(joined_by_weight(keyed.select("key", "rep", "n"), buckets, "key", "members"))

    # Every member with its bucket's centre: sketches first, then full sets.
    # The larger the bucket, the more copies of its centre's sketch and set its pairs are dealt to.
    copies = F.ceil(F.max("members") / PAIRS_A_COPY).cast("int").alias("copies")
    pairs = members.filter("rep <> centre").groupBy(F.col("centre").alias("a"), F.col("rep").alias("b")).agg(copies).withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    pairs = written(pairs)
    left, right = (reps.select(F.col("rep").alias(x), F.col("sketch").alias(f"s_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    copied = lambda ids, own: own.join(ids.select("a", "copies").distinct(), "a").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    differing = " + ".join(f"bit_count(s_a[{i}] ^ s_b[{i}])" for i in range(SKETCH_BITS // 64))
    allowed = pairs.join(right, "b").join(copied(pairs, left), ["a", "copies", "copy"])
    allowed = allowed.filter(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {differing} <= {most_differing(percent / 100)}"))
    allowed = written(allowed.select("a", "b", "copies", "copy").distinct())
    sets = _set_table(texts, allowed.select(F.col("a").alias("rep")).unionAll(allowed.select("b")), shingle)
    own_a, own_b = (sets.select(F.col("rep").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab")
    edges = allowed.join(own_b, "b").join(copied(allowed, own_a), ["a", "copies", "copy"])
    edges = mapped(edges.select("a", "b", "own_a", "own_b"), _confirmed(percent), "a bigint, b bigint")
    edges = written(edges.unionByName(_of_one_id(prepared, classes)))
    found = written(components(edges))

    # What is left between components inside a bucket. Every member has met the centre, so that one stays out.
    label = found.select(F.col("node").alias("rep"), "component")
    placed = members.filter("members > 2 and rep <> centre").select("key", "rep", "n").join(label, "rep", "left")
    placed = _outside(written(placed.select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))), percent)
    # A block is small in bytes and large in work: it is dealt to a fixed number of tasks, not to as few as the bytes fill.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(placed, _meetings(placed, percent), reps).repartition(tasks, "slot", "i", "j")
    screened = written(blocks.groupBy("slot", "i", "j").applyInPandas(_screened(percent), BLOCK))
    if not screened.isEmpty():
        sets = _set_table(texts, screened.select("rep"), shingle)
        more = screened.join(sets, "rep").repartition(tasks, "slot", "i", "j").groupBy("slot", "i", "j").applyInPandas(_forest(percent), "a bigint, b bigint")
        found = written(components(edges.unionByName(written(more.distinct()))))

    named = found.select(F.col("node").alias("rep"), "component")
    answer = written(classes.join(named, "rep", "left").select("class", F.coalesce("component", "rep").alias("component"), "size"))
    joined = joined_by_weight(prepared.select("doc_id", "n", "class"), answer, "class", "size", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the document with the smallest id."""
    gone = near_groups(docs, shingle, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__gone"]), "left_anti")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), shingle=3, percent=85)


QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLES: dict[str, str] = {}
