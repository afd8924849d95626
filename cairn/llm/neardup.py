"""MinHash near-dedup: one-permutation hashing with optimal densification (operator 5)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, arrow_schema, lower_ascii, mix, piece_hashes, steps, store, text_buffer, words
from .graph import connected_components

_BASE = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
_SETS = "id long, shingles binary"
_EDGES = "a long, b long"
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, one after another, and their n+1 offsets.

    Words are lower-cased in ASCII; a text with fewer than ``size`` words has its whole word
    sequence as its one shingle, and one without words has none.
    """
    raw = lower_ascii(raw)
    start, end, woff = words(raw, off)
    h = piece_hashes(raw, start, end)
    n = len(h)
    gram = np.zeros(n, np.uint64)
    for k in range(size):
        m = _M[k % 5] * np.uint64(2 * (k // 5) + 1)
        gram[: n - k] += h[k:] * m if n > k else np.uint64(0)
    gram = mix(gram)
    sets, sizes = [], np.zeros(len(woff) - 1, np.int64)
    for i, (a, b) in enumerate(zip(woff[:-1].tolist(), woff[1:].tolist())):
        if b - a >= size:
            x = np.sort(gram[a : b - size + 1])
            x = x[np.append(True, x[1:] != x[:-1])]
        elif b > a:
            x = mix(h[a:b] * np.array(_M, np.uint64)[np.arange(b - a) % 5] + np.uint64(b - a)).sum(keepdims=True, dtype=np.uint64)
        else:
            continue
        sets.append(x)
        sizes[i] = len(x)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


_jump: dict[int, np.ndarray] = {}


def signatures(x: np.ndarray, off: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash: a row of ``bins`` values a set (sets without elements: zeros).

    The high bits pick the bin and the smallest element of a bin is its value. Optimal
    densification: an empty bin walks its own fixed random sequence of bins to the first that
    is not empty, so each bin agrees with probability equal to the Jaccard similarity.
    """
    rows = len(off) - 1
    sig, full = np.zeros((rows, bins), np.uint64), np.zeros((rows, bins), bool)
    if len(x):
        row = np.repeat(np.arange(rows), np.diff(off))
        place = ((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        key = row * bins + place
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sig.reshape(-1)[key[first]] = mix(x[first])
        full.reshape(-1)[key[first]] = True
    if bins not in _jump:
        _jump[bins] = np.random.default_rng(bins).integers(0, bins, (64, bins))
    r, c = np.nonzero(~full & full.any(1)[:, None])
    turn = 0
    while len(r):
        to = _jump[bins][turn % 64, (c + turn // 64) % bins]
        hit = full[r, to]
        sig[r[hit], c[hit]] = sig[r[hit], to[hit]] + np.array([0x632BE59BD9B4E019], np.uint64) * np.uint64(turn + 1)
        r, c, turn = r[~hit], c[~hit], turn + 1
    return sig


def _band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    width = sig.shape[1] // bands
    out = np.zeros((len(sig), bands), np.uint64) + np.arange(bands, dtype=np.uint64) * _M[0]
    for k in range(width):
        out = mix(out * _M[1] + sig[:, k::width][:, :bands])
    return out


def bands_for(percent: int, miss: float = 1e-5, most: int = 64) -> tuple[int, int]:
    """(bands, rows a band) at which a pair of exactly that similarity shares no bucket with a
    probability of at most ``miss``: the most rows for which ``most`` bands do."""
    s = min(percent, 100) / 100
    for rows in range(6, 0, -1):
        bands = 1 if s == 1 else math.ceil(math.log(miss) / math.log1p(-(s**rows)))
        if bands <= most or rows == 1:
            return bands, rows
    raise AssertionError


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(x, y)
    common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _linked_forest(ids: np.ndarray, block: np.ndarray, group: np.ndarray, sets: list[np.ndarray], percent: int, bins: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among two blocks of sets (or within one) that join different groups."""
    n = len(ids)
    size = np.array([len(s) for s in sets], np.float64)
    sig = signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), bins).astype(np.uint8)
    group, out = np.unique(group, return_inverse=True)[1], []
    two = block.min() != block.max()
    for i in range(n):
        far = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        if two:
            far = far[block[far] != block[i]]
        low, high = np.minimum(size[far], size[i]), np.maximum(size[far], size[i])
        far, low = far[100 * low >= percent * high], low[100 * low >= percent * high]
        if not len(far):
            continue
        # sets with few elements a bin are compared in any case; of the others a link lies eight
        # deviations below its expectation with a probability below 1e-14
        floor = percent / 100 - 8 * np.sqrt(percent / 100 * (1 - percent / 100) / bins)
        far = far[(low <= 2 * bins) | ((sig[far] == sig[i]).mean(1) >= floor)]
        for j in far.tolist():
            if group[i] != group[j] and _alike(sets[i], sets[j], percent):
                group[group == group[j]] = group[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int | None = None, rows: int | None = None, block: int = 512) -> DataFrame:
    """Classes of documents linked by 100 * |A and B| >= percent * |A or B| over word shingles.

    1. A pass over the texts gives each set's size, 128-bit content key and band hashes of its
       one-permutation signature. Equal sets collapse to their smallest id before any pairing.
    2. Buckets (equal band hashes) give star-shaped candidate edges, every member to the smallest
       id: a bucket of m sets yields m - 1 edges.
    3. A second pass over the texts gives the full sets of those documents (a filter of fixed size
       holds back the others before any shuffle). Star edges are confirmed on them; a hot centre's
       star is split over tasks of ``block`` members, each with a copy of the centre's set.
    4. Buckets whose members are all connected by then are done; most are. Members of the
       others, grouped by what their buckets connect, are cut into blocks of about ``block`` sets, and
       every pair of blocks is one bounded task that confirms links between sets not yet connected.
       It first rules out pairs by size (exact) and, for large sets, by signature, and returns a spanning
       forest, never all pairs. Components of all confirmed links are the classes.

    Bands and rows follow ``percent`` (see ``bands_for``): a pair right at the threshold misses all
    buckets with probability 1e-5, a closer one with less.

    Returns doc_id, n_shingles, component_id (smallest id reachable) and kept (doc_id is
    component_id), a row for every row of ``docs``. Null text or no words: an empty set, linked
    with nothing. Null ids: component_id null, kept true. Rows that share an id are one node.
    Other columns are not read.
    """
    if bands is None or rows is None:
        bands, rows = bands_for(percent)
    bins = bands * rows
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = arrow_schema(_BASE)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                x, off = shingle_sets(*text_buffer(b.column(1)), shingle)
                size = np.diff(off)
                some = np.flatnonzero(size)
                sums = np.zeros((2, len(size)), np.uint64)
                if len(some):
                    sums[0, some] = np.add.reduceat(mix(x), off[some])
                    sums[1, some] = np.add.reduceat(mix(x ^ _M[3]), off[some])
                hashes = _band_hashes(signatures(x, off, bins), bands)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), pa.array(hashes.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), flat], schema=schema)

    base = store(src.mapInArrow(sketch, _BASE), "sketch")
    key = ["n_shingles", "s1", "s2"]
    reps = base.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    banded = base.join(reps.select(*key, F.col("rep").alias("doc_id")), [*key, "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), F.explode("bands").alias("h")).distinct()
    centres = banded.groupBy("h").agg(F.min("id").alias("c"), F.count("*").alias("m")).where("m > 1").select("h", "c")
    shared = store(banded.join(centres, "h"), "buckets")
    stars = shared.where("id <> c").select("id", "c").distinct()
    load = stars.groupBy("c").agg(F.ceil(F.count("*") / block).alias("parts"))

    members = docs.sparkSession.sparkContext.broadcast(IdFilter(shared, "id"))  # 8 MB at any size

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch.filter(pa.array(members.value.passes(batch.column(0).to_numpy()))), "text"):
                x, off = shingle_sets(*text_buffer(b.column(1)), shingle)
                data = pa.BinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(off * 8), pa.py_buffer(x)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), data], schema=arrow_schema(_SETS))

    sets = store(src.where("doc_id is not null").mapInArrow(full, _SETS).join(shared.select("id").distinct(), "id", "left_semi"), "sets")
    spread = stars.join(load, "c").select("c", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id", F.lit(False).alias("centre"))
    heads = load.select("c", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.col("c").alias("id"), F.lit(True).alias("centre"))

    def confirm(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, is_centre = t.column("id").to_pylist(), t.column("centre").to_pylist()
        own = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("shingles")]
        # an id may stand on several rows, with different texts; each of its sets counts
        middle = [k for k, c in enumerate(is_centre) if c and len(own[k])]
        got = {ids[k] for k, c in enumerate(is_centre) if not c and len(own[k]) and any(_alike(own[m], own[k], percent) for m in middle)}
        return pa.table({"a": pa.array(sorted(got), pa.int64()), "b": pa.array([t.column("c")[0].as_py()] * len(got), pa.int64())})

    near = store(spread.unionByName(heads).join(sets, "id").groupBy("c", "part").applyInArrow(confirm, _EDGES), "stars")
    joined = store(connected_components(near), "joined")
    labelled = shared.select("h", "id").join(joined, "id", "left").select("h", "id", F.coalesce("comp", "id").alias("label"))
    mixed = labelled.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h", "low")
    rest = store(labelled.join(mixed, "h").select("id", "label", "low").distinct(), "rest")
    comps = connected_components(rest.select(F.col("label").alias("a"), F.col("low").alias("b"))).select(F.col("id").alias("label"), F.col("comp").alias("region"))
    open_ = store(rest.select("id", "label").distinct().join(comps, "label"), "open")
    sized = open_.join(open_.groupBy("region").agg(F.ceil(F.count("*") / block).alias("blocks")), "region")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks"))
    paired = sets.join(sized, "id").withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("region", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "label", "shingles")

    def settle(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, own, group = (t.column(c).to_numpy() for c in ("id", "mine", "label"))
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("shingles")]
        some = [i for i in range(len(ids)) if len(sets[i])]
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        got = _linked_forest(ids[some], own[some], group[some], [sets[i] for i in some], percent, bins) if len(some) > 1 and (lo == hi or len(set(own[some].tolist())) == 2) else []
        return pa.table({"a": pa.array([x[0] for x in got], pa.int64()), "b": pa.array([x[1] for x in got], pa.int64())})

    more = store(paired.groupBy("region", "lo", "hi").applyInArrow(settle, _EDGES), "more")
    # what the stars joined stays one node: a region's links are between its label's classes
    late = more.join(joined.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left").join(joined.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = connected_components(late)
    found = reps.select(F.col("rep").alias("id")).join(joined, "id", "left").select("id", F.coalesce("comp", "id").alias("label")).join(merged.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("comp", "label").alias("comp"))
    classes = reps.join(found, reps.rep == found.id).select(*key, F.col("comp").alias("component_id"))
    out = base.join(classes, key, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
