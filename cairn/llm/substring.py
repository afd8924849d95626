"""Substring dedup by recompression (operator 1)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, input_partitions, mix, piece_hashes, steps, store, text_buffer, words

LAST = np.iinfo(np.int64).max
_RUNS = "k long, b long, doc long, dk long, p long"
_MARKS = "doc long, dk long, p long, status int"
_Q1, _Q2 = 0x9E3779B97F4A7C15, 0xC6A4A7935BD1E995
_FLUSH = 1_500_000
_BITS = 16  # of p: the number of windows of a run; above them the first window's word
_LOW = (1 << _BITS) - 1
_OPEN, _MARKER = 1 << 62, 1 << 61  # in p: a run to be checked in any case; a symbol known to be shared
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(q: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """q**i and q**-i modulo 2**64 for i up to n."""
    got = _pow.get(q)
    if got is None or len(got[0]) <= n:
        size = max(1 << 20, n + 1)
        up, down = np.full(size, q, np.uint64), np.full(size, pow(q, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        got = np.cumprod(up), np.cumprod(down)
        if size == 1 << 20:
            _pow[q] = got
    return got


class Ranges:
    """Hashes of word ranges from prefix sums of word hashes."""

    def __init__(self, h: np.ndarray, q: int = _Q1) -> None:
        up, self.down = _powers(q, len(h))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def _name_runs(sym, start, end, lo, hi, doc):
    """Name every maximal run of one word; a run then depends on the word on either side."""
    n = len(sym)
    first = np.ones(n, bool)
    first[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, n))
    name = np.where(size > 1, mix(sym[at] * np.uint64(0x94D049BB133111EB) + size.astype(np.uint64)), sym[at])
    return name, at, at + size, at - 1, at + size + 1, doc[at]


def _name_pairs(sym, start, end, lo, hi, doc, turn):
    """Name pairs of a 0-class and a 1-class symbol (a symbol's class is a bit of its name).

    A symbol that stays alone depends on the one neighbour that could have taken it; one at a
    document's end depends on what lies beyond, so that it never counts as inner.
    """
    n = len(sym)
    coin = (mix(sym ^ np.uint64(turn * 0x2545F4914F6CDD1D)) >> np.uint64(17) & np.uint64(1)).astype(bool)
    same = doc[1:] == doc[:-1]
    join = np.zeros(n, bool)
    join[:-1] = ~coin[:-1] & coin[1:] & same
    taken = np.zeros(n, bool)
    taken[1:] = join[:-1]
    prev_lo = np.append(-1, np.where(same, lo[:-1], start[1:] - 1)) if n else lo
    next_hi = np.append(np.where(same, hi[1:], end[:-1] + 1), end[-1] + 1) if n else hi
    new_lo = np.where(join | ~coin, lo, prev_lo)
    new_hi = np.where(coin, hi, next_hi)
    at = np.flatnonzero(~taken)
    mate = np.minimum(at + 1, n - 1)
    pair = join[at]
    name = np.where(pair, mix(sym[at] * np.uint64(0xBF58476D1CE4E5B9) + sym[mate] + np.uint64(turn)), sym[at])
    return name, start[at], np.where(pair, end[mate], end[at]), new_lo[at], np.where(pair, hi[mate], new_hi[at]), doc[at]


def _least(value: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Position of the first smallest value in each range [i, j)."""
    best = [np.arange(len(value))]
    width = int((j - i).max()) if len(i) else 1
    while 2 << (len(best) - 1) <= width:
        step = 1 << (len(best) - 1)
        a, b = best[-1][:-step], best[-1][step:]
        best.append(np.where(value[a] <= value[b], a, b))
    power = np.array([max(0, k.bit_length() - 1) for k in range(width + 1)])[j - i]
    out = np.empty(len(i), np.int64)
    for k, table in enumerate(best):
        at = np.flatnonzero(power == k)
        a, b = table[i[at]], table[j[at] - (1 << k)]
        out[at] = np.where(value[a] <= value[b], a, b)
    return out


def window_runs(h: np.ndarray, woff: np.ndarray, window: int, rounds: int = 4):
    """Runs of windows that hang on one inner symbol: start, windows, symbol, content hash.

    After each round a symbol knows the word interval that decides it. A window's anchor is the
    symbol of the highest round whose interval lies in the window, of several the one with the
    smallest hash; that is a function of the window's words alone: equal windows have equal anchors at equal places. The name returned
    is the symbol's together with the words of its interval, all of which lie in the window.
    """
    n = len(h)
    doc = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    count = np.maximum(np.diff(woff) - window + 1, 0)
    total = int(count.sum())
    if not total:
        z = np.zeros(0, np.int64)
        return z, z, z.view(np.uint64), z.view(np.uint64)
    s = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(woff[:-1], count)
    at, name, level = s.copy(), h[s], np.zeros(total, np.int8)
    low, high = s.copy(), s + 1
    pos = np.arange(n, dtype=np.int64)
    state = (h, pos, pos + 1, pos, pos + 1, doc)
    for turn in range(rounds):
        state = _name_runs(*state) if turn == 0 else _name_pairs(*state, turn)
        sym, start, _, lo, hi, _ = state
        i = np.cumsum(np.bincount(lo + 1, minlength=n + 2))[s]
        j = np.cumsum(np.bincount(hi, minlength=n + 2))[s + window]
        ok = i < j
        pick = _least(mix(sym), i[ok], j[ok])
        at[ok], name[ok], level[ok], low[ok], high[ok] = start[pick], sym[pick], turn + 1, lo[pick], hi[pick]
    new = np.ones(total, bool)
    new[1:] = (at[1:] != at[:-1]) | (level[1:] != level[:-1]) | (s[1:] != s[:-1] + 1) | (doc[s[1:]] != doc[s[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, total))
    s1, a1 = s[first], at[first]
    ranges = Ranges(h)
    content = ranges.of(s1, s1 + size - 1 + window)
    content = mix(content ^ (size.astype(np.uint64) << np.uint64(32)) ^ (a1 - s1).astype(np.uint64))
    low, high = low[first], high[first]
    around = ranges.of(low, high) + (a1 - low).astype(np.uint64)
    return s1, size, mix(mix(name[first] + level[first].astype(np.uint64)) ^ around), content


class _Combine:
    """Map-side combining: of equal keys only the earliest leaves the task as a candidate.

    A symbol with more than ``hot`` different contents in one task (a common line in ever new
    surroundings) is surely shared. Its runs are spread by content instead of meeting in one
    group, flagged to be checked window by window, and a marker tells the symbol's own group.
    """

    def __init__(self, hot: int = 0) -> None:
        self.parts: list[tuple] = []
        self.rows, self.hot = 0, hot

    def add(self, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(cols)
        self.rows += len(cols[0])
        if self.rows >= _FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        k, b, doc, dk, p = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.rows = [], 0
        order = np.lexsort((p, dk, doc, b, k))
        k, b, doc, dk, p = (x[order] for x in (k, b, doc, dk, p))
        first = np.ones(len(k), bool)
        first[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        head = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
        later = (doc != doc[head]) | (dk != dk[head]) | (p != p[head])
        k[later], b[later] = mix(doc[later].view(np.uint64) + dk[later].view(np.uint64)), 0
        keep = first | later
        p[later] = -p[later] - 1
        cols = [c[keep] for c in (k, b, doc, dk, p)]
        if self.hot:
            k, b, _, _, p = cols
            name, group, size = np.unique(k[p >= 0], return_inverse=True, return_counts=True)
            spread = np.flatnonzero(p >= 0)[size[group] > self.hot]
            mark = name[size > self.hot]
            k[spread] = mix(k[spread] ^ b[spread])
            p[spread] |= _OPEN
            none = np.zeros(len(mark), np.int64)
            cols = [np.concatenate(c) for c in zip(cols, (mark, ~mark, none, none, none + _MARKER))]
        cols = [cols[0].view(np.int64), cols[1].view(np.int64), *cols[2:]]
        table = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=arrow_schema(_RUNS))
        for i in range(0, table.num_rows, 100_000):
            yield table.slice(i, 100_000)


def _judge(want_shared: bool):
    """Streams rows sorted by (k, b, doc, dk, p): status 0 for all but the earliest of a (k, b);
    status 1 for the earliest ones of a k with several b. Memory is a batch and one row."""
    schema = arrow_schema(_MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # k, b, its first row, whether that row still waits, whether k has several b
        for batch in batches:
            k, b, doc, dk, p = (c.to_numpy() for c in batch.columns)
            out = [(x := p < 0, doc[x], dk[x], -p[x] - 1, np.zeros(int(x.sum()), np.int32))[1:]]
            k, b, doc, dk, p = (c[p >= 0] for c in (k, b, doc, dk, p))
            if len(k):
                waits = last is not None and last[3] and want_shared
                if last is not None:  # the first row of the open group stands before the batch
                    k, b = np.append(last[0], k), np.append(last[1], b)
                    doc, dk, p = (np.append(x, y) for x, y in zip(last[2], (doc, dk, p)))
                n = len(k)
                new_k, new_b = np.ones(n, bool), np.ones(n, bool)
                new_k[1:] = k[1:] != k[:-1]
                new_b[1:] = new_k[1:] | (b[1:] != b[:-1])
                head = np.maximum.accumulate(np.where(new_b, np.arange(n), 0))
                later = (doc != doc[head]) | (dk != dk[head]) | (p != p[head])
                out.append((doc[later], dk[later], p[later] & ~_OPEN, np.zeros(int(later.sum()), np.int32)))
                group = np.cumsum(new_k) - 1
                many = np.bincount(group[new_b]) > 1
                if last is not None and last[4]:
                    many[0] = True
                if want_shared:
                    shared = new_b & (many[group] | (p & _OPEN > 0)) & (p != _MARKER)
                    if last is not None and not waits:
                        shared[0] = False
                    out.append((doc[shared], dk[shared], p[shared] & ~_OPEN, np.ones(int(shared.sum()), np.int32)))
                h, several = head[-1], bool(many[-1])
                waiting = not several and not p[h] & _OPEN and (h > 0 or last is None or waits)
                last = (k[-1], b[-1], (doc[h], dk[h], p[h]), waiting, several)
            cols = [np.concatenate(c) for c in zip(*out)]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return run


def _sorted_groups(df: DataFrame) -> DataFrame:
    return df.repartition(input_partitions(df), "k").sortWithinPartitions("k", "b", "doc", "dk", "p")


def repeated_windows(docs: DataFrame, *, window: int = 20, hot: int = 64) -> DataFrame:
    """Marks (doc, dk, p) of word windows that start earlier elsewhere; p is the first window
    shifted by 16 bits, plus the number of windows.

    ``docs`` has __doc, __dk and __text. Round one compares runs of windows by their anchor
    symbol and content. Only where a symbol is shared by different contents are the runs' single
    windows compared, by two 64-bit hashes.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combine = _Combine(hot)
        for batch in batches:
            for b in steps(batch, "__text"):
                raw, off = text_buffer(b.column("__text"))
                start, end, woff = words(raw, off)
                s1, size, name, content = window_runs(piece_hashes(raw, start, end), woff, window)
                row = np.searchsorted(woff, s1, "right") - 1
                doc, dk = b.column("__doc").to_numpy()[row], b.column("__dk").to_numpy()[row]
                yield from combine.add(name, content, doc, dk, (s1 - woff[row] << _BITS) + size)
        yield from combine.flush()

    marks = store(_sorted_groups(docs.select("__doc", "__dk", "__text").mapInArrow(runs, _RUNS)).mapInArrow(_judge(True), _MARKS), "marks")
    open_runs = marks.where("status = 1").groupBy(F.col("doc").alias("__doc"), F.col("dk").alias("__dk")).agg(F.collect_list("p").alias("__runs"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combine = _Combine()
        for batch in batches:
            for b in steps(batch, "__text"):
                raw, off = text_buffer(b.column("__text"))
                start, end, woff = words(raw, off)
                h = piece_hashes(raw, start, end)
                lists = b.column("__runs")
                p, row = lists.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
                size = p & _LOW
                s = np.repeat((p >> _BITS) + woff[row], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                row = np.repeat(row, size)
                doc, dk = b.column("__doc").to_numpy()[row], b.column("__dk").to_numpy()[row]
                yield from combine.add(Ranges(h).of(s, s + window), Ranges(h, _Q2).of(s, s + window), doc, dk, (s - woff[row] << _BITS) + 1)
        yield from combine.flush()

    edge = docs.select("__doc", "__dk", "__text").join(open_runs, ["__doc", "__dk"]).mapInArrow(single, _RUNS)
    edge = _sorted_groups(edge).mapInArrow(_judge(False), _MARKS)
    return marks.where("status = 0").unionByName(edge).select("doc", "dk", "p")


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, hot: int = 64) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that also starts earlier.

    Earlier: in a document with a smaller id, or in the same document before. Windows are judged
    on the input. All columns of ``docs`` stay; ``text_col`` becomes the kept words joined by one
    space, and n_words and n_removed (long) are added (replacing columns of those names).

    Method: recompression with global names. Every task names token runs, then over several
    rounds pairs of a 0-class and a 1-class symbol, where a name is a 64-bit hash of its parts and
    thus the same everywhere; equal substrings get equal inner symbols. The symbols, not the
    windows, are shuffled; tasks first combine equal ones, so a passage in a third of all rows
    arrives once a task, and a symbol with more than ``hot`` contents in a task is spread by
    content. Contents are verified by independent hashes.

    Null or empty text: no words, empty text. Null ids come last in the order. Rows that repeat id
    and text count as one document; rows that repeat only the id are ordered by a text hash.
    Texts shorter than the window stay whole. Empty tables give an empty result.
    """
    if not 1 <= window <= _LOW:
        raise ValueError(f"window must lie between 1 and {_LOW}")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    twice = docs.groupBy(key).count().where("count > 1").limit(1).count() > 0
    base = docs.withColumns({"__doc": key, "__dk": F.xxhash64(F.col(text_col)) if twice else F.lit(0).cast("long"), "__text": F.col(text_col).cast("string")})
    marks = repeated_windows(base, window=window, hot=hot).groupBy(F.col("doc").alias("__doc"), F.col("dk").alias("__dk")).agg(F.collect_list("p").alias("__marks"))
    joined = base.drop(text_col, "n_words", "n_removed").join(marks, ["__doc", "__dk"], "left")
    keep = [c for c in joined.columns if not c.startswith("__")]
    joined = joined.select(*keep, "__text", "__marks")
    out = T.StructType([*joined.schema.fields[: len(keep)], T.StructField(text_col, T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "__text"):
                texts, count, gone = [], [], []
                for text, marks in zip((x.as_py() for x in b.column("__text")), b.column("__marks")):
                    found = (text or "").encode().split()
                    removed = 0
                    if marks.is_valid and len(found):
                        p = marks.values.to_numpy()
                        edge = np.zeros(len(found) + 1, np.int64)
                        np.add.at(edge, p >> _BITS, 1)
                        np.add.at(edge, (p >> _BITS) + (p & _LOW) + window - 1, -1)
                        stays = np.cumsum(edge[:-1]) == 0
                        removed = int(len(found) - stays.sum())
                        count.append(len(found))
                        found = list(itertools.compress(found, stays.tolist()))
                    else:
                        count.append(len(found))
                    texts.append(b" ".join(found).decode())
                    gone.append(removed)
                arrays = [*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(count, pa.int64()), pa.array(gone, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    order = [c for c in docs.columns if c not in ("n_words", "n_removed")] + ["n_words", "n_removed"]
    return joined.mapInArrow(cut, out).select(*order)
