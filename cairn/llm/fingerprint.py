"""Document fingerprints: invertible Bloom lookup sketches of paragraphs (operator 2)."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, mix, null_safe_long, piece_hashes, range_bounds, text_buffer

MISSING = np.iinfo(np.int64).min
_HEAD = struct.Struct("<BIQ")
_OUT = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SMALL = 8
_SEEDS = np.array([0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_WINDOW = 8
_FIRST, _LONGEST = (8, 24, 56), 64
_RUN = 1 << 15  # a run of one byte is cut only here, so that every length fits its 16 bits


def _inner_cuts(raw: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Points within paragraphs: at their bytes 8, 24 and 56; from there on behind 8 bytes whose
    hash ends in 5 zero bits, and 64 bytes after the last point where none came. They depend on
    the paragraph's bytes before them alone, so equal beginnings are cut alike, and paragraphs
    that differ meet again. Behind 8 times the same byte there is none, but every 32,768 bytes."""
    if len(raw) <= _WINDOW:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(cut[:-1])
    w = raw.astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] | (w[k:] << np.uint64(8 * k))
    size = np.diff(np.append(first, len(raw)))
    at = np.flatnonzero((mix(w[:-1] + np.uint64(0x8EBC6AF09C88C6E3)) & np.uint64(31)) == 0) + _WINDOW
    at = at[at - first[np.searchsorted(first, at - 1, "right") - 1] > _FIRST[-1]]
    at = np.concatenate([at, *(first[size > x] + x for x in _FIRST)])
    at = np.concatenate([at, _steps(np.unique(np.concatenate([at, first])), len(raw), _LONGEST)])
    at = at[w[at - _WINDOW] != raw[at - 1].astype(np.uint64) * np.uint64(0x0101010101010101)]
    return np.concatenate([at, _steps(np.unique(np.concatenate([at, first])), len(raw), _RUN)])


def _steps(edge: np.ndarray, end: int, size: int) -> np.ndarray:
    """Points every ``size`` bytes after each edge, up to the next one."""
    more = (np.diff(np.append(edge, end)) - 1) // size
    start = np.repeat(edge, more)
    return start + (np.arange(len(start)) - np.repeat(np.cumsum(more) - more, more) + 1) * size


def paragraph_digests(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit digests of every text's paragraphs, by text, and their n+1 offsets.

    A paragraph ends after a newline or after the space behind a sentence's end, and at the points
    within that ``_inner_cuts`` finds. A repeated one is told apart by its occurrence number. The
    low 16 bits of a digest hold the paragraph's length in bytes (no piece is longer than 32,768), so
    that recovered digests can be weighed.
    """
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    cut[1:][raw == 10] = True
    if n > 1:
        stop = (raw[:-1] == 46) | (raw[:-1] == 33) | (raw[:-1] == 63)
        cut[2:][stop & (raw[1:] == 32)] = True
    cut[_inner_cuts(raw, cut)] = True
    start = np.flatnonzero(cut[:-1])
    end = np.append(start[1:], n)
    h = piece_hashes(raw, start, end, keep_space=True) if n else np.zeros(0, np.uint64)
    doc = np.searchsorted(off, start, "right") - 1
    order = np.lexsort((h, doc))
    h, doc, size = h[order], doc[order], (end - start)[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    at = np.arange(len(h))
    turn = at - np.maximum.accumulate(np.where(same, 0, at))
    h = mix(h + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h & ~np.uint64(0xFFFF)) | size.astype(np.uint64), np.searchsorted(doc, np.arange(len(off)))


def _check(key: np.ndarray) -> np.ndarray:
    return (mix(key ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def _places(key: np.ndarray, mask: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    return [base + (mix(key + seed) & mask.astype(np.uint64)).astype(np.int64) for seed in _SEEDS]


class Cells:
    """Sketches of many documents side by side: count, key and check sums of every cell."""

    def __init__(self, m: np.ndarray) -> None:
        self.m = m.astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.m)])
        n = int(self.base[-1])
        self.count, self.key, self.check = np.zeros(n, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.uint32)
        self.peeled: tuple[np.ndarray, np.ndarray] | None = None  # keys of whole peels, by document, and n+1 offsets

    def add(self, doc: np.ndarray, key: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check = _check(key)
        for at in _places(key, self.m[doc] - 1, self.base[doc]):
            np.add.at(self.count, at, np.int32(sign) if np.isscalar(sign) else sign.astype(np.int32))
            np.bitwise_xor.at(self.key, at, key)
            np.bitwise_xor.at(self.check, at, check)

    def folded(self, docs: np.ndarray, m: np.ndarray) -> "Cells":
        """The same sketches at smaller sizes: a cell adds up those that share its low bits."""
        out = Cells(m)
        size = self.m[docs]
        row = np.repeat(np.arange(len(docs)), size)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        src, dst = self.base[docs][row] + inner, out.base[row] + inner % m[row]
        np.add.at(out.count, dst, self.count[src])
        np.bitwise_xor.at(out.key, dst, self.key[src])
        np.bitwise_xor.at(out.check, dst, self.check[src])
        return out

    def listed(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All keys of documents that peel whole: (position in ``docs``, key)."""
        if self.peeled is None:
            return self.folded(docs, self.m[docs]).peel()[:2]
        keys, off = self.peeled
        size = np.diff(off)[docs]
        at = np.repeat(off[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(docs)), size), keys[at]

    def minus(self, other: "Cells") -> "Cells":
        self.count = self.count - other.count
        self.key, self.check = self.key ^ other.key, self.check ^ other.check
        return self

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (doc, key, sign), and for each document whether all was recovered. Empties the cells."""
        owner = np.repeat(np.arange(len(self.m)), self.m)
        found: list[tuple] = []
        look = np.arange(len(owner))
        for _ in range(1000):
            c = self.count[look]
            look = look[(c == 1) | (c == -1)]
            look = look[_check(self.key[look]) == self.check[look]]
            if not len(look):
                break
            order = np.lexsort((self.key[look], owner[look]))
            look = look[order]
            doc, key = owner[look], self.key[look]
            new = np.ones(len(look), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
            doc, key, sign = doc[new], key[new], self.count[look][new]
            found.append((doc, key, sign))
            self.add(doc, key, -sign)
            look = np.unique(np.concatenate(_places(key, self.m[doc] - 1, self.base[doc])))
        left = (self.count != 0) | (self.key != 0)
        good = np.ones(len(self.m), bool)
        good[owner[left]] = False
        if not found:
            z = np.zeros(0, np.int64)
            return z, z.view(np.uint64), z, good
        doc, key, sign = (np.concatenate(x) for x in zip(*found))
        return doc, key, sign, good


class Sketches:
    """Fingerprints of texts. A document's size is the smallest power of two at which its own
    sketch peels completely, so any two fingerprints can be compared exactly."""

    def __init__(self, raw: np.ndarray, off: np.ndarray) -> None:
        self.keys, self.off = paragraph_digests(raw, off)
        n = np.diff(self.off)
        self.n, self.length = n, np.zeros(len(n), np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        np.add.at(self.length, doc, (self.keys & np.uint64(0xFFFF)).astype(np.int64))
        m = np.maximum(_SMALL, 1 << np.ceil(np.log2(np.maximum(n, 1) * 1.25)).astype(np.int64))
        todo, got = np.arange(len(n)), []
        while len(todo):  # retry larger on failure
            trial = Cells(m[todo])
            local = np.full(len(n), -1)
            local[todo] = np.arange(len(todo))
            mine = local[doc] >= 0
            trial.add(local[doc[mine]], self.keys[mine])
            row, key, _, good = trial.peel()
            got.append((todo[row[good[row]]], key[good[row]]))
            todo = todo[~good]
            m[todo] *= 2
        self.cells = Cells(m)
        self.cells.add(doc, self.keys)
        row, key = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64), self.keys)
        order = np.argsort(row, kind="stable")
        self.cells.peeled = key[order], np.searchsorted(row[order], np.arange(len(n) + 1))

    def text(self, i: int) -> str:
        c, a, b = self.cells, int(self.cells.base[i]), int(self.cells.base[i + 1])
        size = int(c.m[i]).bit_length() - 1
        return base64.b64encode(_HEAD.pack(size, int(self.n[i]), int(self.length[i])) + c.count[a:b].astype("<i2").tobytes() + c.key[a:b].astype("<u8").tobytes() + c.check[a:b].astype("<u4").tobytes()).decode()


def _differing(x: Cells, i: np.ndarray, y: Cells, j: np.ndarray) -> np.ndarray:
    """Bytes of paragraphs in just one of two documents, for each pair of sketches (x[i], y[j])."""
    out = np.zeros(len(i), np.int64)
    most = np.minimum(x.m[i], y.m[j])
    m, todo = np.minimum(most, 4 * _SMALL), np.arange(len(i))
    while len(todo):
        size = m[todo]
        doc, key, _, good = x.folded(i[todo], size).minus(y.folded(j[todo], size)).peel()
        ok = good[doc]
        np.add.at(out, todo[doc[ok]], (key[ok] & np.uint64(0xFFFF)).astype(np.int64))
        todo = todo[~good]
        last = m[todo] >= most[todo]
        if last.any():  # too much differs for the smaller sketch: both are peeled whole
            both = [c.listed(k[todo[last]]) for c, k in ((x, i), (y, j))]
            pair, key = (np.concatenate(z) for z in zip(*both))
            order = np.lexsort((key, pair))
            pair, key = pair[order], key[order]
            same = (pair[1:] == pair[:-1]) & (key[1:] == key[:-1])
            alone = ~(np.append(same, False) | np.append(False, same)) if len(key) else np.zeros(0, bool)
            np.add.at(out, todo[last][pair[alone]], (key[alone] & np.uint64(0xFFFF)).astype(np.int64))
        todo = todo[~last]
        m[todo] *= 2
    return out


def _near(both: np.ndarray, apart: np.ndarray) -> np.ndarray:
    return np.where(both > 0, (both - apart) / np.maximum(both + apart, 1), 1.0)


def _read(texts: list[str]) -> tuple[Cells, np.ndarray]:
    raw = [base64.b64decode(t) for t in texts]
    heads = [_HEAD.unpack_from(r) for r in raw]
    c = Cells(np.array([1 << h[0] for h in heads], np.int64))
    for k, (r, h) in enumerate(zip(raw, heads)):
        m, a = 1 << h[0], int(c.base[k])
        c.count[a : a + m] = np.frombuffer(r, "<i2", m, _HEAD.size)
        c.key[a : a + m] = np.frombuffer(r, "<u8", m, _HEAD.size + 2 * m)
        c.check[a : a + m] = np.frombuffer(r, "<u4", m, _HEAD.size + 10 * m)
    return c, np.array([h[2] for h in heads], np.int64)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness (0 to 1) of fingerprints, pair by pair: shared bytes by all bytes of paragraphs."""
    (x, a), (y, b) = _read(left), _read(right)
    at = np.arange(len(left))
    return _near(a + b, _differing(x, at, y, at))


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint strings; equal texts have equal ones."""
    s = Sketches(*text_buffer(pa.array(texts, pa.string())))
    return [s.text(k) for k in range(len(texts))]


def edit_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_a_part: int = 5000, most_parts: int = 20_000) -> DataFrame:
    """Fingerprints of every text and of an edited version, with their likenesses.

    The edited text has its last floor(n/2) code points replaced by as many first ones (or all)
    of the next document in descending id order; the last document's next is the first.
    Documents are range-partitioned at cut points of the id column, and each range also gets a
    copy of the following range's first row, so the texts are shuffled once and every partition
    is streamed with one row of look-ahead. Ranges hold ``rows_a_part`` rows, or more where they
    would be over ``most_parts``: the driver and every task keep one number a range.

    Returns doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited and
    near_next. Null text: empty. Null ids come last. Rows that repeat an id follow in text order;
    a single row is its own next. Empty tables give no row. Other columns are not read.
    """
    src = docs.select(null_safe_long(id_col, MISSING).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bounds = range_bounds(src, "k", max(1, min(most_parts, -(-src.count() // rows_a_part))))
    parts = len(bounds) + 1

    def part_of(k: np.ndarray) -> np.ndarray:
        return parts - 1 - np.searchsorted(bounds, k, "left")

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for b in batches:
            k = b.column(0).to_numpy()
            for p, v in zip(part_of(k).tolist(), k.tolist()):
                best[p] = max(best.get(p, MISSING), v)
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], names=["part", "top"])

    top = {r.part: r.top for r in src.select("k").mapInArrow(tops, "part int, top long").groupBy("part").agg(F.max("top").alias("top")).collect()}
    used = sorted(top)
    before = {p: used[i - 1] for i, p in enumerate(used)}
    dealt = "part int, tail int, k long, text string"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy()
            part = part_of(k)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.zeros(len(k), np.int32)), *b.columns], schema=arrow_schema(dealt))
            first = np.array([i for i, (p, v) in enumerate(zip(part.tolist(), k.tolist())) if top[p] == v], np.int64)
            if len(first):
                t = b.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array([before[p] for p in part[first].tolist()], pa.int32()), pa.array(np.ones(len(first), np.int32)), *t.columns], schema=arrow_schema(dealt))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        size, ended = 0, False
        for b in batches:
            for tail, k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x.as_py() for x in b.column(2))):
                if ended:
                    continue
                held.append((k, text))
                size, ended = size + len(text), bool(tail)
                if size > 1 << 20 and len(held) > 1:
                    yield _rows(held)
                    held, size = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield _rows(held)

    ordered = src.mapInArrow(deal, dealt).repartitionById(parts, F.col("part")).sortWithinPartitions("tail", F.desc("k"), "text")
    return ordered.select("tail", "k", "text").mapInArrow(sketch, _OUT)


def _rows(held: list[tuple[int, str]]) -> pa.RecordBatch:
    """Result rows of all but the last of consecutive documents."""
    ids, texts = [k for k, _ in held[:-1]], [t for _, t in held]
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:])]
    own, other = Sketches(*text_buffer(pa.array(texts, pa.string()))), Sketches(*text_buffer(pa.array(edited, pa.string())))
    at = np.arange(len(edited))
    near_edited = _near(own.length[at] + other.length, _differing(own.cells, at, other.cells, at))
    near_next = _near(own.length[at] + own.length[at + 1], _differing(own.cells, at, own.cells, at + 1))
    cols = [pa.array([None if k == MISSING else k for k in ids], pa.int64()), [len(t) for t in texts[:-1]], edited, [own.text(i) for i in at], [other.text(i) for i in at], near_edited, near_next]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow_schema(_OUT))], schema=arrow_schema(_OUT))
