"""SentencePiece encoding and decoding over a shared-prefix trie (operator 3)."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
_CACHE = 64 << 20  # bytes of words and ids that a worker keeps, about
_KEPT = 64  # longer words (a text without spaces is one) are not kept


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _size(item: tuple[str, bytes]) -> int:
    return 200 + 2 * len(item[0]) + len(item[1])


class PieceEncoder:
    """Exact ids of a SentencePiece BPE model with byte fallback.

    Each prefix of a word has one best state: the last piece of its encoding. Piece p ends the
    prefix of length i exactly if the best state at i - len(p) may stand before p, that is, if
    merging in score order would not join the two across their border. Words are sorted, so that
    the walk goes depth-first through their trie and keeps the states of the common prefix.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        normal = [i for i in range(lib.vocab_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        text = {i: lib.id_to_piece(i) for i in normal}
        base = [i for i in normal if len(text[i]) == 1]
        longer = sorted((i for i in normal if len(text[i]) > 1), key=lambda i: -lib.get_score(i))
        self.order = {text[i]: k for k, i in enumerate(base + longer)}
        self.pieces = [text[i] for i in base + longer]
        self.code = [np.int32(i).astype("<i4").tobytes() for i in base + longer]
        self.left, self.right = list(range(len(self.pieces))), list(range(len(self.pieces)))
        self.reach = set(range(len(base)))
        for k in range(len(base), len(self.pieces)):
            if (last := self._merge(self.pieces[k])) is not None:
                self.left[k], self.right[k] = last
                self.reach.add(k)
        self.ends = {p: k for p, k in self.order.items() if k in self.reach}
        lengths: dict[str, set[int]] = {}
        for p in self.ends:
            lengths.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {end: tuple(sorted(n, reverse=True)) for end, n in lengths.items()}
        self.allowed: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self.spare = [np.int32(lib.piece_to_id(f"<0x{b:02X}>")).astype("<i4").tobytes() for b in range(256)]
        self.spell = [lib.id_to_piece(i).replace(MARK, " ").encode() for i in range(lib.vocab_size())]
        for b in range(256):
            self.spell[lib.piece_to_id(f"<0x{b:02X}>")] = bytes([b])
        for i in range(lib.vocab_size()):
            if lib.is_control(i):
                self.spell[i] = b""
            elif lib.is_unknown(i):
                self.spell[i] = " ⁇ ".encode()

    def _merge(self, text: str) -> tuple[int, int] | None:
        """The last merge that makes a whole piece of its characters; None if they end as several."""
        parts = [self.order.get(c) for c in text]
        if None in parts:
            return None
        pair = None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.order.get(self.pieces[parts[i]] + self.pieces[parts[i + 1]])
                if k is not None and (best is None or k < best):
                    best, at = k, i
            if best is None:
                return None
            pair = parts[at], parts[at + 1]
            parts[at : at + 2] = [best]
        return pair

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging keeps the border between pieces a and b: undo the merges on its two
        sides from the latest on, and look for one across the border that would come earlier."""
        order, pieces, limit = self.order, self.pieces, len(self.pieces)
        while True:
            k = order.get(pieces[a] + pieces[b])
            if k is not None and k < limit:
                return False
            if a > b:
                limit, a = a, self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    if a == limit:
                        return True

    def learn(self, words: set[str]) -> None:
        """Encode distinct marked words into the cache, depth-first through their trie."""
        ends, allowed, lengths, size, short = self.ends, self.allowed, self.lengths, len(self.pieces), (2, 1)
        before, state = "", [-1]  # state[i]: piece that ends the prefix of length i; -2: a character without piece
        for word in sorted(words):
            n, at = len(word), 0
            top = min(n, len(before))
            while at < top and word[at] == before[at]:
                at += 1
            del state[at + 1 :]
            for i in range(at + 1, n + 1):
                found = None
                for size_ in lengths.get(word[i - 3 : i] if i > 2 else "", ()) + short:
                    start = i - size_
                    k = ends.get(word[start:i]) if start >= 0 else None
                    if k is None:
                        continue
                    last = state[start]
                    if last < 0:
                        found = k
                        break
                    if (ok := allowed.get(pair := last * size + k)) is None:
                        ok = allowed[pair] = self._may_follow(last, k)
                    if ok:
                        found = k
                        break
                state.append(-2 if found is None else found)
            before, i, ids = word, n, []
            while i:
                if (k := state[i]) < 0:
                    ids += [self.spare[b] for b in reversed(word[i - 1].encode())]
                    i -= 1
                else:
                    ids.append(self.code[k])
                    i -= len(self.pieces[k])
            self.cache[word] = b"".join(reversed(ids))
        if len(allowed) > 1_000_000:
            allowed.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian int32) of whole texts. The many short-lived words hold no cycles, so the
        collector rests meanwhile."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        marked = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        words = set().union(*marked)
        new = words - self.cache.keys()
        if self.held > _CACHE:
            self.cache = {w: v for w in words if (v := self.cache.get(w)) is not None}
            self.held = sum(map(_size, self.cache.items()))
        self.learn(new)
        get = self.cache.__getitem__
        out = [b"".join(map(get, m)) for m in marked]
        for w in new:
            if len(w) > _KEPT:
                del self.cache[w]
            else:
                self.held += _size((w, get(w)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        spell = self.spell
        text = b"".join([spell[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _with(df: DataFrame, source: str, target: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    base = df.select(*[c for c in df.columns if c != target], F.col(source).alias("__source"))
    return base, T.StructType([*base.schema.fields[:-1], T.StructField(target, kind)])


def encode(docs: DataFrame, *, text_col: str = "text", out_col: str = "ids", model: str | None = None) -> DataFrame:
    """``docs`` with ``out_col``: the ids of every whole text (array<int>; empty for null or empty text).

    Each Python worker keeps encoded words of up to 64 characters, about 64 MB; distinct new words of a step are encoded
    together. Rows are independent; a column named ``out_col`` is replaced.
    """
    path = model or default_model()
    base, out = _with(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, out_col, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            for b in steps(batch, "__source", 4 << 20):
                got = enc.encode([x or "" for x in b.column("__source").to_pylist()])
                off = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(got), "<i4")))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=out.names)

    return base.mapInArrow(run, out)


def decode(docs: DataFrame, *, ids_col: str = "ids", out_col: str = "decoded", model: str | None = None) -> DataFrame:
    """``docs`` with ``out_col``: the text of every id array (empty for null or none).

    Bytes that are no UTF-8 give replacement characters; a literal U+2581 comes back as a space,
    as it does from the library.
    """
    path = model or default_model()
    base, out = _with(docs, ids_col, out_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            texts = [enc.decode(x.values.to_numpy()) if x.is_valid else "" for x in b.column("__source")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=out.names)

    return base.mapInArrow(run, out)


def encode_decode(docs: DataFrame, *, text_col: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with ids and decoded, the text that comes back from those ids, in one Python pass."""
    path = model or default_model()
    base = docs.select(*[c for c in docs.columns if c not in ("ids", "decoded")], F.col(text_col).cast("string").alias("__source"))
    out = T.StructType([*base.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            for b in steps(batch, "__source", 4 << 20):
                got = enc.encode([x or "" for x in b.column("__source").to_pylist()])
                off = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype(np.int32)
                flat = np.frombuffer(b"".join(got), "<i4")
                texts = [enc.decode(flat[s:e]) for s, e in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.array(texts, pa.string())], names=out.names)

    return base.mapInArrow(run, out)
