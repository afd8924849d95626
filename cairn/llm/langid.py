"""Language identification by prediction with partial matching (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, text_buffer

ORDER = 3
UNIT = 1 << 16


def _contexts(raw: np.ndarray, off: np.ndarray, symbol: np.ndarray) -> list[np.ndarray]:
    """Symbols of all bytes and of the 1 to ORDER bytes before them (0 before a text's start)."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.arange(len(raw)) + ORDER * (doc + 1)
    padded = np.zeros(len(raw) + ORDER * len(off), np.int32)
    padded[at] = symbol[raw]
    return [padded[at - k] for k in range(ORDER + 1)]


class _Trees:
    """Frozen byte context trees of a few languages, flattened to one table of code lengths.

    Context nodes of orders 0 to 3 are rows. A row holds, for each next byte and language, the
    code length in 1/65,536 bit: method C, count / (total + distinct) for a byte seen in the
    context and the escape probability distinct / (total + distinct) times the shorter context's
    probability otherwise. The escape chains are multiplied out when the model is frozen, so
    scoring a byte is one lookup of its longest known context and one of its row.
    """

    def __init__(self, texts: dict[str, list[bytes]]) -> None:
        self.langs = sorted(texts)
        seen = np.zeros(256, bool)
        for docs in texts.values():
            for t in docs:
                seen[np.frombuffer(t, np.uint8)] = True
        self.symbol = np.full(256, int(seen.sum()) + 1, np.int32)  # bytes never seen; 0 stands before a text
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        a = self.a = int(seen.sum()) + 2
        streams = []
        for lang in self.langs:
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts[lang]])]).astype(np.int64)
            streams.append(_contexts(np.frombuffer(b"".join(texts[lang]), np.uint8), off, self.symbol))
        prob = np.full((1, a, len(self.langs)), 1 / 256, np.float32)
        self.row = np.zeros(a**ORDER, np.int32)
        tables, base = [], 0
        known = np.zeros(1, np.int32)  # the nodes of the order before, ascending
        for order in range(ORDER + 1):
            keys = [sum((s[k + 1] * np.int32(a**k) for k in range(order)), np.zeros(len(s[0]), np.int32)) for s in streams]
            nodes = np.unique(np.concatenate([np.unique(k) for k in keys])) if keys else np.zeros(0, np.int32)
            parent = np.searchsorted(known, nodes % a ** max(order - 1, 0)) if order else np.zeros(len(nodes), np.int64)
            here = prob[parent]
            for i, (s, key) in enumerate(zip(streams, keys)):
                pair, count = np.unique(np.searchsorted(nodes, key) * a + s[0], return_counts=True)
                node, sym = pair // a, pair % a
                total, distinct = np.bincount(node, count, len(nodes)), np.bincount(node, minlength=len(nodes))
                some = total > 0
                here[some, :, i] *= (distinct[some] / (total[some] + distinct[some]))[:, None]
                here[node, sym, i] = count / (total + distinct)[node]
            if order:  # contexts that end in a node take its row until a longer node does
                span = np.arange(a ** (ORDER - order)) * a**order
                self.row[(nodes[:, None] + span[None, :]).reshape(-1)] = np.repeat(base + np.arange(len(nodes)), len(span))
            tables.append(np.round(-np.log2(here) * UNIT).astype(np.int32))
            base += len(nodes)
            prob, known = here, nodes
        del prob, streams
        table = np.concatenate(tables) if base else np.zeros((1, a, 1), np.int32)
        self.code = table.reshape(-1, max(1, len(self.langs)))

    def lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Exact code length of every text under every language."""
        out = np.zeros((len(off) - 1, len(self.langs)), np.int64)
        if not len(raw) or not self.langs:
            return out
        s = _contexts(raw, off, self.symbol)
        key = s[ORDER]
        for k in range(ORDER - 1, 0, -1):
            key = key * np.int32(self.a) + s[k]
        code = self.code[self.row[key].astype(np.int64) * self.a + s[0]]
        some = np.flatnonzero(np.diff(off))
        out[some] = np.add.reduceat(code, off[:-1][some], axis=0, dtype=np.int64)
        return out


class PpmModel:
    """Context trees of all languages, ``together`` languages a table.

    A table has a row for every context that one of its languages knows and a column for each of
    them, so a table a few languages keeps the size in proportion to their number.
    """

    def __init__(self, texts: dict[str, list[bytes]], together: int = 4, max_bytes: int = 1 << 29) -> None:
        self.langs = sorted(texts)
        self.trees: list[_Trees] = []
        size = 0
        for k in range(0, len(self.langs), together):
            self.trees.append(_Trees({lang: texts[lang] for lang in self.langs[k : k + together]}))
            size += self.trees[-1].code.nbytes + self.trees[-1].row.nbytes
            if size > max_bytes:
                raise ValueError(f"the model of {len(self.langs)} languages takes more than {max_bytes} bytes; teach it fewer or shorter texts")

    def lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Exact code length of every text under every language, in 1/65,536 bit."""
        return np.hstack([t.lengths(raw, off) for t in self.trees]) if self.trees else np.zeros((len(off) - 1, 0), np.int64)


def has_letter(raw: np.ndarray, off: np.ndarray, col: pa.Array) -> np.ndarray:
    low = raw | 32
    ahead = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    out = ahead[off[1:]] > ahead[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(map(str.isalpha, col[int(i)].as_py()))
    return out


def _bucket(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_a_lang: int = 150, max_bytes: int = 30_000, max_langs: int = 500) -> PpmModel:
    """Frozen model from a bounded sample: about ``rows_a_lang`` texts a language, picked by a hash of
    the id among rows with a language whose crc32(id as text) mod 4 is not 2. Of a text above
    ``max_bytes`` bytes a stretch of so many at a place given by the hash teaches. Null texts,
    languages and ids are not learned from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), _bucket(id_col).alias("b"))
    rows = rows.where((F.col("b") != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    picked = F.lit(False)
    for r in counts:
        share = min(1.0, rows_a_lang / r["count"])
        picked |= (F.col("lang") == r.lang) & (F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000 + 1)))
    texts: dict[str, list[bytes]] = {r.lang: [] for r in counts}
    if counts:
        most = max_bytes // 4  # code points
        start = F.pmod(F.xxhash64("id", F.lit(23)), F.greatest(F.length("text") - most + 1, F.lit(1))).cast("int") + 1
        taught = F.when(F.octet_length("text") > max_bytes, F.col("text").substr(start, F.lit(most))).otherwise(F.col("text"))
        for r in rows.where(picked).select("lang", "id", taught.alias("text")).orderBy("lang", "id", "text").collect():
            texts[r.lang].append(r.text.encode())
    return PpmModel({k: v for k, v in texts.items() if v})


def identify(docs: DataFrame, model: PpmModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_a_byte (replacing columns of those names).

    lang_pred has the shortest code (ties: the first name); ``und`` with score 0 where the text is
    null, empty or without a letter, or nothing was learned. score is the posterior of lang_pred
    under equal priors. Whole texts are scored; nothing but the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_a_byte")]
    base = docs.select(*kept, F.col(text_col).cast("string").alias("__text"))
    out = T.StructType([*base.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_a_byte", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in steps(batch, "__text", 1 << 19):
                col = b.column("__text")
                raw, off = text_buffer(col)
                length = m.lengths(raw, off)
                ok = has_letter(raw, off, col) & bool(m.langs)
                best = length.argmin(1) if m.langs else np.zeros(len(ok), np.int64)
                low = length.min(1) if m.langs else np.zeros(len(ok))
                with np.errstate(under="ignore"):
                    chance = 1 / np.exp2(-np.minimum((length - low[:, None]) / UNIT, 1000)).sum(1) if m.langs else np.zeros(len(ok))
                bits = low / UNIT / np.maximum(np.diff(off), 1)
                name = pa.array([m.langs[i] if o else "und" for i, o in zip(best.tolist(), ok.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], name, pa.array(np.where(ok, chance, 0.0)), pa.array(bits)], names=out.names)

    return base.mapInArrow(score, out)


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """Learn from ``docs`` (see ``train``) and predict every row: doc_id, held_out, lang_pred, score.

    held_out: crc32(id as text) mod 4 is 2; false for a null id. Repeated rows are each predicted;
    an empty table gives no row.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(_bucket(id_col) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
