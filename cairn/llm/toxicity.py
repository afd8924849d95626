"""Toxicity by a classifier chain (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, piece_hashes, steps, store, text_buffer, words

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32
_CLASS[65:91] += 32


PREFIXES = (5, 6, 7, 8)


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature hash) for every word's occurrence, and each text's number of words.

    Words are runs of letters, lower-cased in ASCII. A word gives itself and its beginnings of
    5 to 8 bytes, so that families of inflected or compounded words are seen as one.
    """
    low = _CLASS[raw]
    start, end, woff = words(low, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    rows, found = [row], [piece_hashes(low, start, end)]
    size, h = end - start, np.zeros(len(start), np.uint64)
    for k in range(max(PREFIXES)):
        at = size > k
        h[at] = h[at] * np.uint64(0x100000001B3) + low[start[at] + k].astype(np.uint64) + np.uint64(1)
        if k + 1 in PREFIXES:
            more = size > k + 1
            rows.append(row[more])
            found.append(mix(h[more] + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(found), np.diff(woff)


def counted(row: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) with the number of occurrences."""
    order = np.lexsort((x, row))
    row, x = row[order], x[order]
    first = np.flatnonzero(np.append(np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (row[1:] != row[:-1])))
    return row[first], x[first], np.diff(np.append(first, len(x)))


@dataclass
class Linear:
    """Logistic regression on the design of a vocabulary and on earlier categories' log-odds."""

    vocab: np.ndarray
    weights: np.ndarray  # of the design's columns, then of the earlier categories
    bias: float


def _select(x: np.ndarray, row: np.ndarray, y: np.ndarray, size: int, least: float) -> np.ndarray:
    """Words with the largest chi-square against y, among those above ``least``."""
    vocab, inverse = np.unique(x, return_inverse=True)
    df = np.bincount(inverse, minlength=len(vocab)).astype(float)
    pos = np.bincount(inverse, y[row], minlength=len(vocab))
    n, p = len(y), y.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (pos * n - df * p) ** 2 / (df * (n - df) * p * (n - p))
    chi = np.where(np.isfinite(chi) & (df >= 3), chi, 0)
    best = np.lexsort((vocab, -chi))[:size]
    return np.sort(vocab[best[chi[best] >= least]])


def _design(x: np.ndarray, row: np.ndarray, count: np.ndarray, n_words: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Per vocabulary entry: presence and log count; and the log length, against which counts are weighed."""
    n, v = len(n_words), len(vocab)
    out = np.zeros((n, 2 * v + 1))
    if v and len(x):
        at = np.minimum(np.searchsorted(vocab, x), v - 1)
        hit = vocab[at] == x
        out[row[hit], at[hit]] = 1
        out[row[hit], v + at[hit]] = np.log1p(count[hit])
    out[:, -1] = np.log1p(n_words) / 4
    return out


def _fit(a: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    a = np.hstack([a, np.ones((len(a), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Chain:
    names: list[str]
    links: list[Linear]

    def predict(self, row: np.ndarray, x: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """A probability a text and category; each link sees the log-odds of the links before."""
        n = len(n_words)
        out = np.zeros((n, len(self.links)))
        every = np.unique(np.concatenate([k.vocab for k in self.links]))
        if len(every) and len(x):
            known = every[np.minimum(np.searchsorted(every, x), len(every) - 1)] == x
            row, x = row[known], x[known]
        row, x, count = counted(row, x)
        for k, link in enumerate(self.links):
            size = 2 * len(link.vocab) + 1
            score = link.bias + _design(x, row, count, n_words, link.vocab) @ link.weights[:size] + _logit(out[:, :k]) @ link.weights[size:]
            out[:, k] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 10_000, folds: int = 5, vocab: int = 120, least_rows: int = 4, least_chi: float = 25.0, ridge: float = 0.1) -> Chain:
    """Fit the chain on a bounded sample of labelled rows.

    ``categories`` maps a name to a boolean of ``labels``' columns; their order is the chain's.
    At most about ``max_rows`` labels are taken, by a hash of the id; that sample alone is
    broadcast to find its texts. Later categories are trained with the earlier ones'
    out-of-fold log-odds, for which words are selected anew in every fold; the links used for
    prediction are then fitted on all sampled rows. Only features that some fit
    can select reach the driver. Labels that are null (or whose text is) teach
    nothing; a category without both classes gets a constant link.
    """
    known = labels.where(F.col(id_col).isNotNull())
    count = known.count()
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / max(1, count)) + 1)
    ys = [f"y{k}" for k in range(len(categories))]
    picked = known.where(part).select(F.col(id_col).alias("__id"), *[c.cast("int").alias(y) for y, c in zip(ys, categories.values())]).dropDuplicates(["__id"])
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(picked), "__id").where("__text is not null")
    texts = texts.withColumn("__fold", F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(folds)).cast("int"))
    out = T.StructType([T.StructField("id", texts.schema["__id"].dataType), T.StructField("fold", T.IntegerType()), *[T.StructField(y, T.IntegerType()) for y in ys], T.StructField("n_words", T.LongType()), T.StructField("x", T.ArrayType(T.LongType())), T.StructField("c", T.ArrayType(T.IntegerType()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "__text", 1 << 20):
                row, x, n_words = features(*text_buffer(b.column("__text")))
                row, x, count = counted(row, x)
                off = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(off, pa.array(v)) for v in (x.view(np.int64), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__fold"), *[b.column(y) for y in ys], pa.array(n_words), *lists], names=out.names)

    coded = store(texts.select("__id", "__fold", *ys, "__text").mapInArrow(hashed, out), "features")
    ids = coded.select("id", "fold", "n_words", *ys).orderBy("id").toPandas()
    telling = _telling(coded, ids, ys, folds, vocab, least_rows, least_chi)
    flat = coded.select("id", F.posexplode("x").alias("p", "f"), "c").join(F.broadcast(telling), "f").select("id", "f", F.get("c", F.col("p")).alias("c"))
    got = flat.toArrow()
    return _chain(ids["id"].to_numpy(), ids["n_words"].to_numpy(np.int64), got.column("id").to_numpy(), got.column("f").to_numpy().view(np.uint64), got.column("c").to_numpy().astype(np.int64), [ids[y].to_numpy(dtype=float, na_value=np.nan) for y in ys], list(categories), folds, vocab, least_chi, ridge, ids["fold"].to_numpy(np.int64))


def _telling(coded: DataFrame, ids, ys: list[str], folds: int, vocab: int, least_rows: int, least_chi: float) -> DataFrame:
    """Features among the ``vocab`` best by chi-square of any category, with all folds or without one.

    The counts are taken in Spark; at most vocab * categories * (folds + 1) features remain.
    """
    each = coded.select("fold", *ys, F.explode("x").alias("f"))
    sums = {f"d{y}_{f}": F.count(F.when((F.col("fold") == f) & F.col(y).isNotNull(), 1)) for y in ys for f in range(folds)}
    sums |= {f"p{y}_{f}": F.count(F.when((F.col("fold") == f) & (F.col(y) == 1), 1)) for y in ys for f in range(folds)}
    chis = {}
    for y in ys:
        for left in range(-1, folds):
            use = [f for f in range(folds) if f != left]
            mine = ids[ids["fold"].isin(use) & ids[y].notna()]
            n, p = float(len(mine)), float((mine[y] == 1).sum())
            d, s = (sum((F.col(f"{k}{y}_{f}") for f in use), F.lit(0.0)) for k in "dp")
            chi = n * (s * n - d * p) ** 2 / F.nullif(d * (n - d) * p * (n - p), F.lit(0.0))
            chis[f"chi{y}_{left + 1}"] = F.coalesce(F.when(d >= 3, chi), F.lit(0.0))
    scored = each.groupBy("f").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in sums.items()]).where(F.col("n") >= least_rows).select("f", *[c.alias(k) for k, c in chis.items()])
    scored = store(scored.where(F.greatest(*chis, F.lit(0.0)) >= least_chi), "telling")
    best = [scored.where(F.col(k) >= least_chi).orderBy(F.desc(k), "f").limit(vocab).select("f") for k in chis]
    out = best[0]
    for b in best[1:]:
        out = out.unionByName(b)
    return out.distinct()


def _chain(ids, n_words, doc, x, count, ys, names, folds, vocab, least_chi, ridge, fold) -> Chain:
    ids, first = np.unique(ids, return_index=True)  # of repeated ids the first row counts
    n_words, ys, fold = n_words[first], [y[first] for y in ys], fold[first]
    order = np.lexsort((x, doc))
    x, count, row = x[order], count[order], np.searchsorted(ids, doc[order])
    n = len(ids)
    links, earlier = [], np.zeros((n, 0))

    def rows_of(mask: np.ndarray):
        rank = np.cumsum(mask) - 1
        inside = mask[row]
        return x[inside], rank[row[inside]], count[inside], n_words[mask]

    for k, y in enumerate(ys):
        known = ~np.isnan(y)

        def fit(use: np.ndarray) -> Linear:
            mine = use & known
            t, m = y[mine], int(mine.sum())
            if not m or t.min() == t.max():
                p = (t.sum() + 0.5) / (m + 1) if m else 1e-6
                return Linear(np.zeros(0, np.uint64), np.zeros(1 + earlier.shape[1]), float(_logit(np.array([p]))[0]))
            part = rows_of(mine)
            v = _select(part[0], part[1], t, vocab, least_chi)
            w = _fit(np.hstack([_design(*part, v), earlier[mine]]), t, ridge)
            return Linear(v, w[:-1], float(w[-1]))

        links.append(fit(np.ones(n, bool)))
        if k + 1 < len(ys):
            apart = np.zeros(n)
            for f in range(folds):
                one, test = fit(fold != f), fold == f
                apart[test] = np.hstack([_design(*rows_of(test), one.vocab), earlier[test]]) @ one.weights + one.bias
            earlier = np.hstack([earlier, np.clip(apart, -14, 14)[:, None]])
    return Chain(names, links)


def classify(docs: DataFrame, chain: Chain, *, text_col: str = "text") -> DataFrame:
    """``docs`` with a probability column p_<category> for each link of the chain.

    Whole texts are read. Null or empty text: the links' probabilities without any word. Columns
    of those names are replaced. Rows are independent of each other.
    """
    names = [f"p_{c}" for c in chain.names]
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # a few hundred features a category
    base = docs.select(*[c for c in docs.columns if c not in names], F.col(text_col).cast("string").alias("__text"))
    out = T.StructType([*base.schema.fields[:-1], *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for b in steps(batch, "__text", 1 << 20):
                p = model.predict(*features(*text_buffer(b.column("__text"))))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(p[:, k]) for k in range(p.shape[1])]], names=out.names)

    return base.mapInArrow(run, out)


def label_categories() -> dict[str, Column]:
    """The categories that the table ``labels`` can teach, from general to specific."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` with p_low_quality, p_toxic and toxic (p_toxic >= threshold)."""
    chain = train(docs, labels, label_categories(), **options)
    return classify(docs.drop("toxic"), chain).withColumn("toxic", F.col("p_toxic") >= threshold)
