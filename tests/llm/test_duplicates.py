import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm.common import words
from cairn.llm.graph import connected_components
from cairn.llm.neardup import near_duplicates, shingle_sets, signatures
from cairn.llm.substring import dedup_substrings
from cairn.llm.vectors import CoverTree, judge, near_vectors, open_links, refine, tight

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_words int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aé \t\n\v\f\r\x1c\xa0中", max_size=12), max_size=5))
def test_words(texts):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    start, end, woff = words(data, off)
    got = [[bytes(data[s:e]).decode() for s, e in zip(start[a:b], end[a:b])] for a, b in zip(woff, woff[1:])]
    assert got == [WORDS.findall(t) for t in texts]


def corpus(seed, n=60, vocab=40):
    """Small vocabulary, copied passages, runs and very short texts."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        parts = [f"w{rng.randrange(vocab)}" for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            if texts and (src := (rng.choice(texts) or "").split()):
                a = rng.randrange(len(src))
                k = rng.randrange(len(parts) + 1)
                parts[k:k] = src[a : a + rng.randrange(60)]
        if rng.random() < 0.2:
            parts += ["run"] * rng.randrange(60)
        texts.append(rng.choice(["", None]) if rng.random() < 0.08 else rng.choice(texts) if texts and rng.random() < 0.15 else (" \n".join(parts)))
    return texts


def brute_substrings(rows, window):
    seen, out = {}, {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[s : s + window]), (i, s)) != (i, s):
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("seed,window,hot", [(1, 20, 64), (2, 20, 1), (3, 6, 1), (4, 9, 2)])
def test_substrings(spark, seed, window, hot):
    rows = list(enumerate(corpus(seed)))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA).repartition(5)
    got = dedup_substrings(df, window=window, hot=hot)
    assert got.columns == ["doc_id", "text", "lang", "n_words", "n_removed"]
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got.collect()} == brute_substrings(rows, window)


def test_substring_edges(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    df = spark.createDataFrame([(1, passage, "a", 0), (1, passage, "a", 0), (2, passage, "b", 0), (2, "other " + passage, "b", 0), (None, passage, "c", 0), (3, "x " * 200_000, "d", 0), (4, "", "e", 0), (5, None, "f", 0)], SCHEMA)
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in dedup_substrings(df).collect())
    assert got == [(-1, 25, 25), (1, 25, 0), (1, 25, 0), (2, 25, 25), (2, 26, 25), (3, 200_000, 199_999), (4, 0, 0), (5, 0, 0)]
    assert dedup_substrings(df.limit(0)).count() == 0


def brute_classes(rows, shingle, percent):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(spark, block):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 40, 150]))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"W{rng.randrange(500)}"
        rows.append((i, " ".join(w)))
    rows += [(200, ""), (201, None), (202, "one"), (203, "ONE"), (204, "one two"), (205, "one two three")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle=3, percent=85, block=block).collect()}
    assert got == brute_classes(rows, 3, 85)


def test_near_duplicate_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "", 0), (1, "a b c d e f", "", 0), (None, "a b c d e f", "", 0), (2, "A b c d e f", "", 0)], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(df).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = np.sort(x[:2000]), np.sort(x[1000:])
    sig = signatures(np.concatenate([a, b]), np.array([0, 2000, 4000]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.06
    small = signatures(np.array([5, 2**63], np.uint64), np.array([0, 2, 2]), 64)
    assert small[0].all() and not small[1].any()
    sets, off = shingle_sets(np.frombuffer(b"a b a b a b", np.uint8), np.array([0, 11]), 2)
    assert len(sets) == 2 and off.tolist() == [0, 2]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, j) for j in range(501, 540)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r.id: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {k: find(k) for k in parent}


def brute_vectors(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T) >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(u))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(u)).min(1))
        if (new == label).all():
            return {i: (int(near[i].sum()), int(label[i]), int(label[i]) == i) for i in range(len(u))}
        label = new


@pytest.mark.parametrize("block,centres,sample", [(4096, 1024, 4096), (16, 8, 64)])
def test_vectors(spark, block, centres, sample):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base[rng.integers(0, 12, 150)] + rng.normal(size=(150, 16)) * rng.choice([0.01, 0.2, 0.3], (150, 1)), rng.normal(size=(100, 16)), np.tile(base[:2], (20, 1))]).astype(np.float32)
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    data += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, [float("inf")] * 16, 0), (905, [], 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, [1e-30] * 3, 0), (909, [2e-30] * 3, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, block=block, centres=centres, sample=sample).collect()}
    want = brute_vectors(x) | {i: (0, i, True) for i in range(900, 906)} | {906: (1, 906, True), 907: (1, 906, False), 908: (1, 908, True), 909: (1, 908, False)}
    assert got == want


def clusters(n, per, dim, noise, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    x = np.repeat(base, per, 0) + rng.normal(size=(n * per, dim)) * noise
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_many_clusters_prune(spark):
    """Of 2,000 separate clusters less than a twentieth of all pairs is compared, cells included."""
    x = clusters(2000, 5, 24, 0.02, 8)
    reach = float(np.sqrt(0.1))
    blocks, compared = [x[k : k + 2000] for k in range(0, len(x), 2000)], 0
    cut = [refine(b, reach) for b in blocks]
    for i in range(len(blocks)):
        for j in range(i, len(blocks)):
            (cx, hx, fx), (cy, hy, fy) = cut[i], cut[j]
            _, may = judge(blocks[i][hx], fx, blocks[j][hy], fy, reach)
            compared += len(hx) * len(hy) + int(np.bincount(cx, minlength=len(hx)) @ may @ np.bincount(cy, minlength=len(hy)))
    assert compared < 0.05 * len(x) ** 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:4000])], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, block=500).collect()}
    assert got == brute_vectors(x[:4000])


def test_tight_cells_are_counted_whole():
    x = clusters(3, 400, 16, 0.01, 5)
    reach = float(np.sqrt(0.1))
    cell, head, far = refine(x, reach)
    inside, may = judge(x[head], far, x[head], far, reach)
    size = np.bincount(cell)
    assert tight(far, reach).all() and (inside | may).any(1).all() and size @ may @ size < 0.05 * len(x) ** 2
    known = np.zeros((len(x), len(x)), bool)
    for i, j in open_links(x, cell, x, cell, may, 0.95):
        known[i, j] = True
    assert ((known | inside[cell][:, cell]) == (x @ x.T >= 0.95)).all()


def test_vector_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in near_vectors(df).collect())
    assert got == [(-1, 0, -1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert near_vectors(df.limit(0)).count() == 0 and near_vectors(df.where("vec_id is null")).count() == 1


@pytest.mark.parametrize("most", [100, 1000])
def test_cover_tree(most):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(300, 4))
    p /= np.linalg.norm(p, axis=1)[:, None]
    tree = CoverTree(p, most, 0.1)
    assert len(tree.levels[-1]) == most or len(tree.levels[-1]) > 200
    for k in range(1, len(tree.levels)):
        level, above = tree.levels[k], tree.levels[k - 1]
        d = np.linalg.norm(p[level] - p[above][tree.parents[k]], axis=1)
        apart = np.linalg.norm(p[level][:, None] - p[level][None], axis=2) + 9 * np.eye(len(level))
        assert (d <= tree.radii[k] * 2 + 1e-9).all() and set(above) <= set(level) and apart.min() > tree.radii[k]
    assert sorted(tree.order().tolist()) == list(range(len(tree.leaves)))
    cell = np.linalg.norm(p[:, None] - tree.leaves[None], axis=2)
    own = cell.argmin(1)
    far = np.array([cell[own == k, k].max(initial=0) for k in range(len(tree.leaves))])
    kept = {tuple(sorted(x)) for x in tree.near_pairs(far, 0.1).tolist()}
    need = {tuple(sorted((int(own[i]), int(own[j])))) for i in range(300) for j in range(300) if np.linalg.norm(p[i] - p[j]) <= 0.1}
    assert need <= kept and len(kept) < len(tree.leaves) * (len(tree.leaves) + 1) / 2


def test_contract_queries(spark, tmp_path):
    from cairn.llm.queries import op1_substring_dedup, op5_minhash

    rows = list(enumerate(corpus(11)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in brute_substrings(rows, 20).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op5_minhash(spark, str(tmp_path)).collect()} == brute_classes(rows, 3, 85)
    assert op5_minhash(spark, str(tmp_path)).where(~(F.col("kept") == (F.col("doc_id") == F.col("component_id")))).count() == 0


def test_bands_follow_the_threshold():
    from cairn.llm.neardup import bands_for

    for percent in (50, 60, 80, 85, 95, 100):
        bands, rows = bands_for(percent)
        assert bands <= 64 and (1 - (percent / 100) ** rows) ** bands <= 1.0001e-5
    assert bands_for(85)[1] == bands_for(80)[1] == 6


def test_near_duplicates_of_hot_groups_and_low_thresholds(spark):
    """Copies of one text that differ in a word, more than a block of them, and chains at half similarity."""
    rng = random.Random(2)
    text = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(text[:50] + [f"x{k}"])) for k in range(60)] + [(100 + k, " ".join(text[k : k + 30])) for k in range(12)]
    rows += [(200 + k, " ".join(rng.choice("abcdef") for _ in range(12))) for k in range(80)] + [(300, "p " * 100_000), (301, "p q " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, shingle in ((85, 3), (50, 2)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle=shingle, percent=percent, block=16).collect()}
        assert got == brute_classes(rows, shingle, percent)


@pytest.mark.parametrize("window", [1, 31, 32, 50])
def test_substring_windows_of_any_length(spark, window):
    rows = list(enumerate(corpus(21, n=40)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in dedup_substrings(df, window=window).collect()} == brute_substrings(rows, window)
    with pytest.raises(ValueError):
        dedup_substrings(df, window=1 << 16)


def test_vector_query(spark, tmp_path):
    from cairn.llm.queries import op9_embeddings

    x = clusters(20, 6, 12, 0.08, 3)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op9_embeddings(spark, str(tmp_path)).collect()} == brute_vectors(x.astype(np.float32))
