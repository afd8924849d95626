import inspect
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm.packing import default_tokenizer
from tests.llm.test_duplicates import brute_classes, brute_substrings
from tests.llm.test_texts import speech


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("tables")
    docs, labels = [], []
    for i in range(240):
        text = speech(rng.choice(["en", "fr", "de"]), rng, rng.randrange(30, 90))
        if i > 20 and rng.random() < 0.2:
            w = docs[rng.randrange(20)][1].split()
            w[rng.randrange(len(w))] += "x"
            text = " ".join(w)
        if i > 20 and rng.random() < 0.2:
            text += " " + " ".join(docs[rng.randrange(20)][1].split()[:28])
        toxic = i > 20 and rng.random() < 0.2
        if toxic:
            text = " horrid ".join(text.split(" ", 4))
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(900, None, "en", "s", None), (901, "... 12 ...", "en", "s", 10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, {i for i, _, t in labels if t}


def test_stages(spark, tables):
    folder, docs, toxic = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "near-duplicates", "substring dedup", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, folder).collect(), now.schema)
        assert now.columns == list(corpus_pipeline.COLUMNS)
        seen.append({r.doc_id: r.text for r in now.collect()})
    clean = {i for i, *_ in docs} - toxic
    assert seen[0].keys() == clean and seen[1].keys() == clean - {900, 901}
    classes = brute_classes(sorted(seen[1].items()), 5, 80)
    assert seen[2].keys() == {i for i, (_, c) in classes.items() if c == i} and len(seen[2]) < len(seen[1])
    cut = brute_substrings(sorted(seen[2].items()), 20)
    assert seen[3] == {i: t for i, (_, _, t) in cut.items()} and any(g for _, g, _ in cut.values())
    library = Tokenizer.from_file(default_tokenizer())
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in seen[3].items()}
    assert {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    whole = corpus_pipeline.run(spark, folder)
    totals = lambda df: {r.doc_id: (r.n, r.t) for r in df.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()}
    assert totals(whole) == totals(pieces)  # cuts may differ with the order of the files


def test_language_stage_judges_words_alone(spark):
    rng = random.Random(4)
    spoken = [speech(lang, rng, rng.randrange(20, 60)) for lang in ("en", "fr", "de") for _ in range(60)]
    rows = [(i, t, ("en", "fr", "de")[i // 60]) for i, t in enumerate(spoken)]
    key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    own = ["A.", "x", "R2D2", f'token = "{key}" the of', f"the 2353820953013749 +1 (168) 555-5254 19.37.233.111 {key}", spoken[0].upper().replace(" ", "!! ")]
    noise = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(200)), "Это русский текст о погоде", "... 12 ...", None]
    rows += [(1000 + i, t, "en") for i, t in enumerate(own)] + [(2000 + i, t, None) for i, t in enumerate(noise)]
    docs = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.reject_foreign(spark, docs, "").collect()}
    assert kept == {i for i, *_ in rows if i < 2000}


def test_language_stage_keeps_labelled_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text rlike '[A-Za-z]'")
    assert corpus_pipeline.reject_foreign(spark, docs, "").count() == docs.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("__text", "__doc", "toxic", "p_toxic", "lang_pred", "score", "words", "kept", "row", "n_words", "component_id", "ids", "start")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, tables, name, stage):
    """Empty tables, columns with the stages' own names, nulls in every column, very long and repeated rows."""
    folder, docs, _ = tables
    empty = stage(spark, spark.createDataFrame([], SCHEMA), folder)
    assert empty.count() == 0
    odd = [(None, docs[0][1], None, None, None), (None, None, None, None, None), (1, docs[1][1], None, "s", 1), (1, docs[1][1], None, "s", 1), (2, "", "en", "s", 0), (3, (docs[3][1] + " ") * 3000, "en", "s", 9)]
    plain = spark.createDataFrame([r for r in docs[:60]] + odd, SCHEMA)
    wide = plain.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    columns = list(corpus_pipeline.COLUMNS) if name != "packing" else ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    got, same = stage(spark, wide, folder), stage(spark, plain, folder)
    assert got.columns == same.columns == columns
    if name == "packing":
        columns = ["doc_id", "doc_tokens"]
    order = lambda df: sorted(map(str, df.select(*columns).distinct().collect()))
    assert order(got) == order(same)


def test_one_row_of_each_class_stays(spark):
    text = "one two three four five six seven eight"
    rows = [(5, text), (5, text), (None, text), (4, text.upper()), (4, "other words stand in this row of the table"), (None, "no id but words of its own are here"), (6, None), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == [(-1, rows[5][1]), (4, text.upper()), (4, rows[4][1]), (6, ""), (6, ""), (7, "")]


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert names["pipeline"] is corpus_pipeline.run and [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in names)] == []
