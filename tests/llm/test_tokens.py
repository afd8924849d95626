import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm.packing import pack
from cairn.llm.pieces import PieceEncoder, decode, encode
from cairn.llm.tokenfile import decode_block, encode_block, token_file
from cairn.llm.tokens import ByteBpe, WordBpe

TEXT = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'.,-!012éÉßñ²ªsdmtreverblathe\xa0\x85Σİ中▁<|")), st.characters(codec="utf-8")), max_size=60)
BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
HARD = ["", " ", "don't  stop\n\n\nnow   ", "<|endoftext|> x <|endoftext|>", "  lead", "I'LL we'Ve", "²½ 12345 ªº", "naïve café", "a" * 5000, "ΑΣ ας", "x</w> y"]


@pytest.fixture(scope="module")
def encoders():
    return {"byte": (ByteBpe(BYTE), Tokenizer.from_file(BYTE)), "word": (WordBpe(WORD), Tokenizer.from_file(WORD))}


@pytest.mark.parametrize("kind", ["byte", "word"])
@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_ids_match_the_library(encoders, kind, text):
    own, library = encoders[kind]
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_hard_texts(encoders, kind):
    own, library = encoders[kind]
    for text in HARD:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def pieces():
    return PieceEncoder(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_pieces_match_the_library(pieces, texts):
    own, library = pieces
    for text, got in zip(texts, own.encode(texts)):
        ids = np.frombuffer(got, "<i4")
        assert ids.tolist() == library.encode(text) and own.decode(ids) == library.decode(ids.tolist())


def test_piece_columns(spark):
    df = spark.createDataFrame([(1, "hello  world é中\x07", 9), (2, None, 9), (3, "", 9), (1, "hello  world é中\x07", 9), (4, "w" * 20_000, 9)], "doc_id int, text string, ids int")
    got = decode(encode(df))
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    assert got.where("coalesce(text, '') <> decoded").count() == 0 and got.count() == 5
    assert decode(encode(df.limit(0))).count() == 0


def _docs(spark):
    texts = ["one two three", None, "", "word " * 3000, "one two three", "é 中文"]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, start int").repartition(3)


def test_pack(spark):
    library = Tokenizer.from_file(BYTE)
    docs = _docs(spark)
    rows = pack(docs, length=64).collect()
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == len(got.setdefault(r.doc_id, [])) and r.length == len(ids) > 0 and r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id] += ids
    assert got == want
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert sorted(by) == list(range(len(by))) and all(by[i] == 64 for i in list(by)[:-1]) and by[max(by)] <= 64
    assert pack(docs.limit(0)).count() == 0


def test_pack_wide_ids_and_null_id(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "c")], "doc_id long, text string")
    rows = pack(df, end_id=70_000).collect()
    assert sum(r.length for r in rows) == 5 and sorted(r.doc_id or -1 for r in rows) == [-1, 1]
    assert all(np.frombuffer(r.ids, "<u4")[-1] == 70_000 for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_variable_length_code(ids):
    control, data = encode_block(np.array(ids, np.uint64))
    assert decode_block(control, data, len(ids)).tolist() == ids and len(control) == -(-len(ids) // 4)


def test_token_file(spark):
    library = Tokenizer.from_file(WORD)
    docs = _docs(spark).unionByName(spark.createDataFrame([(3, "again", "x", 1), (None, "no id", "x", 1)], "doc_id long, text string, ids string, start int"))
    rows = token_file(docs, rows_a_shard=2).collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32(np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in docs.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32(r.ids)) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids)
    assert token_file(docs.limit(0)).count() == 0


def test_queries_agree_with_the_library(spark, tmp_path):
    from cairn.llm.queries import op8_packing, op10_token_file

    docs = _docs(spark)
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert op8_packing(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == sum(len(Tokenizer.from_file(BYTE).encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert op10_token_file(spark, str(tmp_path)).count() == docs.count()
