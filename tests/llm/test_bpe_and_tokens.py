import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomaudit.llm import bpe, pieces, queries, token_files
from loomaudit.llm.common import load

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "a", "the", "'s", "é", "Ж", "中", "😀", "1", "²", "_", "!!", "\r\n", "<|endoftext|>", "ſ", "'ll", "\u200b", "abcabcabc", "zzzzzz", "\x00", " aaaaaaaaaaaa", "=====", "word.", "word,"]


def library(texts):
    return [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    return bpe.encode_texts(pa.array(texts, pa.string()), bpe.vocabulary(PATH)).to_pylist()


def test_odd_texts():
    random.seed(1)
    texts = ["".join(random.choices(ODD, k=random.randint(0, 30))) for _ in range(5000)] + ["x" * 20_000, "ab" * 10_000, " " * 5000]
    assert ours(texts) == library(texts)
    again = bpe.decode_ids(bpe.encode_texts(pa.array(texts), bpe.vocabulary(PATH)), bpe.vocabulary(PATH)).to_pylist()
    assert again == texts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), max_size=5))
def test_any_texts(texts):
    assert ours(texts) == library(texts)


def test_query(spark, data):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in load(spark, data, "documents").collect()))
    want = {}
    for (i, text), ids in zip(docs, library([t for _, t in docs]), strict=True):
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op6_bpe(spark, data).collect()}
    assert got == want


def test_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "a b", 7)], "doc_id bigint, text string, ids_ int")
    out = bpe.with_ids(df, PATH, decoded="back").collect()
    assert [(r["doc_id"], r["ids_"], len(r["ids"]), r["back"]) for r in out] == [(1, 5, 0, ""), (1, 6, 0, ""), (None, 7, 2, "a b")]
    assert bpe.with_ids(df.limit(0), PATH).count() == 0
    assert df.limit(1).select(bpe.decoded(F.array().cast("array<int>"), PATH).alias("t")).first()["t"] == ""


@pytest.mark.parametrize("width", [1, 7, 13, 16, 17, 32])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_packing(width, n):
    ids = np.random.default_rng(n).integers(0, 2**width, n, dtype=np.uint64).astype("<u4")
    data = token_files.pack(ids, width)
    assert len(data) == -(-n // 64) * width * 8
    assert (token_files.unpack(data, width, n) == ids).all()


def test_widths():
    assert [token_files.width_of(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_token_file_query(spark, data):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in load(spark, data, "documents").collect()))
    want, start = [], 0
    for (i, _), ids in zip(docs, library([t for _, t in docs]), strict=True):
        ids = [*ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op5_token_files(spark, data).collect())
    assert got == want


def test_token_file_edge_rows(spark):
    long = "word and more, " * 60_000
    df = spark.createDataFrame([(3, None), (1, "a"), (1, "b"), (None, ""), (2, long)], "doc_id bigint, text string")
    got = token_files.read_documents(token_files.write_tokens(df, PATH)).collect()
    ids = {None: [0], 3: [0], 2: [*library([long])[0], 0]}
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("1", 2), ("1", 2), ("2", len(ids[2])), ("3", 1), ("None", 1)]
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == [0, 1, 3, 5, 5 + len(ids[2])] and [r["doc_id"] for r in by_start] == [None, 1, 1, 2, 3]
    assert next(r["ids_crc32"] for r in got if r["doc_id"] == 2) == zlib.crc32(np.array(ids[2], dtype="<u4").tobytes())
    assert token_files.read_documents(token_files.write_tokens(df.limit(0), PATH)).count() == 0


def test_random_access(spark, tmp_path):
    from pyarrow import fs

    ids = np.random.default_rng(0).integers(0, 50_257, 3 * token_files.BLOCK + 7).astype("<u4")
    name = str(tmp_path / "x.tokens")
    with fs.LocalFileSystem().open_output_stream(name) as out:
        writer = token_files.Writer(out, 16)
        writer.add(1, ids[:10])
        writer.add(None, ids[10:])
        writer.close()
    with fs.LocalFileSystem().open_input_file(name) as file:
        reader = token_files.Reader(file)
        for a, b in ((0, 1), (token_files.BLOCK - 1, token_files.BLOCK + 1), (3 * token_files.BLOCK, len(ids)), (5, 5)):
            assert (reader.ids(a, b) == ids[a:b]).all()
        assert reader.known.tolist() == [1, 0] and reader.starts.tolist() == [0, 10]



def test_columns_named_like_the_results_are_replaced(spark):
    docs = spark.createDataFrame([(1, "some text", "old", 2.0)], "doc_id bigint, text string, IDS string, decoded double")
    made = bpe.with_ids(docs, PATH, decoded="decoded")
    assert made.columns == ["doc_id", "text", "ids", "decoded"]
    assert made.first()["decoded"] == "some text"


@pytest.mark.parametrize(
    "change",
    [
        {"normalizer": {"type": "NFC"}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}},
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"pre_tokenizer": None},
        {"model": {"type": "WordPiece"}},
        {"model": {"type": "BPE", "ignore_merges": True}},
        {"added_tokens": [{"content": "<x>", "id": 1, "lstrip": True}]},
    ],
)
def test_other_tokenizers_are_refused(change):
    good = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {"type": "BPE"}, "added_tokens": [{"content": "<x>", "id": 1}]}
    pieces.check_spec(good)
    with pytest.raises(ValueError):
        pieces.check_spec(good | change)


def test_columns_with_dots_pass_through(spark):
    docs = spark.createDataFrame([(1, "some text", "x")], "doc_id bigint, text string, `a.b` string")
    made = bpe.with_ids(docs, PATH, decoded="back")
    assert made.columns == ["doc_id", "text", "a.b", "ids", "back"] and made.first()["back"] == "some text"
