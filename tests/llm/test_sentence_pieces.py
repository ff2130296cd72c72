import hashlib
import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomaudit.llm import queries, sentence_pieces
from loomaudit.llm.common import load

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = sentence_pieces.model(PATH)
ODD = [" ", "  ", "   ", "\n", "\t", "\x00", "▁", "▁▁", "a", "the", "'s", "é", "Ж", "中", "😀", "1", "²", "!!", "\r\n", "<s>", "<0x41>", "ſ", "​", "abcabc", "zzzz", " aaaaaaa", "=====", "word.", "word,", "ing", "th", "e", "\xa0", "한국", "ß", "..", ",."]


def ours(texts):
    return sentence_pieces._encoded(pa.array(texts, pa.string()), MODEL).to_pylist()


def test_odd_texts():
    random.seed(1)
    texts = ["".join(random.choices(ODD, k=random.randint(0, 30))) for _ in range(5000)]
    texts += ["", "x" * 20_000, "ab" * 10_000, " " * 5000, "a" * 3001, "=" * 777, "▁" * 55, "the" * 4000]
    want = LIBRARY.encode(texts)
    assert ours(texts) == want
    assert MODEL.decode(pa.array(want, pa.list_(pa.int32()))).to_pylist() == [LIBRARY.decode(x) for x in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), max_size=5))
def test_any_texts(texts):
    assert ours(texts) == LIBRARY.encode(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 300)), max_size=12))
def test_any_ids(ids):
    assert MODEL.decode(pa.array([ids], pa.list_(pa.int32()))).to_pylist() == [LIBRARY.decode(ids)]


def test_pairs_of_pieces_are_judged_as_merging_does():
    random.seed(2)
    known = sorted(MODEL.ids.values())
    for left, right in (random.choices(known, k=2) for _ in range(5000)):
        if MODEL.stays(left) and MODEL.stays(right):
            text = MODEL.texts[left] + MODEL.texts[right]
            assert MODEL.fits(left, right) == (MODEL.merged(text) == [MODEL.texts[left], MODEL.texts[right]])


def test_bounded_memory_gives_the_same(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "MOST_PAIRS", 3)
    fresh = sentence_pieces.Model(PATH)
    fresh.encoder.most_words = 2
    texts = ["some words, more words.\nAnd more", " two  spaces", "x"]
    for _ in range(3):
        ids, ends = fresh.encoder(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == LIBRARY.encode(texts)


def test_query(spark, data):
    want = {}
    for r in load(spark, data, "documents").collect():
        ids = LIBRARY.encode(r["text"] or "")
        want[r["doc_id"]] = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids))))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op13_sentence_pieces(spark, data).collect()}
    assert got == want


def test_null_empty_long_repeated_and_clashing_columns(spark):
    long = "word and more, " * 60_000
    docs = spark.createDataFrame([(1, None, "old", 5), (1, "", "old", 6), (None, "a b", "old", 7), (2, long, "old", 8), (2, long, "old", 8)], "doc_id bigint, text string, IDS string, `a.b` int")
    made = sentence_pieces.with_ids(docs, PATH, decoded="back")
    assert made.columns == ["doc_id", "text", "a.b", "ids", "back"]
    got = sorted(((r["a.b"], r["ids"], r["back"]) for r in made.collect()))
    assert got == [(5, [], ""), (6, [], ""), (7, LIBRARY.encode("a b"), "a b"), *[(8, LIBRARY.encode(long), long)] * 2]
    assert sentence_pieces.with_ids(docs.limit(0), PATH).count() == 0
    assert made.where("doc_id is null").select(sentence_pieces.decoded(F.col("ids"), PATH).alias("t")).first()["t"] == "a b"


def message(pairs):
    """A protocol-buffer message of (number, int, bytes or float's four bytes)."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return b"".join(varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v for k, v in pairs)


@pytest.mark.parametrize(
    ("trainer", "normalizer", "extra", "says"),
    [
        ({3: 1}, {}, [], "a type other than BPE"),
        ({35: 0}, {}, [], "no byte fallback"),
        ({24: 1}, {}, [], "spaces behind words"),
        ({}, {4: 1}, [], "normalisation"),
        ({}, {2: b"map"}, [], "normalisation"),
        ({}, {5: 0}, [], "not escaped"),
        ({}, {}, [("x", 4)], "user-defined"),
        ({}, {}, [("xy", 1)], "letters that are no pieces"),
        ({}, {}, [("x", 1), ("▁", 1), ("x▁", 1)], "across the start"),
    ],
)
def test_other_models_are_refused(tmp_path, trainer, normalizer, extra, says):
    pieces = [(f"<0x{b:02X}>", 6) for b in range(256)] + extra
    data = message([*((1, message([(1, t.encode()), (3, k)])) for t, k in pieces), (2, message(({3: 2, 35: 1} | trainer).items())), (3, message(({3: 1, 4: 0} | normalizer).items()))])
    (tmp_path / "m").write_bytes(data)
    with pytest.raises(ValueError, match=re.escape(says)):
        sentence_pieces.Model(str(tmp_path / "m"))
