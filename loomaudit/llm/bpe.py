"""BPE encoding and decoding with backtracking.

All token matches of a word come from one Aho-Corasick pass. The encoder takes
the longest match at each place, checks it against the token before it in a
pair-compatibility table, and steps back to shorter matches or earlier places
where a pair would not survive the merges: linear time, and exactly the merges
of the vocabulary. Decoding gathers bytes through an offset table.

Null texts count as empty: no ids, an empty decoded text. Needs a vocabulary
whose ids are its single bytes followed by its merges in order.
"""

from __future__ import annotations

import ctypes
import gc
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomaudit.llm.pieces import AgingEncoder, check_spec

#: Texts that are handled at once within an Arrow batch.
ROWS = 512
#: Pairs, and words of a generation, that are remembered.
MOST_PAIRS, MOST_WORDS = 200_000, 100_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, to that byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, the split of each token into the pair that it was merged from, and the tables of encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec)
        letters = byte_letters()
        tokens = {i: bytes(letters[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = tokens | {i: s.encode() for s, i in self.special.items()}
        ids = {b: i for i, b in tokens.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.split = {i: (i, i) for i in tokens}
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right = (ids[bytes(letters[c] for c in x)] for x in (a, b))
            whole = ids[tokens[left] + tokens[right]]
            if whole <= max(left, right):
                raise ValueError("the vocabulary's ids do not follow its merges")
            self.pairs[left, right] = whole
            self.split[whole] = left, right
        self.compatible: dict[int, bool] = {}  # by left << 32 | right
        self.single = [ids[bytes([b])] for b in range(256)]
        self.matcher = ahocorasick.Automaton()
        for i, b in tokens.items():
            if len(b) > 1:
                self.matcher.add_word(b.decode("latin-1"), (len(b) - 1, i))
        self.sizes = {i: len(b) for i, b in tokens.items()}
        self.matcher.make_automaton()
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(max(self.tokens) + 1)], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.blob = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(len(self.lengths))), dtype=np.uint8)
        self.encoder = AgingEncoder(self.encode_word, self.special, MOST_WORDS)

    def survives(self, left: int, right: int) -> bool:
        """Whether the merges leave left and right side by side: no merge across their border comes before those that make them."""
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= MOST_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._survives(left, right)
        return known

    def _survives(self, left: int, right: int) -> bool:
        before = len(self.lengths) + 1
        while True:
            if self.pairs.get((left, right), before) < before:
                return False
            # Undo the later of the two merges; what lay at the border before it may have merged across only earlier than it.
            ends, begins = self.split[left][1] != left, self.split[right][0] != right
            if not ends and not begins:
                return True
            if ends and (left > right or not begins):
                before, left = left, self.split[left][1]
            else:
                before, right = right + 1, self.split[right][0]

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word."""
        data = word.encode("utf-8", "surrogatepass")
        single, sizes, known = self.single, self.sizes, self.compatible.get
        at = [[single[b]] for b in data]  # the tokens that start at each place, the longest last
        for last, (before, token) in self.matcher.iter(data.decode("latin-1")):
            at[last - before].append(token)
        left_over = list(map(len, at))  # matches not yet tried at each place
        dead = bytearray(len(data) + 1)  # places from which the rest cannot be encoded
        out: list[int] = []
        place, previous, end = 0, -1, len(data)
        while place < end:
            tokens, k = at[place], left_over[place]
            while k:
                k -= 1
                token = tokens[k]
                after = place + sizes[token]
                if dead[after]:
                    continue
                if previous >= 0:
                    stays = known(previous << 32 | token)
                    if stays is None:
                        stays = self.survives(previous, token)
                    if not stays:
                        continue
                left_over[place] = k
                out.append(token)
                place, previous = after, token
                break
            else:
                dead[place] = 1
                place -= sizes[out.pop()]
                previous = out[-1] if out else -1
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        return self.blob[np.arange(ends[-1]) + np.repeat(self.offsets[ids] - ends + n, n)].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def release() -> None:
    """Gives the memory of the tables back to the system."""
    vocabulary.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def encode_texts(texts: pa.Array, vocab: Vocabulary) -> pa.Array:
    """The ids of each text."""
    ids, ends = vocab.encoder(texts)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))


def decode_ids(ids: pa.ListArray, vocab: Vocabulary) -> pa.Array:
    """The text of each run of ids; what is not UTF-8 is replaced."""
    flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    data = vocab.decode(flat)
    cuts = np.concatenate([[0], np.cumsum(vocab.lengths[flat])])[ends]
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())


def with_ids(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of text (array<int>) and, if named, the decoded text. A column of docs that has one of these names, in any case, is replaced."""
    new = {x.lower() for x in (ids, decoded) if x}
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new))
    names = [*docs.columns, ids, *([decoded] if decoded else [])]
    at_text = docs.columns.index(text)
    plain = [f"c{i}" for i in range(len(names))]  # names with dots do not pass through mapInArrow
    docs = docs.toDF(*plain[: len(docs.columns)])
    schema = T.StructType([*docs.schema.fields, T.StructField(plain[len(docs.columns)], T.ArrayType(T.IntegerType(), False))])
    if decoded:
        schema.add(plain[-1], "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    made = [encode_texts(part.column(at_text), vocab)]
                    if decoded:
                        made.append(decode_ids(made[0], vocab))
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], names=plain)
        finally:
            del vocab  # the worker may serve other stages next
            release()

    return docs.mapInArrow(run, schema).toDF(*names)


def decoded(ids: Column, path: str) -> Column:
    """The text of a column of ids."""

    def run(column: pa.Array) -> pa.Array:
        return decode_ids(column, vocabulary(path))

    return F.arrow_udf(run, "string")(ids)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
