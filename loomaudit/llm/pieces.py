"""Memoised encoding of texts, piece by piece.

No token of a byte-level BPE vocabulary spans a step from a character that is
not white space to one that is, so a text can be cut there. Each distinct piece
of a batch is cut into the tokenizer's words once, and only words not seen
before reach the encoder. The table of seen words is bounded: a full one is
emptied.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: How a byte-level BPE vocabulary cuts a text into words (fixed by its published pattern).
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: A space after any white space: there, a cut before the space would not be a cut between words.
SPACE_AFTER_BLANK = "[" + "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "] "
#: Words that are remembered.
MOST_WORDS = 700_000


#: What this encoding follows of a tokenizer file; a file that says otherwise is refused.
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def check_spec(spec: dict) -> None:
    """Raises ValueError where a tokenizer file asks for what is not done here: a normalizer, other words than WORDS, merges out of order, added tokens that take in what is around them."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    wrong = [f"pre_tokenizer.{k}" for k, v in _PRE_TOKENIZER.items() if pre.get(k, v if k == "use_regex" else None) != v]
    wrong += [f"model.{k}" for k, v in _MODEL.items() if (model.get(k) or (v if k != "type" else None)) != v]
    wrong += ["normalizer"] * bool(spec.get("normalizer"))
    wrong += [f"added token {x['content']!r}" for x in spec.get("added_tokens", []) if not x["content"] or any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if wrong:
        raise ValueError("this tokenizer file needs what is not done here: " + ", ".join(wrong))


class _Words(dict):
    """word -> its ids as little-endian int32 bytes."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = np.array(self.encode(word), dtype="<i4").tobytes()
        return ids


class PieceEncoder:
    """Encodes texts with `encode`, which gets one word at a time. `special` maps strings that are ids of their own, wherever they stand, to those ids."""

    #: Texts that hold this are not cut at every space.
    uncut = SPACE_AFTER_BLANK

    def __init__(self, encode: Callable[[str], list[int]], special: dict[str, int], most_words: int = MOST_WORDS):
        self.words, self.most_words = _Words(encode), most_words
        self.special = {s: np.array([i], dtype="<i4").tobytes() for s, i in special.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids end. Null texts are empty.

        Each distinct piece of the batch is looked up once; numpy gathers the ids."""
        if not len(texts):
            return np.empty(0, dtype="<i4"), np.empty(0, dtype=np.int64)
        if len(self.words) > self.most_words:
            self.words.clear()
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, self.uncut)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        cut = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        offsets = cut.offsets.to_numpy()
        pieces = cut.flatten().dictionary_encode()
        codes = pieces.indices.to_numpy().astype(np.int64)
        heads = offsets[:-1] - offsets[0]
        table = [self.piece(" ", x) for x in pieces.dictionary.to_pylist()]
        codes_of_heads = codes[heads]
        codes[heads] = np.arange(len(table), len(table) + len(heads))
        known = pieces.dictionary
        for i, (code, alone) in enumerate(zip(codes_of_heads.tolist(), whole.to_pylist(), strict=True)):
            table.append(self.encode_whole(texts[i].as_py()) if alone else self.piece("", known[code].as_py()))
        lengths = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // 4
        starts = np.cumsum(lengths) - lengths
        blob = np.frombuffer(b"".join(table), dtype="<i4")
        n = lengths[codes]
        ends = np.cumsum(n)
        ids = blob[np.arange(ends[-1]) + np.repeat(starts[codes] - ends + n, n)]
        return ids, ends[np.append(heads[1:], len(codes)) - 1]

    def piece(self, prefix: str, piece: str) -> bytes:
        """The ids of prefix + piece; the common shapes need no pattern."""
        words = self.words
        if piece.isalpha():
            return words[prefix + piece]
        if piece[-1:] in (".", ",") and piece[:-1].isalpha():
            return words[prefix + piece[:-1]] + words[piece[-1]]
        return b"".join(map(words.__getitem__, WORDS.findall(prefix + piece)))

    def encode_whole(self, text: str) -> bytes:
        """One text, word by word."""
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += [*map(self.words.__getitem__, WORDS.findall(text[at : m.start()])), self.special[m[0]]]
            at = m.end()
        return b"".join([*out, *map(self.words.__getitem__, WORDS.findall(text[at:]))])


class _Generations(_Words):
    """word -> its ids, of two generations: a full one becomes the older, from which what is met again is taken over."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__(encode)
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            return super().__missing__(word)
        self[word] = ids
        return ids


class AgingEncoder(PieceEncoder):
    """A PieceEncoder whose full table of words grows old before it is forgotten, so that common words stay. Each generation holds most_words."""

    def __init__(self, encode: Callable[[str], list[int]], special: dict[str, int], most_words: int = MOST_WORDS):
        super().__init__(encode, special, most_words)
        self.words = _Generations(encode)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > self.most_words:
            self.words.older = dict(self.words)
            self.words.clear()
        return super().__call__(texts)
