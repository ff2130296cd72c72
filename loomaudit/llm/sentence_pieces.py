"""SentencePiece encoding and decoding of merge-type (BPE) models, by backtracking.

A merge-type model joins, again and again, the two neighbours whose joined text
is the piece of the highest score, the leftmost of equals. A row of pieces is
what that gives if and only if it is so for each two neighbours alone, so a
text is encoded without merging it: one Aho-Corasick pass finds all pieces, the
encoder takes the longest at each place, checks it against the piece before it
by merging the two again, and steps back where a pair would not stay apart. A
bit field holds the places that cannot be reached from any piece before them.

Texts are escaped as the library does it: spaces become U+2581 and one more is
put in front. A character that is no piece becomes its UTF-8 bytes. Decoding
gathers bytes through an offset table.

Null texts count as empty: no ids, an empty decoded text. Repeated rows are
encoded alike, an empty table gives an empty table, a text of any length is
encoded as a whole. Columns of the input that have the name of a result are
replaced, in any case of letters. Models that ask for what is not done here
(normalisation, user-defined pieces, other types) are refused with ValueError.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomaudit.llm.pieces import AgingEncoder

#: Texts that are handled at once within an Arrow batch; pairs, and units of a generation, that are remembered.
ROWS, MOST_PAIRS, MOST_UNITS = 512, 300_000, 250_000
#: Fixed values of the model file's format: field numbers, piece types, the space sign.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and where it ends."""
    value = shift = 0
    while True:
        byte = data[at]
        value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        if key & 7 == 0:
            value, at = _number(data, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(key & 7) or _number(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """Pieces, scores, and the tables of encoder and decoder."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(fields(f.read()))
        trainer, normalizer = (dict(fields(next((v for k, v in message if k == n), b""))) for n in (TRAINER, NORMALIZER))
        pieces = [dict(fields(v)) for k, v in message if k == PIECES]
        texts, kinds = [p[1].decode() for p in pieces], [p.get(3, NORMAL) for p in pieces]
        normal = [i for i, kind in enumerate(kinds) if kind == NORMAL]
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        self.ids = {texts[i]: i for i in normal}
        self.texts = texts
        self.scores = [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces]
        self._check(trainer, normalizer, kinds)
        self.bytes = {int(texts[i][3:5], 16): i for i, kind in enumerate(kinds) if kind == BYTE}
        self.known = {t: self.scores[i] for t, i in self.ids.items()}
        letters = "".join(re.escape(t) for t in self.ids if len(t) == 1)
        self.runs = re.compile(f"[{letters}]+|[^{letters}]" if letters else "(?s).", re.S)
        self.matcher = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if len(t) > 1:
                self.matcher.add_word(t, (len(t) - 1, i))
        self.matcher.make_automaton()
        #: Signs that no piece holds behind a letter: a word can be cut before them.
        self.parts = tuple(x for x in ".," if x in self.ids and not any(a.isalpha() and b == x for t in self.ids for a, b in zip(t, t[1:])))
        self.apart: dict[int, bool] = {}  # by left << 32 | right
        self.whole = bytearray(len(texts))  # 1: a piece that its own text is merged to, 2: one that it is not, 0: not asked yet
        shown = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else trainer.get(44, " ⁇ ".encode()) if k == UNKNOWN else t.replace(SPACE, " ").encode() for t, k in zip(texts, kinds, strict=True)]
        self.lengths = np.array([len(x) for x in shown], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.is_control = np.array([k == CONTROL for k in kinds])
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.opens = np.array([k == NORMAL and t.startswith(SPACE) and bool(self.prefix) for t, k in zip(texts, kinds, strict=True)])
        self.encoder = UnitEncoder(self)

    def _check(self, trainer: dict, normalizer: dict, kinds: list[int]) -> None:
        wrong = {
            "a type other than BPE": trainer.get(3, 1) != 2,
            "no byte fallback": not trainer.get(35, 0) or kinds.count(BYTE) != 256,
            "spaces behind words": bool(trainer.get(24, 0)),
            "normalisation": bool(normalizer.get(2) or normalizer.get(6)) or bool(normalizer.get(4, 1)),
            "spaces that are not escaped": not normalizer.get(5, 1),
            "user-defined or unused pieces": any(k not in (NORMAL, UNKNOWN, CONTROL, BYTE) for k in kinds),
            "letters that are no pieces": any(c not in self.ids for t in self.ids for c in t),
            "pieces across the start of a word": any(SPACE in t.lstrip(SPACE) for t in self.ids),
        }
        if any(wrong.values()):
            raise ValueError("this model needs what is not done here: " + ", ".join(k for k, v in wrong.items() if v))

    def merged(self, text: str, border: int = -1) -> list[str] | None:
        """What merging makes of a short text; None as soon as a merge crosses the border."""
        parts, known = list(text), self.known
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = known.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            if border >= 0 and sum(map(len, parts[: at + 1])) == border:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, piece: int) -> bool:
        """Whether merging the text of a piece gives the piece."""
        if not self.whole[piece]:
            self.whole[piece] = 1 if len(self.merged(self.texts[piece])) == 1 else 2
        return self.whole[piece] == 1

    def fits(self, left: int, right: int) -> bool:
        """Whether right may follow left: merging the two again leaves them apart. Both stay as they are alone."""
        key = left << 32 | right
        answer = self.apart.get(key)
        if answer is None:
            if len(self.apart) >= MOST_PAIRS:
                self.apart.clear()
            text = self.texts[left]
            answer = self.apart[key] = self.merged(text + self.texts[right], len(text)) is not None
        return answer

    def encode_run(self, run: str) -> list[int]:
        """The ids of a text all of whose letters are pieces."""
        one = self.ids.get(run)
        if one is not None and self.stays(one):
            return [one]
        ids, texts, whole, known = self.ids, self.texts, self.whole, self.apart.get
        found = [[ids[c]] for c in run]  # the pieces that start at each place, the longest last
        for last, (before, piece) in self.matcher.iter(run):
            found[last - before].append(piece)
        untried = list(map(len, found))
        failed = bytearray((len(run) >> 3) + 1)  # a bit for each place from which the rest cannot be encoded
        out: list[int] = []
        place, previous, end = 0, -1, len(run)
        while place < end:
            pieces, k = found[place], untried[place]
            while k:
                k -= 1
                piece = pieces[k]
                after = place + len(texts[piece])
                if failed[after >> 3] >> (after & 7) & 1 or whole[piece] != 1 and not self.stays(piece):
                    continue
                if previous >= 0:
                    fits = known(previous << 32 | piece)
                    if fits is None:
                        fits = self.fits(previous, piece)
                    if not fits:
                        continue
                untried[place] = k
                out.append(piece)
                place, previous = after, piece
                break
            else:
                failed[place >> 3] |= 1 << (place & 7)
                place -= len(texts[out.pop()])
                previous = out[-1] if out else -1
        return out

    def encode_unit(self, unit: str) -> list[int]:
        """The ids of a text with all its spaces, escaped or not: letters that are no pieces, as no piece holds them, part it into runs."""
        out: list[int] = []
        for run in self.runs.findall(unit.replace(" ", SPACE)):
            if run[0] in self.ids:
                out += self.encode_run(run)
            else:
                out += [self.bytes[b] for b in run.encode()]
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each run of ids. Bytes that are not UTF-8 are each replaced by U+FFFD."""
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        n = self.lengths[flat]
        upto = np.concatenate([[0], np.cumsum(n)])
        data = self.blob[np.arange(upto[-1]) + np.repeat(self.offsets[flat] - upto[:-1], n)].tobytes() if len(flat) else b""
        out, start, controls = [], 0, bool(self.is_control[flat].any())
        for end in ends.tolist():
            first = start
            while first < end and self.is_control[flat[first]]:
                first += 1
            opened = first < end and self.opens[flat[first]]
            try:
                if controls and self.is_control[flat[first:end]].any():  # these part bytes
                    out.append(self._replaced(flat[first:end]))
                else:
                    out.append(data[upto[start] + int(opened) : upto[end]].decode())
            except UnicodeDecodeError:
                out.append(self._replaced(flat[first:end]))
            start = end
        return pa.array(out, pa.string())

    def _replaced(self, ids: np.ndarray) -> str:
        """The text of ids some of whose bytes are not UTF-8."""
        parts, run = [], b""
        for k, i in enumerate([*ids.tolist(), -1]):
            if i >= 0 and self.is_byte[i]:
                run += self.blob[self.offsets[i] : self.offsets[i] + 1].tobytes()
                continue
            while run:
                size = next((s for s in range(1, 5) if _is_letter(run[:s])), 0)
                parts.append(run[:size].decode() if size else "�")
                run = run[size or 1 :]
            if i >= 0:
                text = self.blob[self.offsets[i] : self.offsets[i] + self.lengths[i]].tobytes().decode()
                parts.append(text[1:] if k == 0 and self.opens[i] else text)
        return "".join(parts)


def _is_letter(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


class UnitEncoder(AgingEncoder):
    """Texts in Arrow batches, cut before the signs that stand for spaces, as no piece reaches over one from its left. Texts with more than one space in a row, or one in front, are cut by a pattern instead."""

    uncut = f"^ |  |{SPACE} "
    _UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def __init__(self, model: Model):
        super().__init__(model.encode_unit, {}, MOST_UNITS)
        self.front, self.runs, self.parts = model.prefix.replace(SPACE, " "), model.runs, model.parts

    def piece(self, prefix: str, piece: str) -> bytes:
        words = self.words
        if not prefix:
            if not piece:
                return b""
            prefix = self.front
        if piece.isalpha():
            return words[prefix + piece]
        if piece[-1:] in self.parts and piece[:-1].isalpha():
            return words[prefix + piece[:-1]] + words[piece[-1]]
        # A line end is no piece of most models; what stands beside it is then worth remembering alone.
        return words[prefix + piece] if "\n" not in piece else b"".join(map(words.__getitem__, self.runs.findall((prefix + piece).replace(" ", SPACE))))

    def encode_whole(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self._UNITS.findall((self.front + text).replace(" ", SPACE)))) if text else b""


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """The model of a file, kept for a worker's life: its tables are bounded."""
    return Model(path)


def _encoded(texts: pa.Array, of: Model) -> pa.Array:
    ids, ends = of.encoder(texts)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))


def with_ids(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of text (array<int>) and, if named, the text that they decode to."""
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
        of = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = [_encoded(part.column(at_text), of)]
                if decoded:
                    made.append(of.decode(made[0]))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=plain)

    return docs.mapInArrow(run, schema).toDF(*names)


def decoded(ids: Column, path: str) -> Column:
    """The text of a column of ids."""

    def run(column: pa.Array) -> pa.Array:
        return model(path).decode(column)

    return F.arrow_udf(run, "string")(ids)
