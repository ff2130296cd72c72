"""Token ids in binary files of fixed-width bit packing.

Each id takes the fewest bits that the vocabulary needs. Ids are packed in
blocks of BLOCK, 64 at a time into whole 64-bit words, so numpy packs and
unpacks a block with a few shifts. A file is: MAGIC; the blocks; then the
offsets of the blocks, and for each document its id, whether it has one, and
where its tokens start; then, as the last 48 bytes, six little-endian integers:
bits, tokens, documents, blocks, offset of the first table, MAGIC again.

Documents are in ascending order of their ids, those without an id first. A
null text is an empty one: it has the end id alone. Repeated ids are kept, in
an order by their texts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomaudit.llm.bpe import byte_letters
from loomaudit.llm.common import written
from loomaudit.llm.files import new_file, new_folder, place
from loomaudit.llm.pieces import PieceEncoder, check_spec

MAGIC = 0x314B41504D4F4F4C
BLOCK = 8192
#: Texts that are encoded at once.
ROWS = 2048
MANIFEST = "part int, path string, n_tokens bigint, n_docs bigint"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def width_of(vocabulary_size: int) -> int:
    """The bits that tell apart so many ids."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in `width` bits each; the last group of 64 is filled with zeros."""
    groups = np.zeros((-(-len(ids) // 64), 64), dtype=np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(groups), width), dtype="<u8")
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[:, word] |= groups[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= groups[:, i] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    """The first `count` ids of packed data, as 32-bit integers."""
    words = np.frombuffer(data, dtype="<u8").reshape(-1, width)
    ids = np.empty((len(words), 64), dtype="<u4")
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        ids[:, i] = value & mask
    return ids.reshape(-1)[:count]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> tuple[PieceEncoder, int]:
    """Encodes with the tokenizers library, each distinct word once; and the size of the vocabulary."""
    tokenizer = Tokenizer.from_file(path)
    check_spec(json.loads(tokenizer.to_str()))
    special = {x.content: i for i, x in tokenizer.get_added_tokens_decoder().items()}
    letters = str.maketrans({chr(byte): letter for letter, byte in byte_letters().items()})
    tokenize = tokenizer.model.tokenize

    def encode(word: str) -> list[int]:
        return [x.id for x in tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))]

    return PieceEncoder(encode, special), tokenizer.get_vocab_size()


class Writer:
    """Writes one file, a block at a time."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.pending, self.held, self.tokens = [], 0, 0
        self.offsets, self.doc_ids, self.known, self.starts = [], [], [], []
        out.write(np.array([MAGIC], dtype="<u8").tobytes())

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.starts.append(self.tokens)
        self.tokens += len(ids)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= 64 * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, most: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, dtype="<u4")
        for at in range(0, min(most, len(ids)), BLOCK):
            self.offsets.append(self.out.tell())
            self.out.write(pack(ids[at : min(at + BLOCK, most)], self.width))
        self.pending, self.held = [ids[most:]], max(0, len(ids) - most)

    def close(self) -> None:
        self._flush(self.held)
        at = self.out.tell()
        for values in (self.offsets, self.doc_ids, self.known, self.starts):
            self.out.write(np.array(values, dtype="<i8").tobytes())
        self.out.write(np.array([self.width, self.tokens, len(self.doc_ids), len(self.offsets), at, MAGIC], dtype="<u8").tobytes())


class Reader:
    """Reads a file; `ids(start, stop)` unpacks only the blocks that it needs."""

    def __init__(self, file):
        self.file = file
        tail = np.frombuffer(self._bytes(file.size() - 48, 48), dtype="<u8").astype(np.int64)
        if tail[5] != MAGIC:
            raise ValueError("not a token file, or a truncated one")
        self.width, self.tokens, docs, blocks, at = (int(x) for x in tail[:5])
        table = np.frombuffer(self._bytes(at, 8 * (blocks + 3 * docs)), dtype="<i8")
        self.offsets = table[:blocks]
        self.doc_ids, self.known, self.starts = table[blocks:].reshape(3, docs) if docs else np.zeros((3, 0), dtype=np.int64)

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.empty(0, dtype="<u4")
        first, last = start // BLOCK, (stop - 1) // BLOCK
        count = min(self.tokens, (last + 1) * BLOCK) - first * BLOCK
        data = self._bytes(int(self.offsets[first]), -(-count // 64) * self.width * 8)
        return unpack(data, self.width, count)[start - first * BLOCK : stop - first * BLOCK]


def write_tokens(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Encodes the texts of docs (doc_id, text) and writes them; returns the files in order: MANIFEST and `base`, the tokens before each file.

    Texts are put in order before they are encoded: their ids take as much room as they do."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, size = library_encoder(path)
        end = np.uint32(end_id)
        file = new_file(folder, ".tokens")
        files, name = place(file)
        with files.open_output_stream(name) as out:
            writer = Writer(out, width_of(size))
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    ids, ends = encode(part.column("text"))
                    for doc_id, run in zip(part.column("doc_id").to_pylist(), np.split(ids.view("<u4"), ends[:-1]), strict=True):
                        writer.add(doc_id, np.append(run, end))
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [file], "n_tokens": pa.array([writer.tokens], pa.int64()), "n_docs": pa.array([len(writer.starts)], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = written(ordered.mapInArrow(run, MANIFEST), "token-files")
    rows = made.orderBy("part").collect()  # a row for each file
    bases = accumulate((r["n_tokens"] for r in rows), initial=0)
    return spark.createDataFrame([(*r, b) for r, b in zip(rows, bases, strict=False)], MANIFEST + ", base bigint")


def read_documents(files: DataFrame) -> DataFrame:
    """The documents in token files, read from them: DOCUMENTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, name = place(row["path"])
                with where.open_input_file(name) as file:
                    reader = Reader(file)
                    yield from _documents(reader, row["base"])

    return files.repartition(max(1, files.count())).mapInArrow(run, DOCUMENTS)


def _documents(reader: Reader, base: int) -> Iterator[pa.RecordBatch]:
    """Runs of documents of about 64 blocks; a longer document is unpacked in steps of so many."""
    step, stops = 64 * BLOCK, np.append(reader.starts[1:], reader.tokens)
    at = 0
    while at < len(stops):
        upto = max(at + 1, int(np.searchsorted(stops, reader.starts[at] + step, side="right")))
        start, stop = int(reader.starts[at]), int(stops[upto - 1])
        sums = []
        if upto == at + 1:
            crc = 0
            for a in range(start, stop, step):
                crc = zlib.crc32(reader.ids(a, min(a + step, stop)).tobytes(), crc)
            sums.append(crc)
        else:
            ids = reader.ids(start, stop)
            sums = [zlib.crc32(ids[a - start : b - start].tobytes()) for a, b in zip(reader.starts[at:upto].tolist(), stops[at:upto].tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(reader.doc_ids[at:upto], pa.int64(), mask=reader.known[at:upto] == 0),
                "start": pa.array(reader.starts[at:upto] + base),
                "n_tokens": pa.array(stops[at:upto] - reader.starts[at:upto]),
                "ids_crc32": pa.array(sums, pa.int64()),
            }
        )
        at = upto
