"""Token ids in binary blocks, with document boundaries in Elias-Fano code.

A block is a concatenation of documents' ids (two bytes an id where the
vocabulary allows, else four) and the offsets at which documents end.  The n
offsets up to u split into floor(log2(u / n)) low bits, packed, and the high
parts in unary: about 2 + log2(u / n) bits a document, against 64 in a table.

Select structures are stored with the block: the place of every 256th one, in
32 bits; where 256 ones lie further apart than ``_SPAN`` bits (documents of
very unequal length), all their places, which takes no more bits than the
stretch itself.  So any offset is read from a stretch of bounded length, and
nothing is built when a block is opened.

Blocks are cut as partitions are read, so nothing is shuffled and a repeated
task makes the same block.

Defined results: a null text has no document in any block; an empty text is a
document of no ids; repeated rows are documents of their own; null ids are
kept as null.  Texts of any length are encoded whole: those from ``LONG``
characters by merge rounds, as the library's splitter has a stack that long
runs of blanks exhaust; the ids are the same.  Empty partitions make no block.
Only the id and the text column are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import DEFAULT_VOCAB, SPLIT, part_cache

#: Ids, or documents, of a block, which ends with the document that reaches them.
BLOCK_IDS = 2_000_000
#: Characters from which a text is encoded by merge rounds.
LONG = 200_000
_EVERY = 256
_SPAN = _EVERY * 32


class EliasFano:
    """A non-decreasing sequence of non-negative integers, with direct access.

    ``select`` has the place of every 256th one of the high part, ``sparse`` the
    numbers of the groups of 256 that are longer than ``_SPAN`` bits, and behind
    them the places of their ones; all are read where they lie.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, select: bytes, sparse: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, dtype=np.uint8), np.frombuffer(high, dtype=np.uint8)
        self.select, self.sparse = np.frombuffer(select, dtype="<u4"), np.frombuffer(sparse, dtype="<u4")
        self.n_sparse = -(-len(self.sparse) // (_EVERY + 1))

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if n and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("the sequence must not decrease")
        u = int(values[-1]) if n else 0
        low_bits = max(0, (u // n).bit_length() - 1) if n else 0
        low = values & ((1 << low_bits) - 1)
        bits = (low[:, None] >> np.arange(low_bits)) & 1
        unary = np.zeros((u >> low_bits) + n + 1, dtype=np.uint8)
        ones = (values >> low_bits) + np.arange(n)
        unary[ones] = 1
        first = ones[::_EVERY]
        span = np.append(first[1:], len(unary)) - first
        wide = np.flatnonzero(span > _SPAN)
        far = [np.append(own, np.zeros(_EVERY - len(own), dtype=np.int64)) for own in (ones[g * _EVERY : (g + 1) * _EVERY] for g in wide)]
        sparse = np.concatenate([wide, *far]).astype("<u4")
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes(), first.astype("<u4").tobytes(), sparse.tobytes())

    def __len__(self) -> int:
        return self.n

    def place(self, k: int) -> int:
        """The place of the k-th one in the high part."""
        group, left = divmod(k, _EVERY)
        begin = int(self.select[group])
        if not left:
            return begin
        end = int(self.select[group + 1]) if group + 1 < len(self.select) else 8 * len(self.high)
        if end - begin > _SPAN and self.n_sparse:
            at = int(np.searchsorted(self.sparse[: self.n_sparse], group))
            if at < self.n_sparse and self.sparse[at] == group:
                return int(self.sparse[self.n_sparse + at * _EVERY + left])
        byte = begin // 8
        bits = np.unpackbits(self.high[byte : -(-end // 8)], bitorder="little")
        return 8 * byte + int(np.flatnonzero(bits[begin % 8 :])[left]) + begin % 8

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        high, low, at = self.place(k) - k, 0, k * self.low_bits
        if self.low_bits:
            first, last = at // 8, (at + self.low_bits - 1) // 8
            low = int.from_bytes(self.low[first : last + 1].tobytes(), "little") >> (at % 8) & ((1 << self.low_bits) - 1)
        return high << self.low_bits | low

    def all(self) -> np.ndarray:
        """The whole sequence at once."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = places - np.arange(self.n)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high << self.low_bits | bits.astype(np.int64) @ (1 << np.arange(self.low_bits))

    @property
    def n_bytes(self) -> int:
        """Bytes of the code with its select structures."""
        return self.low.nbytes + self.high.nbytes + self.select.nbytes + self.sparse.nbytes

    def parts(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.low.tobytes(), self.high.tobytes(), self.select.tobytes(), self.sparse.tobytes()


_ENDS = ("ends_low", "ends_high", "ends_select", "ends_sparse")
_ENCODERS: dict = {}
#: Documents whose ids are given at once.
_DECODED = 500


def encoder(vocab: str):
    """This process's encoder for a rank file."""
    if vocab not in _ENCODERS:
        import tiktoken

        with open(vocab, "rb") as lines:
            ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in lines if line.strip())}
        _ENCODERS[vocab] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocab]


def write_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(block, doc_ids, n_tokens, id_bytes, ids, low_bits, ends_low, ends_high, ends_select, ends_sparse): one row a block."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab)
        width = np.uint16 if encode.max_token_value < 1 << 16 else np.uint32
        part, number = TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        parts: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
            code = EliasFano.encode(ends)
            doc_ids = pa.concat_arrays(keys)
            row = [pa.array([f"{part:06d}-{number:06d}"]), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], type=pa.int32()), doc_ids), pa.array([int(ends[-1])]), pa.array([width().itemsize], type=pa.int32()), pa.array([np.concatenate(parts).tobytes()], type=pa.binary()), pa.array([code.low_bits], type=pa.int32()), *(pa.array([x], type=pa.binary()) for x in code.parts())]
            return pa.RecordBatch.from_arrays(row, names=["block", "doc_ids", "n_tokens", "id_bytes", "ids", "low_bits", *_ENDS])

        for batch in batches:
            begin = 0
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                # a text's surrogates can't be encoded; Spark's strings have none
                ids = (encode.encode_to_numpy(text, disallowed_special=()) if len(text) < LONG else part_cache(vocab).encode([text])[0]).astype(width)
                parts.append(ids)
                held += len(ids)
                if held >= block_ids or len(parts) >= block_ids:
                    keys.append(batch.column(0).slice(begin, k + 1 - begin))
                    yield block()
                    keys, parts, held, begin, number = [], [], 0, k + 1, number + 1
            if begin < batch.num_rows:
                keys.append(batch.column(0).slice(begin))
        if parts:
            yield block()

    schema = f"block string, doc_ids array<{id_type}>, n_tokens bigint, id_bytes int, ids binary, low_bits int, ends_low binary, ends_high binary, ends_select binary, ends_sparse binary"
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("text is not null").mapInArrow(run, schema)


def boundaries(row: dict) -> EliasFano:
    """The offsets at which a block's documents end, as stored."""
    return EliasFano(len(row["doc_ids"]), row["low_bits"], *(row[c] for c in _ENDS))


def read_documents(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, token_ids) of every document in the blocks."""
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a block at a time: a batch may have all of a task's blocks
                own = batch.slice(k, 1)
                row = {"doc_ids": own.column("doc_ids")[0].values, "low_bits": own.column("low_bits")[0].as_py()} | {c: own.column(c)[0].as_py() for c in _ENDS}
                ids = np.frombuffer(own.column("ids")[0].as_buffer(), dtype=np.uint16 if own.column("id_bytes")[0].as_py() == 2 else np.uint32)
                bounds = np.concatenate([[0], boundaries(row).all()])
                for at in range(0, len(bounds) - 1, _DECODED):
                    some = bounds[at : at + _DECODED + 1]
                    yield pa.RecordBatch.from_arrays([row["doc_ids"].slice(at, len(some) - 1), pa.ListArray.from_arrays((some - some[0]).astype(np.int32), ids[some[0] : some[-1]].astype(np.int32))], names=["id", "token_ids"])

    given = blocks.select("doc_ids", "id_bytes", "ids", "low_bits", *_ENDS)
    return given.mapInArrow(run, f"id {id_type}, token_ids array<int>").withColumnRenamed("id", id_col)


def document(row: dict, k: int) -> np.ndarray:
    """Ids of the k-th document of a block, by two selects."""
    ends = boundaries(row)
    ids = np.frombuffer(row["ids"], dtype=np.uint16 if row["id_bytes"] == 2 else np.uint32)
    return ids[ends[k - 1] if k else 0 : ends[k]]
