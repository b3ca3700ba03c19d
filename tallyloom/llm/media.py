"""Media columns: content-defined chunks, stored once, and payloads rebuilt from them.

A gear hash rolls over each payload (its last 32 bytes decide), a chunk ends
where the hash's masked bits are zero, but never before ``least`` bytes nor
after ``most``.  So equal stretches of different payloads give equal chunks
wherever they lie.  Chunks are told apart by a 128-bit digest; the store keeps
each once, and a manifest lists each payload's chunks in order.  Rebuilding
joins manifest and store by digest, puts the chunks in order and compares the
payload's digest.

A chunk that many payloads have (page frames, zeros) is one row of the store;
its places are split by adaptive execution's skew join, and meet nothing but that
row.

Chunks are small and alike, so they are compressed against a dictionary that
is trained on a bounded sample of payloads, chosen by a hash of the id; it
belongs to the store.  Digests travel without their bytes wherever bytes
aren't needed.

Defined results: a null payload has no manifest and doesn't come back; an
empty one has no chunk and comes back empty.  Very long payloads are cut and
rebuilt whole (a payload is a row, so at most 2 GB).  Rows that repeat an id
are one medium: the payload of least digest counts.  Null ids are left out.  An
empty table gives no row.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, mix

LEAST, MASK_BITS, MOST = 512, 11, 16384
#: Payloads that the compression dictionary may be trained on, and its size.
SAMPLE_PAYLOADS, DICTIONARY_BYTES = 1000, 200_000
LEVEL = 12

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(16)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: h = (h << 1) + gear[byte], in 32 bits, so by doubling of its window."""
    h = _GEAR[data]
    step = 1
    while step < 32:
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint32(step)
        h = shifted
        step *= 2
    return h


def cuts(payload: bytes, least: int = LEAST, mask_bits: int = MASK_BITS, most: int = MOST) -> list[int]:
    """Ends of the payload's chunks."""
    n = len(payload)
    if not n:
        return []
    h = gear(np.frombuffer(payload, dtype=np.uint8))
    # the high bits hold the longest window
    marks = (np.flatnonzero((h >> np.uint32(32 - mask_bits)) == 0) + 1).tolist()
    out, at, k = [], 0, 0
    while n - at > least:
        while k < len(marks) and marks[k] < at + least:
            k += 1
        at = min(marks[k] if k < len(marks) else n, at + most, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def train_dictionary(media: DataFrame, id_col: str = "page_id", payload_col: str = "html", most: int = SAMPLE_PAYLOADS) -> bytes:
    """A compression dictionary from the chunks of ``most`` payloads at most; b"" where they are too few to train one."""
    rows = media.select(media[id_col].alias("id"), media[payload_col].cast("binary").alias("payload")).where("id is not null and payload is not null")
    samples = []
    for r in bounded_sample(rows, "id", most).collect():
        data, at = bytes(r["payload"]), 0
        for end in cuts(data):
            samples.append(data[at:end])
            at = end
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _codec(dictionary: bytes) -> tuple:
    """(compress, decompress), with sizes but without checks: the digests tell."""
    words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_dict_id=False) if words else zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
    return pack.compress, (zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()).decompress


def chunked(media: DataFrame, id_col: str = "page_id", payload_col: str = "html", with_bytes: bool = False, dictionary: bytes = b"") -> DataFrame:
    """(id, seq, digest, size, medium[, chunk]) of each chunk; ``medium`` is the whole payload's digest.  An empty payload has one row of null digest."""
    id_type = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, _ = _codec(dictionary)
        for batch in batches:
            rows: list[tuple] = []
            which: list[int] = []
            held = 0

            def flush() -> pa.RecordBatch:
                columns = list(zip(*rows))
                arrays = [batch.column(0).take(pa.array(which)), *(pa.array(c, type=t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary())))]
                return pa.RecordBatch.from_arrays(arrays[: 5 + with_bytes], names=["id", "seq", "digest", "size", "medium", "chunk"][: 5 + with_bytes])

            for k, payload in enumerate(batch.column(1)):
                data = payload.as_py()
                medium = xxhash.xxh3_128_digest(data)
                at = 0
                for seq, end in enumerate(cuts(data)):
                    chunk = data[at:end]
                    rows.append((seq, xxhash.xxh3_128_digest(chunk), end - at, medium, pack(chunk) if with_bytes else None))
                    which.append(k)
                    at = end
                if not data:
                    rows.append((0, None, 0, medium, None))
                    which.append(k)
                held += len(data)
                if held > 4_000_000:
                    yield flush()
                    rows, which, held = [], [], 0
            if rows:
                yield flush()

    first = media.select(media[id_col].alias("id"), media[payload_col].cast("binary").alias("payload")).where("id is not null and payload is not null")
    schema = f"id {id_type}, seq int, digest binary, size int, medium binary" + ", chunk binary" * with_bytes
    return first.mapInArrow(run, schema)


def store(media: DataFrame, id_col: str = "page_id", payload_col: str = "html", dictionary: bytes = b"") -> DataFrame:
    """(digest, size, chunk): each distinct chunk once, compressed."""
    rows = chunked(media, id_col, payload_col, with_bytes=True, dictionary=dictionary).where("digest is not null")
    return rows.groupBy("digest").agg(F.first("size").alias("size"), F.first("chunk").alias("chunk"))


def manifest(media: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, medium, chunks): each payload's digest and its chunks' in order."""
    rows = chunked(media, id_col, payload_col)
    one = rows.groupBy("id", "medium").agg(F.array_sort(F.collect_set(F.struct("seq", "digest", "size"))).alias("chunks"))
    latest = one.withColumn("__row", F.row_number().over(Window.partitionBy("id").orderBy("medium"))).where("__row = 1").drop("__row")
    return latest.withColumn("chunks", F.filter("chunks", lambda c: c["digest"].isNotNull())).withColumnRenamed("id", id_col)


def rebuild(manifests: DataFrame, chunks: DataFrame, id_col: str = "page_id", dictionary: bytes = b"") -> DataFrame:
    """(id, payload, n_chunks, verified): the payloads again; ``verified`` if all chunks are there and the digest is right."""
    id_type = manifests.schema[id_col].dataType.simpleString()
    # the payload's digest travels with its first chunk alone
    wanted = manifests.select(F.col(id_col).alias("id"), "medium", F.posexplode_outer("chunks").alias("pos", "c")).select("id", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("medium")).alias("medium"), "c.seq", "c.digest")
    # one row a chunk on the right: of a chunk in very many places adaptive execution splits the left side
    found = wanted.join(chunks.select("digest", "chunk"), "digest", "left").select("id", "medium", "seq", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpack = _codec(dictionary)
        key = medium = kind = None
        parts: list[bytes | None] = []
        done: list[tuple] = []

        def close() -> None:
            whole = b"".join(p for p in parts if p is not None)
            done.append((key, whole, len(parts), None not in parts and xxhash.xxh3_128_digest(whole) == medium))

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done), (kind, pa.binary(), pa.int32(), pa.bool_()))], names=["id", "payload", "n_chunks", "verified"])

        for batch in batches:
            kind = batch.column(0).type
            for own, digest, seq, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    if key is not None:
                        close()
                    key, medium, parts = own, digest, []
                    if sum(len(d[1]) for d in done[-64:]) > 4_000_000 or len(done) >= 2000:
                        yield flush()
                        done = []
                if seq is not None:
                    parts.append(None if chunk is None else unpack(chunk))
        if key is not None:
            close()
        if done:
            yield flush()

    ordered = found.repartition("id").sortWithinPartitions("id", "seq")
    return ordered.mapInArrow(run, f"id {id_type}, payload binary, n_chunks int, verified boolean").withColumnRenamed("id", id_col)
