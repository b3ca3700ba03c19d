"""Near duplicates by a containment ensemble of MinHash bandings.

Documents are partitioned by the size of their shingle set (a partition's
upper bound is ``ratio`` times its lower bound).  A containment threshold t
becomes, for a query of size q and a partition of sizes up to u, the Jaccard
threshold t / (u/q + 1 - t); each pair of partitions has its own banding, tuned
to the threshold that its sizes give.  A document is a query against its own
partition, the next one, and all larger ones.

Own and next partition: bands of several rows.  Within a bucket the documents
are not paired all with all: the one most like the bucket's majority leads (of
copies of one text, mostly that text), those whose signatures say that they
belong to it leave with it, the rest are led anew.  This happens where the bands
are made and again where a bucket meets, so that a hot bucket is small before
it moves, and copies by the thousand give as many candidates, not their square.
Candidates are checked by the exact containment of their shingle sets.  Who left
with a leader that the check then refuses goes back to the bucket and is held
against all who are there.  Who left rightly is held against those of the bucket
that are not in its class by then, so no link between classes goes with a leader.

All larger partitions: the Jaccard threshold sinks below what bands can tell,
so a band has one row there, and the query's least hashes are looked up among
all the target's, which a set contained to t answers with probability t each,
however large the target.  Queries of up to ``whole`` shingles look up all of
theirs, which makes the search exact, larger ones ``sample`` of them.  Only
queries that find enough of their hashes in larger sets go on: those that looked
up a sample look up all of theirs in the targets that hold enough of it, so that
all are answered by the number found.  Pairs of parts and containers are not
made where many parts found the same frequent hashes: these share an ask.

Meaning: pairs of sizes within ``ratio`` are copies; classes are their connected
components, of which the least id stays.  A set contained in one beyond ``ratio``
is a part: the class whose least document is a part goes with the class of the
container, if that class has the larger largest document, but joins no two
containers (a line that many texts have would join them all); of several such
classes the one of least id.  All of a part's containers that are found are
links, of equal ones one.

Documents with equal shingle sets are grouped before the search, so only one
of each such set takes part.

Defined results: documents without a word (null, empty, blank) and rows of
null id are in no group.  Documents of fewer than ``k`` words have one
shingle, all their words.  Rows that repeat an id are one document, near to
whatever one of its texts is near to.  Very long texts are read whole; they
make larger sets and no more bands.  Empty tables give no row.  Only the named
columns are read; ``keep_one`` passes all others on, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import text_slices
from .common import WordHashes, cut, fresh, mix, shingles, small_batches, tidy

#: Bytes up to which the filter of looked-up hashes is sent to the executors; beyond, hashes are shuffled unfiltered.
FILTER_BYTES = 256_000_000
#: Ids of candidates, or keys, up to which they are sent to where the texts or rows are (with their cells up to a quarter); beyond, these are shuffled to them.
BROADCAST_IDS = 2_000_000
#: Edges up to which one task tells their components; beyond, these are found by rounds of shuffles.
ONE_TASK_EDGES = 1_000_000
#: Shingles that a worker keeps of either side of a cell of pairs.
_HELD = 2_000_000
#: Targets up to which a hash that a query found isn't hot, nor one that this many times fewer have than the query's most frequent one.
_FEW, _LESS = 50, 16
#: Bits a hash of that filter, two of which are set.
_BITS = 10
_LOW32 = (1 << 32) - 1


@dataclass(frozen=True)
class Params:
    """``t`` containment of the smaller set in the larger; ``ratio`` of sizes of copies; ``recall`` of a pair at the very threshold; ``k`` words a shingle; ``perms`` minima a signature; ``whole`` and ``sample``: see above."""

    t: float = 0.7
    ratio: float = 1.5
    recall: float = 0.92
    k: int = 3
    perms: int = 64
    whole: int = 64
    sample: int = 16

    def partition(self, size: int) -> int:
        return int(math.log(size) / math.log(self.ratio) + 1e-9)

    def bounds(self, partition: int) -> tuple[int, int]:
        """Least and largest size of a partition."""
        low = math.ceil(self.ratio**partition - 1e-6)
        return low, max(low, math.ceil(self.ratio ** (partition + 1) - 1e-6) - 1)

    def jaccard(self, query: int, target: int) -> float:
        """The Jaccard threshold of a query partition against a target partition."""
        (low, _), (_, high) = self.bounds(query), self.bounds(target)
        return self.t / (min(high / low, self.ratio) + 1 - self.t)

    def banding(self, query: int, target: int) -> tuple[int, int]:
        """(bands, rows) of a pair of partitions: the most rows whose bands reach the recall with at most half of the permutations."""
        j = self.jaccard(query, target)
        for rows in range(6, 0, -1):
            bands = math.ceil(math.log(1 - self.recall) / math.log(1 - j**rows)) if j < 1 else 1
            if bands * rows <= self.perms // 2:
                return bands, rows
        return self.perms, 1

    def least(self, size: int) -> int:
        """How many of its least hashes a set looks up in larger ones."""
        return size if size <= self.whole else self.sample

    def found(self) -> int:
        """How many of a sample are found, but for one contained set in a hundred."""
        n, t = self.sample, self.t
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n, m) * t**m * (1 - t) ** (n - m)
            if below > 0.01:
                return m
        return n

    def needed(self, size: Column) -> Column:
        """Hashes that a set must find in larger ones to be a part of one."""
        return F.when(size <= self.whole, F.ceil(size * self.t - 1e-9)).otherwise(self.found())


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def sketch(unique: np.ndarray, params: Params, seeds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Band keys of a shingle set, and a signature of two bits a permutation, 32 a word."""
    keys, sig = _sketch_all([unique], params, seeds)
    return [keys[0]], sig[0]


def _sketch_all(sets: list[np.ndarray], params: Params, seeds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The same of many sets: the keys of each, and a row of signature of each."""
    mins = np.empty((len(sets), len(seeds)), dtype=np.uint64)
    for k, unique in enumerate(sets):
        for i in range(0, len(seeds), 16):
            (seeds[i : i + 16, None] * unique[None, :]).min(axis=1, out=mins[k, i : i + 16])
    mins = mix(mins)
    partitions = np.array([params.partition(len(x)) for x in sets])
    keys: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(sets)
    for p in np.unique(partitions).tolist():
        at = np.flatnonzero(partitions == p)
        own = []
        for query, target in ((p, p), (p, p + 1), (p - 1, p)):
            if query >= 0:
                bands, rows = params.banding(query, target)
                key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + np.uint64((query << 20 | target << 8) + 1)), (len(at), bands))
                for r in range(rows):
                    key = mix(key + mins[at, r : bands * rows : rows])
                own.append(key)
        for k, row in zip(at.tolist(), np.concatenate(own, axis=1)):
            keys[k] = row
    bits = (mins & np.uint64(3)) << (np.arange(mins.shape[1], dtype=np.uint64) % np.uint64(32) * np.uint64(2))
    return keys, np.bitwise_or.reduceat(bits, np.arange(0, mins.shape[1], 32), axis=1)


def agreement(a: np.ndarray, b: np.ndarray, perms: int) -> np.ndarray:
    """Estimated Jaccard similarity of signatures (n, words) with one (words,) or as many."""
    d = a ^ b
    d = (d | d >> np.uint64(1)) & np.uint64(0x5555555555555555)
    share = 1 - np.bitwise_count(d).sum(axis=1) / perms
    return (share - 0.25) / 0.75


def _shingle_sets(words: WordHashes, texts: list[str], params: Params) -> list[np.ndarray]:
    """The shingle set of each text, sorted."""
    split = [t.split() for t in texts]
    flat = words.of([w for ws in split for w in ws])
    owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])[flat != 0]
    flat = flat[flat != 0]
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    runs = shingles(flat, params.k) if len(flat) >= params.k else flat[:0]
    out, begin = [], 0
    for end in ends.tolist():
        if end - begin < params.k:
            out.append(shingles(flat[begin:end], params.k))
        else:
            own = np.sort(runs[begin : end - params.k + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        begin = end
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("id is not null and text is not null")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """A column of lists of 64-bit integers."""
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(bounds, np.concatenate(rows).view(np.int64))


def sketches(docs: DataFrame, id_col: str, text_col: str, params: Params) -> DataFrame:
    """(id, content, keys, sig, size, least): the shingle set's digest, band keys, signature, size and least hashes of each document that has a word."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seeds = WordHashes(), _seeds(params.perms)
        for batch in batches:
            for first, texts in text_slices(x.as_py() for x in batch.column(1)):
                sets = _shingle_sets(words, texts, params)
                rows = [first + k for k, x in enumerate(sets) if len(x)]
                sets = [x for x in sets if len(x)]
                if rows:
                    keys, sigs = _sketch_all(sets, params, seeds)
                    content = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                    least = [x[: params.least(len(x))] for x in sets]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(content, type=pa.binary()), _lists(keys), _lists(list(sigs)), pa.array([len(x) for x in sets], type=pa.int32()), _lists(least)], names=["id", "content", "keys", "sig", "size", "least"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, content binary, keys array<bigint>, sig array<bigint>, size int, least array<bigint>")


def _over(sig: np.ndarray, size: np.ndarray, rows: np.ndarray, one: int, params: Params) -> np.ndarray:
    """By how much the estimated similarity of rows with one exceeds what copies of their sizes have at least."""
    small, large = np.minimum(size[rows], size[one]), np.maximum(size[rows], size[one])
    need = np.where(large <= params.ratio * small, params.t / (large / small + 1 - params.t), 2.0)
    return agreement(sig[rows], sig[one], params.perms) - need


def _lead(sig: np.ndarray, size: np.ndarray, params: Params, margin: float) -> tuple[list[tuple[np.ndarray, int, np.ndarray]], np.ndarray]:
    """One bucket: ((members, leader, which of them leave with it) of each leader that has any, and the rows that no leader took).

    The next leader is always the row most like the majority of the rows that
    were left when they last halved; votes that tie go with the first row.
    """
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    out, stay = [], []
    rest = np.arange(len(sig))
    while len(rest) > 1:
        fields = ((sig[rest][:, :, None] >> shifts) & np.uint64(3)).astype(np.uint8).reshape(len(rest), -1)[:, : params.perms]
        votes = np.stack([(fields == v).sum(axis=0) for v in range(4)]) * 2
        votes[fields[0], np.arange(params.perms)] += 1
        rest = rest[np.argsort(-(fields == votes.argmax(axis=0)).sum(axis=1), kind="stable")]
        half = len(rest) // 2
        while len(rest) > max(half, 1):
            leader, rest = rest[0], rest[1:]
            stay.append(leader)
            over = _over(sig, size, rest, leader, params)
            near = over >= -margin
            if near.any():
                out.append((rest[near], leader, over[near] >= 0))
                rest = rest[over < 0]
    return out, np.concatenate([np.array(stay, dtype=np.int64), rest])


def _again(sig: np.ndarray, size: np.ndarray, strays: np.ndarray, gone: np.ndarray, root: np.ndarray, params: Params, margin: float) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """A bucket to which those that left came back: who may be a copy of whom, and none leaves.

    All of them are held against the rows of other classes (``root``), and
    ``strays`` against those of their own that aren't ``gone`` with a leader.
    """
    out = []
    left, other = strays | gone, np.ones(len(sig), dtype=bool)
    # one of each pair of two classes is not in the largest class, and one has left
    apart = strays | (root != np.bincount(root).argmax())
    for one in np.flatnonzero(left if left.sum() <= apart.sum() else apart):
        other[one] = False
        rows = np.flatnonzero(other if left[one] else other & left)
        own = ~gone[rows] & (strays[rows] | strays[one]) & (not gone[one])
        rows = rows[(root[rows] != root[one]) | own]
        near = rows[_over(sig, size, rows, one, params) >= -margin]
        if len(near):
            out.append((near, one, np.zeros(len(near), dtype=bool)))
    return out


def led_pairs(bands: DataFrame, params: Params, id_type: str, again: bool = False, final: bool = False) -> DataFrame:
    """``bands`` is (key, id, sig, size, other, leaves), sorted by (key, id) within partitions.  Rows of ``other`` are pairs and pass; of the others those that no leader takes pass as well (with ``final`` only from buckets that any has left), and pairs of leaders and members come in.  With ``again`` rows that leave are those that came back in vain, and ``gone`` and ``root`` tell the others that had left and the classes."""
    # three deviations of the estimate for sets at the threshold
    margin = 3 * math.sqrt(0.22 / params.perms) / 0.75
    names = ["key", "id", "sig", "size", "other", "leaves"]

    def plain(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in rows.select(names).combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def buckets(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            done = rows.column("other").is_valid().to_numpy()
            before = rows.column("key").to_numpy()[done & rows.column("leaves").fill_null(False).to_numpy()]
            if done.any():
                yield from plain(rows.filter(pa.array(done)))
                rows = rows.filter(pa.array(~done))
            if not rows.num_rows:
                return
            rows = rows.combine_chunks()
            keys, size, ids = rows.column("key").to_numpy(), rows.column("size").to_numpy(), rows.column("id").combine_chunks()
            flat = rows.column("sig").combine_chunks()
            sig = flat.flatten().to_numpy().view(np.uint64).reshape(len(flat), -1)
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            count = np.diff(np.append(start, len(keys)))
            a, b, leaves, alone = [], [], [], [start[count == 1]]
            if again:
                strays, gone = (rows.column(x).to_numpy() for x in ("leaves", "gone"))
                root = rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
            for s, n in zip(start[count > 1], count[count > 1]):
                if again:
                    kinds = np.unique(root[s : s + n], return_inverse=True)[1]
                    found, stay = _again(sig[s : s + n], size[s : s + n], strays[s : s + n], gone[s : s + n], kinds, params, margin), np.zeros(0, dtype=np.int64)
                else:
                    found, stay = _lead(sig[s : s + n], size[s : s + n], params, margin)
                for members, leader, left in found:
                    a.append(members + s)
                    b.append(np.full(len(members), leader + s))
                    leaves.append(left)
                alone.append(stay + s)
            stay = np.sort(np.concatenate(alone))
            a, b, leaves = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b, leaves))
            if final:
                stay = stay[np.isin(keys[stay], np.concatenate([before, keys[a[leaves.astype(bool)]]]))]
            yield from plain(rows.take(pa.array(stay)))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a]), ids.take(pa.array(a)), pa.nulls(len(a), flat.type), pa.nulls(len(a), pa.int32()), ids.take(pa.array(b)), pa.array(leaves)], names=names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
            if last:
                yield from buckets(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif held and held[0].column(0)[held[0].num_rows - 1].as_py() != keys[0]:
                yield from buckets(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from buckets(pa.Table.from_batches(held))

    return bands.mapInArrow(run, f"key bigint, id {id_type}, sig array<bigint>, size int, other {id_type}, leaves boolean")


def _cells(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(cell, i, j, a, b): the pairs, those of texts that share partners mostly in one cell, of at most about ``_HELD`` shingles a side.

    A text's label is the least id at most two steps from it, a pair's cell the
    lesser of its two labels.  A larger cell is a square of smaller ones.
    """
    ends = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    near = ends.groupBy("a").agg(F.least("a", F.min("b")).alias("cell"))
    near = cut(ends.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("cell").alias("cell")))
    at = pairs.join(near, "a").join(near.select(F.col("a").alias("b"), F.col("cell").alias("other")), "b").select(F.least("cell", "other").alias("cell"), "a", "b")
    at = cut(at)
    sizes = reps.groupBy("id").agg(F.sum(F.col("size").cast("long")).alias("size"))
    weights = at.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct().join(sizes, "id", "left").groupBy("cell").agg(F.sum(F.coalesce("size", F.lit(1))).alias("weight"))
    wide = cut(weights.select("cell", F.ceil(F.col("weight") / _HELD).alias("side")).where("side > 1"))
    side = F.coalesce("side", F.lit(1))
    return at.join(wide, "cell", "left").select("cell", F.pmod(F.xxhash64("a"), side).alias("i"), F.pmod(F.xxhash64("b"), side).alias("j"), "a", "b")


def verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, params: Params, parts: bool = False) -> DataFrame:
    """(a, b, containment) of the pairs whose smaller shingle set is contained in the other to ``t`` at least, counted exactly: of sizes within the ratio, or with ``parts`` of those where a's set is smaller than that.

    Only texts that a pair has move, and once to each cell of pairs.  ``reps``
    tells their sizes.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    pairs = cut(_cells(cut(pairs.select("a", "b").distinct()), reps))
    members = cut(pairs.select("cell", "i", "j", F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = _texts(docs, id_col, text_col)
    if members.count() <= BROADCAST_IDS // 4:
        held = texts.join(F.broadcast(members), "id")
    else:
        ids = cut(members.select("id").distinct())
        held = members.join(texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi"), "id")
    held = held.select("cell", "i", "j", F.col("id").alias("a"), F.lit(None).cast(id_type).alias("b"), "text")
    rows = held.unionByName(pairs.withColumn("text", F.lit(None).cast("string"))).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, key = WordHashes(), None
        sets: dict = {}  # of the cell; rows that repeat an id are several
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            a, b = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            firsts = [k for k in range(len(a)) if not k or places[k] != places[k - 1] or b[k] != b[k - 1]]
            hits, found = [], []
            for k, end in zip(firsts, [*firsts[1:], len(a)]):
                if places[k] != key:
                    key, sets = places[k], {}
                if b[k] is None:
                    texts = batch.column(5).slice(k, end - k)
                    for first, some in text_slices(x.as_py() for x in texts):
                        for i, own in enumerate(_shingle_sets(words, some, params)):
                            sets.setdefault(a[k + first + i], []).append(own)
                    continue
                shares = np.zeros(end - k)
                own = [(n, x) for n, i in enumerate(a[k:end]) for x in sets[i]]
                for other in sets[b[k]]:
                    np.maximum.at(shares, [n for n, _ in own], _contained([x for _, x in own], other, params, parts))
                good = np.flatnonzero(shares >= params.t)
                hits.append(good + k)
                found.append(shares[good])
            if hits:
                at = pa.array(np.concatenate(hits), type=pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(3).take(at), batch.column(4).take(at), pa.array(np.concatenate(found), type=pa.float64())], names=["a", "b", "containment"])

    with small_batches(docs.sparkSession, 500):
        return cut(rows.mapInArrow(run, f"a {id_type}, b {id_type}, containment double"))


def _contained(own: list[np.ndarray], other: np.ndarray, params: Params, parts: bool) -> np.ndarray:
    """Which share of the smaller set the larger has, for each of ``own`` with the other; 0 if their sizes are not asked for, or one is empty."""
    out = np.zeros(len(own))
    sizes = np.array([len(x) for x in own])
    small, large = np.minimum(sizes, len(other)), np.maximum(sizes, len(other))
    asked = (small > 0) & ((large > params.ratio * small) == parts)
    if parts:
        asked &= sizes < len(other)
    which = np.flatnonzero(asked)
    if len(which):
        flat = np.concatenate([own[k] for k in which])
        at = np.searchsorted(other, flat)
        at[at == len(other)] = 0
        both = np.add.reduceat(other[at] == flat, np.cumsum(sizes[which]) - sizes[which], dtype=np.int64)
        out[which] = both / small[which]
    return out


def _among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is among ``keys``, without moving the others if the keys are few enough to be sent."""
    keys = cut(keys.distinct())
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, "key", "left_semi")


def _among_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids``, in the same way."""
    ids = cut(ids.distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _possible(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, ids: DataFrame, params: Params, ends: tuple[str, str]) -> DataFrame:
    """The pairs of ``ids``, in the columns ``ends``, without those that can't be copies: the smaller set of copies has a share ``t`` of its hashes in the sets of other ids of these."""
    every = cut(_hits(_of(docs, id_col, ids.select(F.col(ids.columns[0]).alias("id"))), id_col, text_col, params, None, 0))
    met = every.groupBy("key").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low <> high").select("key", F.lit(1).alias("met"))
    sets = every.join(met, "key", "left").groupBy("b", "size_b").agg(F.count("met").alias("n"))
    dense = F.max(F.col("n") >= F.ceil(F.col("size_b") * params.t - 1e-9))
    sets = cut(sets.groupBy("b").agg(F.min("size_b").alias("low"), F.max("size_b").alias("high"), dense.alias("dense")))
    sets = F.broadcast(sets) if sets.count() <= BROADCAST_IDS else sets
    for k, end in enumerate(ends):
        pairs = pairs.join(sets.select(F.col("b").alias(end), F.struct("low", "high", "dense").alias(f"set_{k}")), end)
    return pairs.where("(set_0.dense or set_1.dense) and (set_0.dense or set_0.high > set_1.low) and (set_1.dense or set_1.high > set_0.low)").drop("set_0", "set_1")


def copies(reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, params: Params) -> DataFrame:
    """(a, b) of the verified pairs of sizes within the ratio, b the lesser id."""
    id_type = docs.schema[id_col].dataType.simpleString()
    bands = reps.select(F.explode("keys").alias("key"), "id", "sig", "size", F.lit(None).cast(id_type).alias("other"), F.lit(None).cast("boolean").alias("leaves"))
    # led where they are made, so that of a hot bucket little is left to meet
    combined = led_pairs(bands.sortWithinPartitions("key", "id"), params, id_type)
    rows = cut(led_pairs(combined.repartition("key").sortWithinPartitions("key", "id"), params, id_type, final=True).select("key", "id", "other", "leaves"))
    led = rows.where("other is not null and id <> other")
    both = lambda rows: rows.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b"))
    near = cut(verify(both(led), docs, reps, id_col, text_col, params).select("a", "b").distinct())
    tidy(docs.sparkSession)
    # who left with a leader that it isn't a copy of goes back, and is held against all that no leader took
    went = led.where("leaves").withColumns({"a": F.greatest("id", "other"), "b": F.least("id", "other")})
    back = cut(went.join(near, ["a", "b"], "left_anti").select("key", "id").distinct().withColumn("back", F.lit(True)))
    # and who left rightly against those that its class doesn't have by now; buckets of one class are left out
    roots = components(near)
    members = rows.where("leaves or other is null").groupBy("key", "id").agg(F.max(F.coalesce("leaves", F.lit(False))).alias("left"))
    members = members.join(F.broadcast(roots) if roots.count() <= BROADCAST_IDS else roots, F.col("id") == F.col("node"), "left").select("key", "id", "left", F.coalesce("root", "id").alias("root"))
    members = cut(members.join(back, ["key", "id"], "left").select("key", "id", "left", "root", F.coalesce("back", F.lit(False)).alias("leaves")))
    open_ = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("leaves").alias("any"), F.max("left").alias("left")).where("any or (left and low <> high)")
    members = cut(_among(members, open_.select("key")))
    if members.isEmpty():
        return near
    own = reps.select("id", "sig", "size")
    waiting = members.join(_among_ids(own, members.select("id")), "id")
    waiting = waiting.select("key", "id", "sig", "size", F.lit(None).cast(id_type).alias("other"), "leaves", F.expr("left and not leaves").alias("gone"), "root")
    more = led_pairs(waiting.repartition("key").sortWithinPartitions("key", "id"), params, id_type, again=True).where("other is not null and id <> other").select("id", "other")
    more = both(_possible(more, docs, id_col, text_col, members.select("id"), params, ("id", "other"))).distinct().join(both(led), ["a", "b"], "left_anti")
    tidy(docs.sparkSession)
    return near.unionByName(verify(more, docs, reps, id_col, text_col, params).select("a", "b").distinct())


def _hits(docs: DataFrame, id_col: str, text_col: str, params: Params, bits: np.ndarray | None, slots: int) -> DataFrame:
    """(key, b, size_b): the hashes of each document that the filter lets pass; all of them without one."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = WordHashes(), sent.value
        for batch in batches:
            for first, texts in text_slices(x.as_py() for x in batch.column(1)):
                sets = _shingle_sets(words, texts, params)
                sizes = np.array([len(s) for s in sets])
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                if known is not None:
                    for shift in (0, 24):
                        at = ((flat >> np.uint64(shift)) & np.uint64(_LOW32)) % np.uint64(slots)
                        there = (known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
                        flat, owner = flat[there], owner[there]
                for k in range(0, len(flat), 100_000):
                    part = owner[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(flat[k : k + 100_000].view(np.int64)), batch.column(0).take(pa.array(part + first)), pa.array(sizes[part].astype(np.int32))], names=["key", "b", "size_b"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"key bigint, b {id_type}, size_b int")


def _looked_up(asked: DataFrame, docs: DataFrame, id_col: str, text_col: str, params: Params, needed: Column) -> tuple[DataFrame, DataFrame]:
    """(key, a, size, hits) of the queries that find as many of their hashes as ``needed`` in larger sets of ``docs``, and (key, b, size_b) of these; ``asked`` is (key, a, size)."""
    n = asked.count()
    slots = -(-max(1, n * _BITS) // 32768) * 32768
    bits = None
    if slots // 8 <= FILTER_BYTES:
        low = lambda shift: F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(_LOW32)) % slots + 1
        places = asked.select(F.explode(F.array(low(0), low(24))).alias("place"))
        bits = np.zeros(slots // 8, dtype=np.uint8)
        for number, block in places.groupBy(F.bitmap_bucket_number("place")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place"))).collect():
            bits[(number - 1) * 4096 : number * 4096] = np.frombuffer(bytes(block), dtype=np.uint8)
    larger = F.col("size_b") > params.ratio * F.col("size")
    hits = _hits(docs, id_col, text_col, params, bits, slots)
    hits = cut(hits.join(asked.groupBy("key").agg(F.min("size").alias("size")), "key").where(larger).select("key", "b", "size_b"))
    found = asked.join(hits.groupBy("key").agg(F.max("size_b").alias("size_b")), "key").where(larger).select("key", "a", "size").distinct()
    enough = F.count("*").over(Window.partitionBy("a", "size")).alias("hits")
    return cut(found.select("key", "a", "size", enough).where(F.col("hits") >= needed)), hits


def _of(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The documents of these ids, (id)."""
    ids = cut(ids.distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, docs[id_col] == ids["id"], "left_semi")


def _answered(found: DataFrame, hits: DataFrame, reps: DataFrame, several: DataFrame, params: Params, need: Column) -> tuple[DataFrame, DataFrame]:
    """(ask, size, alone, a) and (ask, size, alone, b): each a of an ask, of this size, finds ``need`` of its hashes in each of its b, and in no others; ``alone`` are ids of ``several``."""
    # queries of one size that found the same hashes are one
    asks = found.groupBy("a", "size").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    asks = asks.join(several.select(F.col("id").alias("a"), F.lit(True).alias("alone")), "a", "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    asks = cut(asks.groupBy("keys", "size", "alone").agg(F.min("a").alias("ask"), F.collect_list("a").alias("of")))
    larger = F.col("size_b") > params.ratio * F.col("size")
    # targets that hold the same of these hashes answer alike, so each kind of them is asked once
    own = _among(hits, found.select("key")).groupBy("b", "size_b").agg(F.sort_array(F.collect_set("key")).alias("keys")).withColumn("kind", F.xxhash64("keys"))
    own = cut(own.join(reps.select(F.col("id").alias("b")).distinct(), "b", "left_semi"))  # of equal sets one
    members = own.select("kind", "b", "size_b")
    kinds = cut(own.groupBy("kind").agg(F.first("keys").alias("keys"), F.max("size_b").alias("size_b"), F.count("*").alias("n")))
    by_key = kinds.select("kind", "size_b", "n", F.explode("keys").alias("key"))
    n = cut(by_key.groupBy("key").agg(F.sum("n").alias("n")))
    by_key = by_key.drop("n")
    rank = Window.partitionBy("ask", "size", "alone").orderBy("n", "key")
    hot = (F.col("n") > _FEW) & (F.col("n") * _LESS > F.max("n").over(Window.partitionBy("ask", "size", "alone")))
    which = ["ask", "size", "alone"]
    ranked = asks.select(*which, F.explode("keys").alias("key"), F.size("keys").alias("hits")).join(n, "key").withColumns({"place": F.row_number().over(rank), "hot": hot})
    ranked = cut(ranked)
    # a kind that holds enough of the hot hashes answers all queries that have these; any other holds a hash that isn't hot
    core = ranked.where("hot").groupBy(*which).agg(F.sort_array(F.collect_set("key")).alias("core")).where(F.size("core") >= need)
    each = cut(asks.join(core, which, "left"))
    shared = each.where("core is not null").groupBy(F.col("core").alias("keys"), "size", "alone").agg(F.min("ask").alias("ask"), F.flatten(F.collect_list("of")).alias("of"))
    shared = cut(shared.withColumn("core", F.lit(None).cast("array<bigint>")))
    among = shared.select(*which, F.explode("keys").alias("key"), F.size("keys").alias("hits")).join(n, "key").withColumn("place", F.row_number().over(rank))
    by, to = [], []
    for number, asks, rare in ((0, each, ranked.where("not hot")), (1, shared, among)):
        # a kind that holds enough of a query's hashes holds one of its rarest
        rare = rare.where(F.col("place") <= F.col("hits") - need + 1)
        met = rare.select("key", *which).join(by_key, "key").where(larger).select(*which, "kind").distinct()
        held = met.join(asks.select(*which, F.col("keys").alias("own"), "core"), which).join(kinds.select("kind", "keys"), "kind")
        held = held.where(F.size(F.array_intersect("own", "keys")) >= need).where(F.col("core").isNull() | (F.size(F.array_intersect("core", "keys")) < need))
        # all targets of these kinds
        ask = F.struct(F.lit(number).alias("number"), "ask").alias("ask")
        to.append(held.select(*which, "kind").join(members, "kind").where(larger).select(ask, "size", "alone", "b"))
        by.append(asks.select(ask, "size", "alone", F.explode("of").alias("a")))
    return cut(by[0].unionByName(by[1])), cut(to[0].unionByName(to[1]).distinct())


def parts(reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, near: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """(ask, a) and (ask, b): the verified parts a with their containers b, of which equal sets count once, but for pairs of ``near``.

    Each a of an ask has each of its b, and a pair is in one ask only.  A line
    that very many texts have makes parts times containers; parts that found the
    same of their frequent hashes share an ask, so these pairs are not made.
    """
    # rows that repeat an id are several sets, which the texts tell apart
    several = cut(docs.groupBy(docs[id_col].alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"))
    asked = reps.select(F.explode("least").alias("key"), F.col("id").alias("a"), "size")
    found, hits = _looked_up(asked, docs, id_col, text_col, params, params.needed(F.col("size")))
    # who found enough of a sample looks up all its hashes, in the targets that hold enough of the sample
    by, to = _answered(found.where(F.col("size") > params.whole), hits, reps, several, params, F.lit(params.found()))
    tidy(docs.sparkSession)
    who = cut(by.join(to.select("ask", "size", "alone").distinct(), ["ask", "size", "alone"], "left_semi").select("a", "size").distinct())
    every = _hits(_of(docs, id_col, who.select(F.col("a").alias("id"))), id_col, text_col, params, None, 0).select("key", F.col("b").alias("a"), F.col("size_b").alias("size"))
    every = cut(every.join(who, ["a", "size"], "left_semi").select("key", "a", "size"))
    need = F.ceil(F.col("size") * params.t - 1e-9)
    more, their = _looked_up(every, _of(docs, id_col, to.select(F.col("b").alias("id"))), id_col, text_col, params, need)
    small = found.where(F.col("size") <= params.whole)
    tidy(docs.sparkSession)
    by, to = _answered(small.unionByName(more), _among(hits, small.select("key")).unionByName(their), reps, several, params, need)
    tidy(docs.sparkSession)
    to = to.join(several.select(F.col("id").alias("b"), F.lit(True).alias("other")), "b", "left")
    unsure = cut(by.join(to.where("alone or other").select("ask", "size", "alone", "b"), ["ask", "size", "alone"]).select("a", "b").distinct())
    by, to = by.where("not alone").select("ask", "a"), to.where("not alone and other is null").select("ask", "b")
    if not unsure.isEmpty():
        pairs = cut(verify(unsure, docs, reps, id_col, text_col, params, parts=True).select("a", "b").distinct().join(near, ["a", "b"], "left_anti"))
        ask = F.struct(F.lit(2).alias("number"), F.col("a").alias("ask")).alias("ask")
        by, to = by.unionByName(pairs.select(ask, "a").distinct()), to.unionByName(pairs.select(ask, "b"))
    return cut(by), cut(to)


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the nodes 0 to n - 1 that each of them is connected to."""
    root = np.arange(n)
    while True:
        ends = root[a], root[b]
        low, new = np.minimum(*ends), root.copy()
        for end in ends:
            np.minimum.at(new, end, low)
        while ((up := new[new]) != new).any():
            new = up
        if (new == root).all():
            return root
        root = new


def _components_in_one(edges: DataFrame) -> DataFrame:
    """``components`` by one task, for nodes whose order Arrow and Spark agree on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch for batch in batches if batch.num_rows]
        if rows:
            both = pa.chunked_array([batch.column(k) for k in (0, 1) for batch in rows]).combine_chunks()
            names = both.unique()
            names = names.take(pc.sort_indices(names))
            a, b = np.split(pc.index_in(both, value_set=names).to_numpy(), 2)
            root = _joined(a, b, len(names))
            node = np.flatnonzero(root != np.arange(len(names)))
            for k in range(0, len(node), 100_000):
                part = node[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(part)), names.take(pa.array(root[part]))], names=["node", "root"])

    id_type = edges.schema["a"].dataType.simpleString()
    return cut(edges.coalesce(1).mapInArrow(run, f"node {id_type}, root {id_type}"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) is connected to, but for these themselves, in one task or by alternating large and small stars."""
    own = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    # each query of a round leaves plans, threads and broadcast tables with the driver, so few edges aren't worth any round
    if own.schema["a"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "string", "binary", "date") and own.count() <= ONE_TASK_EDGES:
        return _components_in_one(own)
    mark = None
    while True:
        # large star: each node's larger neighbours go to its least neighbour; the minima are combined before they are shuffled, however many neighbours a node has
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its smaller neighbours go to the least of them
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        own = cut(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        now = own.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 30))).first()
        if now == mark:
            return own.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def _heads(roots: DataFrame, sizes: DataFrame, asks: DataFrame, holds: DataFrame) -> DataFrame:
    """(root, head) of the classes that go with a container's class: the one that stays at the end; ``roots`` is (node, root), ``asks`` (ask, a) and ``holds`` (ask, b)."""
    whole = sizes.join(roots, sizes["id"] == roots["node"], "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.max("size").alias("most"))
    ends = asks.join(roots.select(F.col("node").alias("a"), F.lit(1).alias("other")), "a", "left_anti").select("ask", F.col("a").alias("root"))  # roots, and classes of one
    ends = ends.join(whole, "root")
    to = holds.join(roots.select(F.col("node").alias("b"), F.col("root").alias("to")), "b", "left").select("ask", F.coalesce("to", "b").alias("to"))
    to = to.distinct().join(whole.select(F.col("root").alias("to"), F.col("most").alias("more")), "to").groupBy("ask", "more").agg(F.min("to").alias("to"))
    # of an ask's classes only those that are less than all larger ones can be gone with
    least = F.min("to").over(Window.partitionBy("ask").orderBy(F.desc("more")).rowsBetween(Window.unboundedPreceding, -1))
    to = to.withColumn("least", least).where("least is null or to < least").drop("least")
    # sizes only grow along these, so no class goes with itself
    step = cut(ends.join(to, "ask").where("more > most").groupBy("root").agg(F.min("to").alias("head")))
    while True:
        jump = step.join(step.select(F.col("root").alias("head"), F.col("head").alias("next")), "head", "left")
        if jump.where("next is not null").isEmpty():
            return step
        step = cut(jump.select("root", F.coalesce("next", "head").alias("head")))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """(id, kept_id, part, n_links) of each document that goes: the document that stays for it, whether it goes as part of a larger one, and the number of verified links to documents of other texts that were found."""
    made = cut(sketches(docs, id_col, text_col, params))
    first = made.groupBy("content").agg(F.min("id").alias("of"))
    reps = cut(made.join(first.select("content", F.col("of").alias("id")), ["content", "id"], "left_semi").dropDuplicates(["content", "id"]))
    # the same set under another id; a text that thousands have is one row on the other side
    equal = cut(made.select("id", "content").join(first, "content").where("id <> of").select(F.col("id").alias("a"), F.col("of").alias("b")).distinct())
    near = cut(copies(reps, docs, id_col, text_col, params).distinct())
    tidy(docs.sparkSession)
    asks, holds = parts(reps, docs, id_col, text_col, near, params)
    tidy(docs.sparkSession)
    roots = cut(components(equal.unionByName(near)))
    heads = _heads(roots, made.select("id", "size"), asks, holds)
    # of a part as many as its ask has containers, of a container as many as its asks have parts
    links = near.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    links = links.unionByName(asks.join(holds.groupBy("ask").agg(F.count("*").alias("n_links")), "ask").select(F.col("a").alias("node"), "n_links"))
    links = links.unionByName(holds.join(asks.groupBy("ask").agg(F.count("*").alias("n_links")), "ask").select(F.col("b").alias("node"), "n_links"))
    links = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    gone = roots.select("node", "root", F.lit(False).alias("part")).join(heads, "root", "left").select("node", F.coalesce("head", "root").alias("kept"), F.col("head").isNotNull().alias("part"))
    gone = gone.unionByName(heads.select(F.col("root").alias("node"), F.col("head").alias("kept"), F.lit(True).alias("part")))
    return gone.join(links, "node", "left").select(F.col("node").alias(id_col), F.col("kept").alias(f"kept_{id_col}"), "part", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` without those that ``duplicates`` lists, and one row of each id; rows of null id aren't judged."""
    gone, place = fresh(docs, "gone"), fresh(docs, "place")
    found = duplicates(docs, id_col, text_col, params).select(F.col(id_col).alias(gone))
    named = docs.where(docs[id_col].isNotNull())
    rest = named.join(found, named[id_col] == found[gone], "left_anti")
    one = rest.withColumn(place, F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))).where(F.col(place) == 1).drop(place)
    return one.unionByName(docs.where(docs[id_col].isNull()))
