"""Approximate nearest neighbours on robust-pruned directed graphs, one a shard.

Equal vectors are folded before the build: a graph has one node a distinct
vector, which carries the ids of its copies, since pruning keeps but one or two
of several equal ones.  Answers are found for distinct vectors and expanded
exactly, by least id, when they are merged; no list needs more than the k + 1
least ids of a vector.

Distinct vectors are hashed into shards of bounded size.  In a shard each is
inserted by a greedy search from the medoid, whose visited vectors are pruned
to edges that a shorter detour doesn't make needless: a candidate goes if an
edge already kept is ``alpha`` times nearer to it than the vector itself (a
pass with alpha 1, then one with a larger alpha that keeps longer edges).
Reverse edges are added and pruned alike.  A query searches every shard with a
beam, and the shards' answers are merged exactly.

Every row is indexed; the queries are a stated set, the rows whose id is
divisible by ``every``, so their number is that share of the rows.

Searches and prunings run for many vectors at once in numpy.  Of equal vectors
each partition keeps the k + 1 least ids before any shuffle, and queries of one
vector are spread over ``_SALT`` keys where its answers are handed out, so a
group of copies may hold any share of the rows.

Defined results: rows of null id, or whose vector is null, empty, of another
length than most, or has a null or non-finite component, take no part.  Rows that repeat an
id are one vector (the first in order).  Equal vectors are neighbours at
distance 0; of equal distances the lesser id comes first.  A vector is not its
own neighbour.  With fewer than k others all are neighbours.  A vector is used
whole, however long, and 0.0 equals -0.0.  An empty table, or one without a
query, gives no row.  Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

DEGREE, BEAM, ALPHA = 24, 48, 1.2
SHARD_ROWS, BLOCK_ROWS = 4000, 1000
#: Keys that the queries of one vector are spread over.
_SALT = 16


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of (b, d) to (b, m, d)."""
    gap = y - x[:, None, :]
    return np.einsum("bmd,bmd->bm", gap, gap)


def beam_search(graph: np.ndarray, vectors: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's ``beam`` nearest found vectors with their distances, in order (-1 and inf where there are fewer)."""
    q, n, width = len(queries), len(vectors), 4
    ids = np.full((q, beam), -1)
    dist = np.full((q, beam), np.inf, dtype=np.float32)
    ids[:, 0], dist[:, 0] = entry, distances(queries, vectors[None, [entry]].repeat(q, axis=0))[:, 0]
    open_ = np.zeros((q, beam), dtype=bool)
    open_[:, 0] = True
    seen = np.zeros((q, n + 1), dtype=bool)  # the last column stands for -1
    seen[:, [entry, n]] = True
    live = np.arange(q)
    while len(live):
        # the nearest unexpanded ones of each query
        rank = np.cumsum(open_[live], axis=1)
        take = open_[live] & (rank <= width)
        row, column = np.nonzero(take)
        open_[live[row], column] = False
        nexts = np.full((len(live), width, graph.shape[1]), -1)
        nexts[row, rank[row, column] - 1] = graph[ids[live[row], column]]
        nexts = nexts.reshape(len(live), -1)
        nexts = np.sort(nexts, axis=1)
        nexts[:, 1:][nexts[:, 1:] == nexts[:, :-1]] = -1
        fresh = ~seen[live[:, None], nexts]
        nexts[~fresh] = -1
        seen[live[:, None], nexts] = True
        d = np.where(fresh, distances(queries[live], vectors[nexts]), np.inf).astype(np.float32)
        all_ids, all_d = np.concatenate([ids[live], nexts], axis=1), np.concatenate([dist[live], d], axis=1)
        all_open = np.concatenate([open_[live], fresh], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_d, best, 1)
        open_[live] = np.take_along_axis(all_open, best, 1) & np.isfinite(dist[live])
        live = live[open_[live].any(axis=1)]
    return np.where(np.isfinite(dist), ids, -1), dist


def prune(points: np.ndarray, candidates: np.ndarray, vectors: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Robust pruning of (b, m) candidates (-1: none) of b points: (b, degree) edges, padded with -1."""
    own = np.sort(np.where(candidates == points[:, None], -1, candidates), axis=1)
    own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
    x = vectors[own]
    to_point = np.where(own >= 0, distances(vectors[points], x), np.inf)
    norm = np.einsum("bmd,bmd->bm", x, x)
    between = norm[:, :, None] + norm[:, None, :] - 2 * x @ x.transpose(0, 2, 1)
    out = np.full((len(points), degree), -1)
    left = to_point.copy()
    rows = np.arange(len(points))
    for k in range(degree):
        best = left.argmin(axis=1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        out[some, k] = own[rows, best][some]
        gone = alpha * alpha * between[rows, best] <= to_point
        gone[rows, best] = True
        left[gone & some[:, None]] = np.inf
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 256) -> tuple[np.ndarray, int]:
    """The graph (n, degree), padded with -1, and its entry point."""
    n = len(vectors)
    entry = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
    rng = np.random.default_rng(7)
    graph = np.full((n, degree), -1)
    if n > 1:
        graph[:, : min(degree, n - 1)] = (np.arange(n)[:, None] + rng.integers(1, n, size=(n, min(degree, n - 1)))) % n
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for begin in range(0, n, batch):
            points = order[begin : begin + batch]
            found, _ = beam_search(graph, vectors, entry, vectors[points], beam)
            graph[points] = prune(points, np.concatenate([found, graph[points]], axis=1), vectors, a, degree)
            source = np.repeat(points, degree)
            target = graph[points].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            nodes, start, count = np.unique(target, return_index=True, return_counts=True)
            for some in np.array_split(np.argsort(count), max(1, len(nodes) // 256)):  # of like counts, to pad little
                if not len(some):
                    continue
                more = np.full((len(some), int(count[some].max())), -1)
                for r, k in enumerate(some):
                    more[r, : count[k]] = source[start[k] : start[k] + count[k]]
                joined = np.concatenate([graph[nodes[some]], more], axis=1)
                graph[nodes[some]] = prune(nodes[some], joined, vectors, a, degree)
    return graph, entry


def clean(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<float>) of the rows that take part."""
    given = table.select(table[id_col].alias("id"), table[vector_col].cast("array<float>").alias("vector")).where("id is not null and vector is not null and size(vector) > 0")
    given = given.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    usual = given.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n").collect()
    given = given.where(F.size("vector") == (usual[0]["n"] if usual else -1))
    given = given.select("id", F.transform("vector", lambda x: x + F.lit(0.0).cast("float")).alias("vector"))
    return given.groupBy("id").agg(F.min("vector").alias("vector"))


def folded(vectors: DataFrame, k: int) -> DataFrame:
    """The distinct vectors (id, vector, members), of their least id and with their k + 1 least ids in order."""
    # the limit by rank is applied within partitions before the shuffle
    least = vectors.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("place") <= k + 1)
    return cut(least.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members")).select(F.col("members")[0].alias("id"), "vector", "members"))


def nodes_of(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, of): the distinct vector of each of the vectors ``asked``; joined by a salted digest of 128 bits, as many may have one vector."""
    digest = lambda: [F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(7), "vector").alias("g")]
    salted = nodes.select(F.col("id").alias("of"), *digest()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))
    return asked.select("id", *digest(), F.pmod(F.xxhash64("id"), F.lit(_SALT)).cast("int").alias("salt")).join(salted, ["h", "g", "salt"]).select("id", "of")


def graphs(vectors: DataFrame, shards: int, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """(shard, ids, members, vectors, graph, entry): one row a shard of distinct vectors; matrices are bytes."""
    id_type = vectors.schema["id"].dataType.simpleString()

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        matrix = np.stack(frame["vector"].to_numpy()).astype(np.float32)
        graph, entry = build(matrix, degree, beam, alpha)
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "ids": [frame["id"].to_numpy()], "members": [list(frame["members"])], "vectors": [matrix.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "entry": [entry]})

    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return placed.groupBy("shard").applyInPandas(one, f"shard int, ids array<{id_type}>, members array<array<{id_type}>>, vectors binary, graph binary, entry int")


def blocks(queries: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """(ids, vectors): queries packed by the ``rows``."""
    id_type = queries.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                ids, matrix = part.column(0), part.column(1).flatten().to_numpy().astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], type=pa.int32()), ids), pa.array([matrix.tobytes()], type=pa.binary())], names=["query_ids", "queries"])

    return queries.select("id", "vector").mapInArrow(pack, f"query_ids array<{id_type}>, queries binary")


def neighbours(table: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, every: int = 1) -> DataFrame:
    """(id, neighbour_id, rank, distance): the k nearest others, over all shards, of each vector whose id is divisible by ``every``; with 1 of each vector, whatever its id."""
    id_type = table.schema[id_col].dataType.simpleString()
    vectors = cut(clean(table, id_col, vector_col))
    nodes = folded(vectors, k)
    queries = cut(nodes_of(vectors if every == 1 else vectors.where(F.col("id") % every == 0), nodes))
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    index = cut(graphs(nodes, shards, degree, beam, alpha)).repartition(shards)
    wanted = nodes.join(queries.select(F.col("of").alias("id")).distinct(), "id", "left_semi")
    asked = cut(blocks(wanted))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, members, raw, edges, entry, query_ids, queries = (c[r] for c in batch.columns)
                ids, members, query_ids = ids.values, members.values, query_ids.values
                matrix = np.frombuffer(raw.as_py(), dtype=np.float32).reshape(len(ids), -1)
                graph = np.frombuffer(edges.as_py(), dtype=np.int32).reshape(len(ids), -1).astype(np.int64)
                asked_ = np.frombuffer(queries.as_py(), dtype=np.float32).reshape(len(query_ids), -1)
                for begin in range(0, len(asked_), 250):
                    found, dist = beam_search(graph, matrix, entry.as_py(), asked_[begin : begin + 250], max(beam, k + 1))
                    found, dist = found[:, : k + 1], dist[:, : k + 1]  # one may be the query itself
                    row, column = np.nonzero(found >= 0)
                    other = pc.not_equal(query_ids.take(pa.array(row + begin)), ids.take(pa.array(found[row, column]))).to_numpy(zero_copy_only=False)
                    row, column = row[other], column[other]
                    near = members.take(pa.array(found[row, column]))
                    each = np.repeat(np.arange(len(row)), near.value_lengths().to_numpy())
                    row, column = row[each], column[each]
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(row + begin)), near.flatten(), pa.array(np.sqrt(dist[row, column].astype(np.float64)))], names=["of", "neighbour", "distance"])

    pairs = index.select("ids", "members", "vectors", "graph", "entry").crossJoin(asked).mapInArrow(search, f"of {id_type}, neighbour {id_type}, distance double")
    pairs = pairs.unionByName(wanted.select(F.col("id").alias("of"), F.explode("members").alias("neighbour"), F.lit(0.0).alias("distance")))
    order = Window.partitionBy("of").orderBy("distance", "neighbour")
    best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    lists = best.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(_SALT)).cast("int")
    spread = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))
    own = queries.withColumn("salt", salt("id")).join(spread, ["of", "salt"]).select("id", F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("near"))
    out = own.select("id", F.posexplode("near").alias("place", "x"))
    return out.select(F.col("id").alias(id_col), F.col("x.neighbour").alias(f"neighbour_{id_col}"), (F.col("place") + 1).alias("rank"), F.col("x.distance").alias("distance"))
