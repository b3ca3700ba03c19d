"""Sharding over fixed virtual slots.

A record's slot is a hash of its id, so it never changes; slots, not records,
belong to shards.  Bytes are summed per slot, and a rebalancing edits single
slots of the slot-to-shard map under a new version.  The map has one row a slot
and a few edits, at any size of the data, so it is built on the driver and
broadcast.  It is kept as tables in a shared folder, where each version adds its
edits, and a later rebalancing reads it from there and goes on.

Defined results: records of null id share the slot of the empty string; a null
or empty payload counts 0 bytes, a very long one all of its own; repeated rows
have the same slot and count each.  Empty tables give empty slots, which stay where they are.  ``assign``
replaces input columns that have the names of its own.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import fresh, shared_dir

SLOTS = 4096


def slot_of(id_col: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % slots).cast("int")


def with_slots(docs: DataFrame, id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    return docs.withColumn("slot", slot_of(F.col(id_col), slots))


def slot_bytes(docs: DataFrame, id_col: str = "doc_id", payload_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(slot, n_docs, n_bytes) of the slots that have records."""
    given = docs.select(slot_of(docs[id_col], slots).alias("slot"), F.coalesce(F.octet_length(docs[payload_col]), F.lit(0)).cast("bigint").alias("n"))
    return given.groupBy("slot").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_bytes"))


class SlotMap:
    """Versions of a slot-to-shard map: version 1 has every slot, each later one only its edits."""

    def __init__(self, slots: int = SLOTS, shards: int = 64):
        self.slots, self.shards = slots, shards
        self.widths = [shards]  # each version's number of shards
        self.edits: list[dict[int, int]] = [{s: s * shards // slots for s in range(slots)}]

    @property
    def version(self) -> int:
        return len(self.edits)

    def at(self, version: int | None = None) -> list[int]:
        """Each slot's shard in a version, the latest by default."""
        version = self.version if version is None else version
        if not 1 <= version <= self.version:
            raise ValueError(f"no version {version}")
        shard = [0] * self.slots
        for edit in self.edits[:version]:
            for s, to in edit.items():
                shard[s] = to
        return shard

    def rebalance(self, sizes: dict[int, int], shards: int | None = None, slack: float = 0.02) -> dict[int, int]:
        """A new version in which no shard has over (1 + ``slack``) of its share, as far as whole slots allow; the slots it moves.

        Slots of shards that go move to the emptiest.  Then the fullest shard
        gives the emptiest its largest slot that narrows the gap between them,
        until it is within the slack or has no such slot.
        """
        shards = self.shards if shards is None else shards
        now = self.at()
        owned: dict[int, list[int]] = {k: [] for k in range(shards)}
        homeless = []
        for s, k in enumerate(now):
            (owned[k] if k < shards else homeless).append(s)
        load = {k: sum(sizes.get(s, 0) for s in own) for k, own in owned.items()}
        target = sum(sizes.values()) / shards
        lightest = [(n, k) for k, n in load.items()]
        heapq.heapify(lightest)
        moved: dict[int, int] = {}

        def put(s: int, k: int) -> None:
            owned[k].append(s)
            load[k] += sizes.get(s, 0)
            now[s] = moved[s] = k
            heapq.heappush(lightest, (load[k], k))

        def emptiest() -> int:
            while load[lightest[0][1]] != lightest[0][0]:
                heapq.heappop(lightest)
            return lightest[0][1]

        for s in sorted(homeless, key=lambda s: (-sizes.get(s, 0), s)):
            put(s, emptiest())
        stuck: set[int] = set()
        while True:
            full = max((k for k in owned if k not in stuck), key=lambda k: (load[k], -k), default=None)
            if full is None or load[full] <= target * (1 + slack):
                break
            to = emptiest()
            gap = load[full] - load[to]
            fits = [s for s in owned[full] if 0 < sizes.get(s, 0) < gap]
            if to == full or not fits:
                stuck.add(full)
                continue
            # the slot nearest to half the gap makes the two most alike
            s = min(fits, key=lambda s: (abs(sizes[s] - gap / 2), s))
            owned[full].remove(s)
            load[full] -= sizes[s]
            heapq.heappush(lightest, (load[full], full))
            put(s, to)
        before = self.at()
        self.shards = shards
        self.widths.append(shards)
        self.edits.append({s: k for s, k in moved.items() if before[s] != k})
        return self.edits[-1]

    def frame(self, spark, version: int | None = None, name: str = "shard") -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.at(version))), f"slot int, {name} int")

    def log(self, spark) -> DataFrame:
        """(version, slot, shard): every edit, to be kept beside the data."""
        return spark.createDataFrame([(v + 1, s, k) for v, edit in enumerate(self.edits) for s, k in edit.items()], "version int, slot int, shard int")


def store(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Write the versions that ``path`` doesn't have: the edits first, then the row that makes them count; who finds a version written meanwhile fails."""
    log, known = slot_map.log(spark), _versions(spark, path)
    for v in range(len(known) + 1, slot_map.version + 1):
        log.where(F.col("version") == v).coalesce(1).write.mode("overwrite").parquet(f"{path}/edits/v{v}")
        spark.createDataFrame([(v, slot_map.slots, slot_map.widths[v - 1])], "version int, slots int, shards int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/versions/v{v}")


def stored(spark: SparkSession, path: str) -> SlotMap:
    """The map that ``path`` has, with all its versions."""
    known = _versions(spark, path)
    if not known:
        raise ValueError(f"no slot map in {path}")
    slot_map = SlotMap(known[0]["slots"], known[0]["shards"])
    slot_map.widths = [r["shards"] for r in known]
    slot_map.shards = slot_map.widths[-1]
    slot_map.edits = [{} for _ in known]
    for r in spark.read.parquet(*(f"{path}/edits/v{r['version']}" for r in known)).collect():
        slot_map.edits[r["version"] - 1][r["slot"]] = r["shard"]
    return slot_map


def _versions(spark: SparkSession, path: str) -> list[Row]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    return spark.read.parquet(f"{path}/versions/*").orderBy("version").collect()


def rebalance_stored(spark: SparkSession, path: str, sizes: dict[int, int], shards: int | None = None) -> dict[int, int]:
    """Edit the map that ``path`` has under a new version; the slots it moves."""
    slot_map = stored(spark, path)
    moved = slot_map.rebalance(sizes, shards)
    store(spark, slot_map, path)
    return moved


def assign(docs: DataFrame, slot_map: SlotMap, id_col: str = "doc_id", versions: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with its slot and a shard column for each of ``versions`` (name -> version; the latest as ``shard`` by default).  No shuffle."""
    names = {"shard": slot_map.version} if versions is None else versions
    ats = [slot_map.at(v) for v in names.values()]
    given = docs.drop(*(n for n in names if n != id_col)).withColumn("slot", slot_of(F.col(id_col), slot_map.slots))
    own = fresh(given, "s")
    rows = [(s, *(at[s] for at in ats)) for s in range(slot_map.slots)]
    table = docs.sparkSession.createDataFrame(rows, ", ".join([f"{own} int", *(f"{n} int" for n in names)]))
    # the table has one row a slot, whatever the data's size
    return given.join(F.broadcast(table), given["slot"] == table[own], "left").drop(own)


def balanced(docs: DataFrame, shards: int = 64, grown_to: int = 72, id_col: str = "doc_id", payload_col: str = "text", slots: int = SLOTS, path: str | None = None) -> SlotMap:
    """A map over ``shards``, rebalanced by bytes (version 2) and again for more shards (version 3); kept in ``path``, or in a new shared folder."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    if _versions(spark, path):
        raise ValueError(f"{path} has a slot map; rebalance_stored edits it")
    sizes = {r["slot"]: r["n_bytes"] for r in slot_bytes(docs, id_col, payload_col, slots).collect()}  # one row a slot
    store(spark, SlotMap(slots, shards), path)
    rebalance_stored(spark, path, sizes)
    rebalance_stored(spark, path, sizes, grown_to)
    return stored(spark, path)
