"""Repeated passages of many documents, by suffix arrays in linear grouping order.

Any two passages of ``length`` equal words hold the same least ``k``-word run
(the winnowing of their words), so a passage that repeats has all its
occurrences in one bucket, that of its least run.  A bucket holds, for each
place that chose it, the window of words whose passages have it as their
least; buckets of one document are dropped before any text moves, and equal
windows (by a digest of 128 bits) are kept once.  A suffix array over a bucket's
distinct windows, with the longest common prefixes of its neighbours, gives
exactly the passages of at least ``length`` words that occur more than once.

A run that many documents have, as boilerplate does, is hot.  Its rows are
combined before they are shuffled and judged from a broadcast, and spread over
``_SALT`` keys where answers are handed out; hot are runs with over a
``HOT_SHARE``-th of all rows, so there are never more than that many of them.
Of a bucket with over ``ARRAY_WINDOWS`` distinct windows the passages of
``length`` words are grouped by their own digests instead, combined before the
shuffle: the same answer, and no task holds such a bucket.

The suffix array is built by grouping suffixes by their Lyndon prefixes: the
groups are processed in descending order, each sending its members' previous
smaller suffixes into new groups behind their old ones; the order then emits
group by group along the same pointers, without renaming or recursion.

A passage counts if at least two documents have it.  The document of the least
id keeps it, all others lose it.

Defined results: words are separated by white space and compared as they are;
documents of null id, or of null, empty or short text have no passage and stay
as they are.  Very long texts are read whole, window by window.  Rows that
repeat an id are one document: what only they share is no repeat, and each row
loses what it shares with a lesser id.  Repeats within one document alone are
none.  A document that loses every word is left out.  An empty table gives no
row.  Only the named columns are read; ``remove`` passes all others on, whatever
their names, and gives ``size_col``, if the documents have it, the new number of
characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import text_slices
from .common import RawHashes, cut, fresh, mix, shingles

LENGTH = 50
#: Words of the runs that windows are chosen by; fewer make longer, more make more numerous windows.
RUN = 8
#: A run is hot with over ``HOT_ROWS`` rows and a ``HOT_SHARE``-th of all.
HOT_ROWS, HOT_SHARE = 5000, 20_000
#: Distinct windows of a bucket that one suffix array may hold.
ARRAY_WINDOWS = 2000

_SALT = 16
SPANS = "array<struct<start:int,end:int>>"
_WORD = re.compile(r"\S+")


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a sequence of positive integers, in time linear but for the sort of each group."""
    s = text + [0]
    n = len(s)
    # groups of equal first symbols; sa holds the groups' members side by side, a group is named by its first place
    sa = sorted(range(n), key=s.__getitem__)
    where, group, size = [0] * n, [0] * n, [0] * n
    begin = 0
    for place, i in enumerate(sa):
        if s[i] != s[sa[begin]]:
            begin = place
        where[i], group[i] = place, begin
        size[begin] += 1
    prev = [-1] * n
    high = n - 1
    while high > 0:
        low = group[sa[high]]
        members = sa[low : high + 1]
        if len(members) > 1:
            members.sort()
        counts: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:  # higher groups are done, and of this one the earlier members
                j = prev[j]
            prev[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        if counts:
            by_count: dict[int, list[int]] = {}
            for j, c in counts.items():
                by_count.setdefault(c, []).append(j)
            for c in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                for j in by_count[c]:  # to the end of their groups
                    g = group[j]
                    m = moved[g] = moved.get(g, 0) + 1
                    at, to = where[j], g + size[g] - m
                    other = sa[to]
                    sa[at], sa[to] = other, j
                    where[other], where[j] = at, to
                for g, m in moved.items():
                    if m < size[g]:
                        size[g] -= m
                        new = g + size[g]
                        size[new] = m
                        for j in sa[new : new + m]:
                            group[j] = new
        high = low - 1
    # the least suffix is the end; each suffix in order places the chain before it
    out, free, placed = [-1] * n, list(range(n)), [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = prev[j]
    return out[1:]


def common_prefixes(text: list[int], sa: list[int]) -> list[int]:
    """Longest common prefix of each suffix in order with the one before it (0 for the first)."""
    n = len(text)
    rank, lcp, h = [0] * n, [0] * n, 0
    for r, i in enumerate(sa):
        rank[i] = r
    for i in range(n):
        r = rank[i]
        if r:
            j = sa[r - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            lcp[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return lcp


def placed(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Word hashes mixed with the words' places; their sum is half of a window's digest."""
    return mix(hashes + np.uint64(0x9E3779B97F4A7C15) * place.astype(np.uint64))


def second(words: np.ndarray) -> np.ndarray:
    """From ``placed`` hashes those whose sum is the digest's other half."""
    return mix(words ^ np.uint64(0xD6E8FEB86659FD93))


def choices(hashes: np.ndarray, length: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run hash, first word, end, the two halves of the digest) of each window: the passages of ``length`` words from first to end whose least run (the leftmost of equals) is the same."""
    n = len(hashes) - length + 1
    if n < 1:
        empty = np.zeros(0, dtype=np.int64)
        return empty.astype(np.uint64), empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    runs = shingles(hashes, run)
    width = length - run + 1
    # least of each window of ``width`` runs, by doubling; ties go to the left
    at, step = np.arange(len(runs)), 1
    while step * 2 <= width:
        a, b = at[:-step], at[step:]
        at = np.where(runs[b] < runs[a], b, a)
        step *= 2
    a, b = at[:n], at[width - step : width - step + n]
    least = np.where(runs[b] < runs[a], b, a)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.append(first[1:], n) - 1
    end = last + length
    width_of = end - first
    inside = np.arange(int(width_of.sum())) - np.repeat(np.cumsum(width_of) - width_of, width_of)
    words = placed(hashes[np.repeat(first, width_of) + inside], inside)
    begin = np.cumsum(width_of) - width_of
    return runs[least[first]], first, end, np.add.reduceat(words, begin), np.add.reduceat(second(words), begin)


def windows(docs: DataFrame, id_col: str, text_col: str, length: int, run: int) -> DataFrame:
    """(run, window, check, id, start, end) of each window of each document; ``window`` and ``check`` are its digest."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = RawHashes()
        for batch in batches:
            for first, texts in text_slices((x.as_py() for x in batch.column(1)), 500_000):
                found, counts = [], []
                for text in texts:
                    found.append(choices(words.of(text.split()), length, run))
                    counts.append(len(found[-1][0]))
                which = np.repeat(np.arange(first, first + len(texts)), counts)
                key, start, end, window, check = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (key, window, check)), batch.column(0).take(pa.array(which)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["run", "window", "check", "id", "start", "end"])

    given = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= 2 * length - 1))
    return given.mapInArrow(make, f"run bigint, window bigint, check bigint, id {id_type}, start int, end int")


def _classes(rows: list[tuple], length: int) -> Iterator[tuple]:
    """(window, start, end, keeper) of the repeated stretches in a bucket of (window's digest, least id, greatest id, words)."""
    number: dict[str, int] = {}
    text: list[int] = []
    owner: list[int] = []
    begin: list[int] = []
    for w, (_, _, _, words) in enumerate(rows):
        begin.append(len(text))
        own = [number.setdefault(x, len(number)) + len(rows) + 1 for x in words.split()]
        text += own
        text.append(w + 1)  # an end that no other window has
        owner += [w] * (len(own) + 1)
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa)
    # passages of ``length`` words that are equal stand together; a window alone may itself be in many documents
    found: dict[tuple, set] = {}
    k = 0
    ends = [b - 1 for b in begin[1:]] + [len(text) - 1]
    while k < len(sa):
        to = k + 1
        while to < len(sa) and lcp[to] >= length:
            to += 1
        members = sa[k:to]
        k = to
        if ends[owner[members[0]]] - members[0] < length:
            continue
        least = min(rows[owner[i]][1] for i in members)
        if any(rows[owner[i]][2] != least for i in members):
            for i in members:
                w = owner[i]
                found.setdefault((w, least), set()).add(i - begin[w])
    for (w, least), starts in found.items():
        run_start = run_end = None
        for i in sorted(starts):
            if run_end is not None and i <= run_end:
                run_end = i + length
            else:
                if run_end is not None:
                    yield rows[w][0], run_start, run_end, least
                run_start, run_end = i, i + length
        yield rows[w][0], run_start, run_end, least


def _shared(found: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of ``found`` whose run several documents have, with the least of these (``low``), whether their windows differ (``mixed``), and whether the run is ``hot``."""
    keep = ["run", "window", "check", "id", "start", "end", "low", "mixed", "hot"]
    bucket, digest = Window.partitionBy("run"), F.struct("window", "check")
    cold = found.join(F.broadcast(hot), "run", "left_anti")
    for name, f, c in (("low", F.min, "id"), ("high", F.max, "id"), ("one", F.min, digest), ("other", F.max, digest)):
        cold = cold.withColumn(name, f(c).over(bucket))
    cold = cold.where("low <> high").withColumns({"mixed": F.col("one") != F.col("other"), "hot": F.lit(False)})
    many = found.join(F.broadcast(hot), "run")
    kinds = many.groupBy("run", "window", "check").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    judged = kinds.groupBy("run").agg(F.min("low").alias("low"), F.max("high").alias("high"), (F.count("*") > 1).alias("mixed")).where("low <> high")
    many = many.join(F.broadcast(judged), "run").withColumn("hot", F.lit(True))  # one row a hot run
    return cold.select(*keep).unionByName(many.select(*keep))


def _cut_out(kinds: DataFrame, docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(run, window, check, low, high, words, h, g): each kind's words from its least document, or, where ``many``, the digests of its passages instead."""
    id_type = docs.schema[id_col].dataType.simpleString()
    per_doc = kinds.groupBy(F.col("at.id").alias("id")).agg(F.collect_list(F.struct("run", "window", "check", "at.start", "at.end", "high", "many")).alias("cuts"))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RawHashes()
        signed = lambda x: int(x.sum().view(np.int64))
        for batch in batches:
            for first, texts_ in text_slices((x.as_py() for x in batch.column(1)), 500_000):
                which, rows = [], []
                for k, (text, cuts) in enumerate(zip(texts_, batch.column(2).slice(first, len(texts_)).to_pylist())):
                    words = (text or "").split()
                    for c in cuts:
                        own = words[c["start"] : c["end"]]
                        hashed = hashes.of(own)
                        digest = placed(hashed, np.arange(len(own)))
                        if (signed(digest), signed(second(digest))) != (c["window"], c["check"]):
                            continue  # rows that repeat an id may have other words here
                        h = g = None
                        if c["many"]:
                            each = placed(np.lib.stride_tricks.sliding_window_view(hashed, length), np.arange(length))
                            h, g = (x.sum(axis=1).view(np.int64) for x in (each, second(each)))
                        which.append(first + k)
                        rows.append((c["run"], c["window"], c["check"], c["high"], None if c["many"] else " ".join(own), h, g))
                columns = list(zip(*rows)) or [[]] * 7
                ids = batch.column(0).take(pa.array(which, type=pa.int64()))
                types = (*(pa.int64(),) * 3, ids.type, pa.string(), *(pa.list_(pa.int64()),) * 2)
                arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([*arrays[:3], ids, *arrays[3:]], names=["run", "window", "check", "low", "high", "words", "h", "g"])

    return per_doc.join(texts, "id").select("id", "text", "cuts").mapInArrow(run, f"run bigint, window bigint, check bigint, low {id_type}, high {id_type}, words string, h array<bigint>, g array<bigint>")


def _by_arrays(pieces: DataFrame, length: int) -> DataFrame:
    """(run, window, check, keeper, from, to): the stretches of windows that repeat, by a suffix array a bucket."""
    id_type = pieces.schema["low"].dataType.simpleString()

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: int, rows: list[tuple]) -> list[tuple]:
            return [(key, *w, begin, end, least) for w, begin, end, least in _classes(rows, length)]

        kind = None
        key, rows, done = None, [], []
        for batch in batches:
            kind = batch.column(3).type
            for own, window, check, low, high, words in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    if rows:
                        done += out(key, rows)
                    key, rows = own, []
                if not rows or rows[-1][0] != (window, check):
                    rows.append(((window, check), low, high, words))
            if len(done) > 20_000:
                yield batch_of(done, kind)
                done = []
        if rows:
            done += out(key, rows)
        if done:
            yield batch_of(done, kind)

    def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = (*(pa.int64(),) * 3, pa.int32(), pa.int32(), kind)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=["run", "window", "check", "from", "to", "keeper"])

    given = pieces.where("words is not null").select("run", "window", "check", "low", "high", "words")
    return given.repartition("run").sortWithinPartitions("run", "window", "check").mapInArrow(arrange, f"run bigint, window bigint, check bigint, from int, to int, keeper {id_type}")


def _by_digests(pieces: DataFrame, length: int) -> DataFrame:
    """The same for buckets of many windows, by the digests of their passages."""
    each = pieces.where("words is null").select("run", "window", "check", "low", "high", F.posexplode(F.arrays_zip("h", "g")).alias("at", "x"))
    each = each.select("run", "window", "check", "low", "high", "at", "x.h", "x.g", F.pmod(F.xxhash64("window"), F.lit(_SALT)).cast("int").alias("salt"))
    groups = each.groupBy("h", "g").agg(F.min("low").alias("keeper"), F.max("high").alias("most")).where("keeper <> most")
    groups = groups.select("h", "g", "keeper", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))).alias("salt"))
    hits = each.join(groups, ["h", "g", "salt"]).select("run", "window", "check", "keeper", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    return merged(hits, "run", "window", "check", "keeper").select("run", "window", "check", "keeper", F.explode("spans").alias("s")).select("run", "window", "check", F.col("s.start").cast("int").alias("from"), F.col("s.end").cast("int").alias("to"), "keeper")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, run: int = RUN) -> DataFrame:
    """(id, keeper, start, end): stretches of words that occur in other documents too, and the least id that has them; stretches may overlap."""
    found = cut(windows(docs, id_col, text_col, length, run))
    hot = cut(found.groupBy("run").count().where(F.col("count") > max(HOT_ROWS, found.count() // HOT_SHARE)).select("run"))
    found = cut(_shared(found, hot))
    alike = found.where("not mixed").select("id", F.col("low").alias("keeper"), "start", "end")
    mixed = found.where("mixed")
    kinds = cut(mixed.groupBy("run", "window", "check").agg(F.min(F.struct("id", "start", "end")).alias("at"), F.max("id").alias("high")))
    many = kinds.groupBy("run").count().where(F.col("count") > ARRAY_WINDOWS).select("run", F.lit(True).alias("many"))
    kinds = kinds.join(many, "run", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    pieces = cut(_cut_out(kinds, docs, id_col, text_col, length))
    stretches = _by_arrays(pieces, length).unionByName(_by_digests(pieces, length))
    spread = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(_SALT - 1))).otherwise(F.array(F.lit(0)))
    stretches = stretches.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "run", "left").withColumn("salt", F.explode(spread)).drop("hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(_SALT)).cast("int")).otherwise(0)
    held = mixed.select("run", "window", "check", "id", "start", salt.alias("salt")).join(stretches, ["run", "window", "check", "salt"])
    return alike.unionByName(held.select("id", "keeper", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end")))


def merged(found: DataFrame, *by: str) -> DataFrame:
    """(by, spans): the stretches of each key, merged where they overlap or touch."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.select(*by, "start", "end").distinct().withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, run: int = RUN) -> DataFrame:
    """(id, first_id, spans, removed): the repeated stretches of each document, in words, by the document that keeps them; ``removed`` says that this is another one."""
    found = merged(repeats(docs, id_col, text_col, length, run), "id", "keeper")
    return found.select(F.col("id").alias(id_col), F.col("keeper").alias(f"first_{id_col}"), "spans", (F.col("id") != F.col("keeper")).alias("removed"))


def without(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans, and the white space after them."""
    places = [m.span() for m in _WORD.finditer(text)]
    if len(places) != len(text.split()):  # a few control characters separate words for split alone
        places, at = [], 0
        for w in text.split():
            at = text.index(w, at)
            places.append((at, at + len(w)))
            at += len(w)
    kept, at = [], 0
    for span in spans:
        if span["start"] >= len(places):
            break
        kept.append(text[at : places[span["start"]][0]])
        at = places[span["end"]][0] if span["end"] < len(places) else len(text)
    return "".join(kept) + text[at:]


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", length: int = LENGTH, run: int = RUN) -> DataFrame:
    """``docs`` without the passages that a document of lesser id has."""
    key, cuts = fresh(docs, "key"), fresh(docs, "cuts")
    gone = merged(repeats(docs, id_col, text_col, length, run).where("id <> keeper"), "id").select(F.col("id").alias(key), F.col("spans").alias(cuts))
    joined = docs.join(gone, docs[id_col] == gone[key], "left").drop(key)
    place, schema = docs.columns.index(text_col), docs.schema
    sized = docs.columns.index(size_col) if size_col in docs.columns else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1)
            columns, names = batch.columns[:-1], batch.schema.names[:-1]
            if spans.null_count < len(spans):
                texts = columns[place].to_pylist()
                sizes = columns[sized].to_pylist() if sized is not None else None
                keep = [True] * len(texts)
                for k, own in enumerate(spans.to_pylist()):
                    if own:
                        texts[k] = without(texts[k], own)
                        keep[k] = bool(texts[k].strip())
                        if sizes:
                            sizes[k] = len(texts[k])
                columns[place] = pa.array(texts, type=columns[place].type)
                if sizes:
                    columns[sized] = pa.array(sizes, type=columns[sized].type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(apply, schema)
