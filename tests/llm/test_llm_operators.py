"""The ten operators against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import ann, bpe, media, mixing, near_dedup, registry, sharding, suffix_dedup, token_counts, token_output, toxicity
from tallyloom.llm.common import WordHashes, shingles

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 9))) for _ in range(800)]

#: Columns whose names operators use inside or put out.
CLASH = "id long, text string, key string, run int, slot string, shard string, copy string, spans string, score string, a int, b int, rank int, window string, keeper int, token_ids string, n_tokens string, digest string"
#: Names that operators have used, or use, for columns of their own.
CLASH += ", __row int, __n int, __id int, __u string, __cdf string, __source string, __order string, __spans string, __slot int, s string, u string, n int, cdf string, order string, gone int, place int, cuts string, salt int, h int, g int, words string, id_ int, key_ int, n_ int, check int"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns of clashing names beside doc_id and text."""
    base, long = prose(120, 1), prose(30_000, 2)
    rows = [
        (1, base), (2, base), (2, base), (3, base + " tail words"), (4, None), (5, ""), (6, "   "), (7, "one"), (8, "one"), (None, base), (None, None), (9, long), (10, long + " x"),
        (11, "é" * 70_000), (12, prose(60, 3)), (13, prose(20, 4) + " " + prose(60, 3) + " " + prose(20, 5)), (14, "same same " * 200), (15, "\n\t x  y \n"), (16, prose(49, 3)),
    ]
    data = [(i, t, i if i is None else i % 2, None if i in (3, 7) else "src" + str((i or 0) % 3)) for i, t in rows]
    names = [c.split()[0] for c in CLASH.split(", ") if not c.startswith("text ")]
    kinds = [c for c in CLASH.split(", ") if not c.startswith("text ")]
    schema = "doc_id long, text string, lang int, source string, " + ", ".join(kinds)
    return spark.createDataFrame([(*d, *([None] * len(names))) for d in data], schema)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


# ---- 7, 2, 9: tokens


def reference_encoder():
    return token_output.encoder(bpe.DEFAULT_VOCAB)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 's\n\t'réx1.!日 "), max_size=60))
def test_bpe_equals_library(text):
    ids, counts = bpe.part_cache(bpe.DEFAULT_VOCAB).encode([text])
    assert ids.tolist() == reference_encoder().encode_ordinary(text) and counts[0] == len(ids)


def test_bpe_long_words_and_cache_turnover(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 50)
    cache = bpe.PartCache(bpe.Vocabulary(bpe.DEFAULT_VOCAB))
    for text in ["ab" * 4000, prose(500, 8), "é" * 3000, prose(500, 9)]:
        ids, _ = cache.encode([text])
        assert ids.tolist() == reference_encoder().encode_ordinary(text)
        assert cache.vocab.decode(ids).decode() == text


def test_bpe_operator(spark, awkward, empty):
    rows = bpe.encode(awkward, verify=True).collect()
    assert len(rows) == awkward.count()
    texts = Counter((r["doc_id"], None if r["text"] is None else tuple(reference_encoder().encode_ordinary(r["text"]))) for r in awkward.collect())
    assert Counter((r["doc_id"], None if r["token_ids"] is None else tuple(r["token_ids"])) for r in rows) == texts
    assert {r["round_trip"] for r in rows if r["token_ids"] is not None} == {True} and all(r["round_trip"] is None and r["n_tokens"] is None for r in rows if r["token_ids"] is None)
    back = bpe.decode(bpe.encode(awkward)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((r["doc_id"], r["text"]) for r in awkward.collect())
    assert bpe.encode(empty).count() == 0
    with pytest.raises(ValueError, match="vocabulary"):
        bpe.part_cache(bpe.DEFAULT_VOCAB).vocab.decode(np.array([10**6]))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 's\n'réx1.!日 "), max_size=400), st.lists(st.tuples(st.integers(-2, 420), st.integers(0, 60), st.text(alphabet=st.sampled_from("a 's\n.1r"), max_size=40)), max_size=4))
def test_edited_counts(text, edits):
    cache = bpe.part_cache(bpe.DEFAULT_VOCAB)
    ((chars, ids),) = cache.words([text])
    tree = token_counts.WordTree(chars, ids)
    for start, length, new in edits:
        text, _ = token_counts.apply_edit(text, tree, start, start + length, new, cache)
        assert tree.n_tokens == len(reference_encoder().encode_ordinary(text)) and tree.n_chars == len(text)


class Counting:
    """A cache that only counts words of edits; it can't encode texts."""

    def __init__(self, cache):
        self.pattern, self.cache, self.n = cache.pattern, cache, 0

    def count_word(self, word):
        self.n += 1
        return self.cache.count_word(word)


def test_stored_trees_are_edited_without_encoding():
    """Two batches of edits, each from the stored tree of the last: only ``n_reencoded`` words are encoded."""
    cache, r = bpe.part_cache(bpe.DEFAULT_VOCAB), random.Random(4)
    text = prose(20_000, 6)
    ((chars, ids),) = cache.words([text])
    chars, ids = token_counts.pack(chars), token_counts.pack(ids)
    for _ in range(2):
        counting = Counting(cache)
        edits = [{"start": (a := r.randrange(len(text))), "end": a + r.randrange(30), "replacement": prose(r.randrange(4), a)} for _ in range(5)]
        text, tree, before, again = token_counts.edit_document(text, chars, ids, edits, counting)
        chars, ids = map(token_counts.pack, tree.leaves())
        assert counting.n == again < 120 and tree.n_tokens == len(reference_encoder().encode_ordinary(text)) == token_counts.unpack(ids).sum()


def test_trees_as_a_table(spark, awkward, empty):
    stored = token_counts.with_trees(awkward.withColumn("word_ids", F.lit("x")))
    assert stored.columns == [*awkward.columns, "word_chars", "word_ids"]
    assert Counter((r["doc_id"], r["text"]) for r in stored.collect()) == Counter((r["doc_id"], r["text"]) for r in awkward.collect())
    edit = lambda new: F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end"), F.lit(new).alias("replacement")))
    once = token_counts.update(stored, edit("é x"))
    twice = token_counts.update(once, edit("'re")).collect()
    change = lambda t, new: t[:2] + new + t[4:]
    want = Counter((r["doc_id"], None if r["text"] is None else (t := change(change(r["text"], "é x"), "'re")), None if r["text"] is None else len(reference_encoder().encode_ordinary(t))) for r in awkward.collect())
    assert Counter((r["doc_id"], r["text"], r["n_tokens_edited"]) for r in twice) == want
    assert all(r["n_reencoded"] < 12 for r in twice if r["text"] is not None) and all(r["word_ids"] is None for r in twice if r["text"] is None)
    assert token_counts.update(token_counts.with_trees(empty), edit("x")).count() == 0


def test_edited_counts_touch_little(spark, awkward, empty):
    edits = F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("end"), F.lit("zz").alias("replacement")), F.lit(None).cast("struct<start:int,end:int,replacement:string>"), F.struct(F.lit(None).cast("int").alias("start"), F.lit(5).alias("end"), F.lit("q").alias("replacement")))
    rows = token_counts.count_edited(awkward, edits).collect()
    want = Counter((r["doc_id"], None if r["text"] is None else len(reference_encoder().encode_ordinary(r["text"][:3] + "zz" + r["text"][5:]))) for r in awkward.collect())
    assert Counter((r["doc_id"], r["n_tokens_edited"]) for r in rows) == want
    long = next(r for r in rows if r["doc_id"] == 9)
    assert long["n_words"] == 30_000 and long["n_reencoded"] < 10
    table = spark.createDataFrame([(9, 1, 0, 0, "a "), (9, 0, 0, 10, None), (12, 0, 1, 2, "b")], "doc_id long, seq int, start int, end int, replacement string")
    joined = token_counts.attach_edits(awkward, table)
    assert joined.where("doc_id = 9").first()["edits"][0]["end"] == 10
    assert token_counts.count_edited(joined, F.col("edits")).count() == awkward.count()
    assert token_counts.count_edited(empty, edits).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=600))
def test_elias_fano(steps):
    values = np.cumsum(steps)
    code = token_output.EliasFano.encode(values)
    again = token_output.EliasFano(len(code), code.low_bits, *code.parts())
    assert again.all().tolist() == values.tolist() and [again[k] for k in range(len(again))] == values.tolist()
    if len(values) > 50:
        assert code.n_bytes * 8 <= len(values) * (3 + math.log2(max(2, values[-1] / len(values) + 1))) + 16


def test_elias_fano_select_is_stored_and_small():
    """Even and very uneven documents: the stored structures suffice, and take little."""
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(0, 2000, 100_000), np.where(rng.random(100_000) < 1e-3, 10**6, 0), np.r_[np.zeros(50_000, int), 10**8, np.ones(300, int)]):
        values = np.cumsum(lengths)
        code = token_output.EliasFano.encode(values)
        again = token_output.EliasFano(len(code), code.low_bits, *code.parts())
        some = [0, 1, 255, 256, 257, len(values) - 1, *rng.integers(0, len(values), 500).tolist()]
        assert [again[k] for k in some] == values[some].tolist()
        # 8 bytes a document in a table
        assert code.n_bytes <= 0.4 * 8 * len(values) and again.select.nbytes + again.sparse.nbytes <= 0.2 * code.n_bytes + 1100 * again.n_sparse
        # whatever is held is stored
        assert sum(x.nbytes for x in vars(again).values() if isinstance(x, np.ndarray)) == code.n_bytes


def test_blocks_of_very_long_texts(spark):
    """Runs that exhaust the library's splitter, and both ways of encoding."""
    texts = [" " * 2_000_000, "x" + " " * 1_000_000 + "y", "\n" * 300_000, prose(60_000, 4), prose(20, 5)]
    blocks = token_output.write_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    vocab = bpe.part_cache(bpe.DEFAULT_VOCAB).vocab
    got = {r["doc_id"]: r["token_ids"] for r in token_output.read_documents(blocks).collect()}
    assert {k: vocab.decode(np.array(v)).decode() for k, v in got.items()} == dict(enumerate(texts))
    assert got[3] == reference_encoder().encode_ordinary(texts[3]) and got[4] == reference_encoder().encode_ordinary(texts[4])


def test_blocks(awkward, empty):
    blocks = token_output.write_blocks(awkward, block_ids=1000)
    back = token_output.read_documents(blocks).collect()
    want = Counter((r["doc_id"], tuple(reference_encoder().encode_ordinary(r["text"]))) for r in awkward.collect() if r["text"] is not None)
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in back) == want
    row = next(b for b in blocks.collect() if 12 in b["doc_ids"]).asDict()
    assert token_output.document(row, row["doc_ids"].index(12)).tolist() == reference_encoder().encode_ordinary(prose(60, 3))
    assert token_output.write_blocks(empty).count() == 0
    with pytest.raises(ValueError, match="decrease"):
        token_output.EliasFano.encode(np.array([3, 2]))


# ---- 1: toxicity


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 6, 9):
        e, t, s = rng.normal(size=n) * 2, rng.normal(size=(2, 2)), 0.3
        total, mean, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(e[k] for k in range(n) if y[k]) + s * y[0] + sum(t[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            mean += w * np.array(y)
            for k in range(1, n):
                pairs[y[k - 1], y[k]] += w
        p, x = toxicity.marginals(e, np.array([n]), t, s, pairs=True)
        assert np.allclose(p, mean / total) and np.allclose(x, pairs / total)


def test_marginals_over_blocks_equal_recursion():
    rng = np.random.default_rng(1)
    counts, t, s = np.array([300, 64, 1, 635, 128]), rng.normal(size=(2, 2)), -0.4
    e = rng.normal(size=counts.sum())
    got, _ = toxicity.marginals(e, counts, t, s)
    want, at = [], 0
    for c in counts:
        own, at = e[at : at + c], at + c
        alpha, beta = [np.array([1, math.exp(own[0] + s)])], [np.ones(2)]
        for k in range(1, c):
            v = (alpha[-1] @ np.exp(t)) * np.array([1, math.exp(own[k])])
            alpha.append(v / v.sum())
        for k in range(c - 1, 0, -1):
            v = np.exp(t) @ (np.array([1, math.exp(own[k])]) * beta[-1])
            beta.append(v / v.sum())
        want += [x[1] * y[1] / (x @ y) for x, y in zip(alpha, beta[::-1])]
    assert np.allclose(got, want)


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    r = random.Random(11)
    bad = ["vileword", "nastyone", "foulterm"]
    rows, labels = [], []
    for i in range(400):
        words = prose(r.randrange(20, 80), 100 + i).split()
        toxic = i % 4 == 0
        if toxic:
            for w in r.sample(bad, 2):
                words.insert(r.randrange(len(words)), w.capitalize() + r.choice(["", ",", "!"]))
        rows.append((i, " ".join(words)))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark, toxic_corpus, awkward, empty):
    docs, labels = toxic_corpus
    chain = toxicity.train(docs, labels)
    rows = {r["doc_id"]: r for r in toxicity.tag(docs, chain).collect()}
    held = range(300, 400)
    found = {i for i in held if rows[i]["score"] >= toxicity.THRESHOLD}
    assert found == {i for i in held if i % 4 == 0}
    text = dict(docs.collect())
    for i in found:
        words = {text[i][s["start"] : s["end"]].strip(",!").lower() for s in rows[i]["spans"]}
        assert words and words <= {"vileword", "nastyone", "foulterm"} | {f"{a} {b}" for a in ("vileword", "nastyone", "foulterm") for b in ("vileword", "nastyone", "foulterm")} or all(any(b in w for b in ("vile", "nasty", "foul")) for w in words)
    kept = toxicity.reject(docs, chain)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect() if r["doc_id"] >= 300} == {i for i in held if i % 4}
    assert toxicity.tag(awkward, chain).count() == awkward.count() and toxicity.tag(awkward, chain).where("score > 0.9").count() == 0
    assert Counter(map(tuple, toxicity.reject(awkward, chain).collect())) == Counter(map(tuple, awkward.collect()))
    assert toxicity.tag(empty, chain).count() == 0


def test_spans_and_scores_equal_enumeration(spark, toxic_corpus):
    """The operator's whole result on short documents, by summing over all taggings."""
    docs, labels = toxic_corpus
    chain = toxicity.train(docs, labels)
    r = random.Random(2)
    texts = [" ".join(r.choice([*WORDS[:20], "vileword", "Nastyone,", "foulterm!"]) for _ in range(r.randrange(1, 11))) for _ in range(60)]
    got = {x["doc_id"]: x for x in toxicity.tag(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chain).collect()}
    for i, text in enumerate(texts):
        words = text.split()
        e, total, p = [chain.emission(w) for w in words], 0.0, np.zeros(len(words))
        for y in itertools.product((0, 1), repeat=len(words)):
            w = math.exp(sum(v for v, tag in zip(e, y) if tag) + chain.start * y[0] + sum(chain.transitions[a, b] for a, b in itertools.pairwise(y)))
            total += w
            p += w * np.array(y)
        p /= total
        assert math.isclose(got[i]["score"], p.max(), abs_tol=1e-9) and math.isclose(got[i]["toxic_tokens"], p.sum(), abs_tol=1e-9)
        want, at = [], 0
        for k, w in enumerate(words):
            at = text.index(w, at)
            if p[k] >= toxicity.THRESHOLD:
                if want and want[-1][2] == k - 1:
                    want[-1] = (want[-1][0], at + len(w), k)
                else:
                    want.append((at, at + len(w), k))
            at += len(w)
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == [w[:2] for w in want]


def test_token_labels_equal_brute_force():
    r = random.Random(12)
    docs = [([r.choice("abcdefg") for _ in range(r.randrange(1, 12))] + ["x"] * (k % 5 == 0) + [r.choice("abc")], int(k % 5 == 0)) for k in range(60)]
    toxic, clean = [set(w) for w, t in docs if t], [set(w) for w, t in docs if not t]
    bad = set()
    for v in set().union(*toxic):
        odds = math.log((sum(v in d for d in toxic) + 0.5) / (len(toxic) + 1)) - math.log((sum(v in d for d in clean) + 0.5) / (len(clean) + 1))
        around = {(w[k - 1] if k else "", w[k + 1] if k + 1 < len(w) else "") for w, t in docs if t for k in range(len(w)) if w[k] == v}
        if odds >= 2.5 and len(around) >= 4:
            bad.add(v)
    assert bad == {"x"}
    assert [x.tolist() for x in toxicity.label_tokens(docs)] == [[bool(t) and v in bad for v in w] for w, t in docs]


def test_few_toxic_labels_teach_nothing(spark):
    """Words of fewer than four contexts are no evidence."""
    rows = [(k, prose(30, k) + (" vileword" if k < 3 else "")) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 3)) for k in range(40)], "doc_id long, toxic int")
    assert toxicity.reject(docs, toxicity.train(docs, labels)).count() == 40


def test_toxicity_without_labels(spark, toxic_corpus):
    docs, labels = toxic_corpus
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    for none in (labels.where("false"), labels.where("toxic = 0"), odd):
        assert toxicity.tag(docs, toxicity.train(docs, none)).where(F.col("score") >= toxicity.THRESHOLD).count() == 0


# ---- 3: near duplicates


def brute_groups(rows, params=near_dedup.Params()):
    words = WordHashes()
    sets = {}
    for i, t in rows:
        h = words.of((t or "").split())
        h = h[h != 0]
        if i is not None and len(h):
            sets.setdefault(i, []).append(set(shingles(h, params.k).tolist()))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        for a, b in itertools.product(sets[i], sets[j]):
            small, large = sorted((a, b), key=len)
            if len(large) <= params.ratio * len(small) and len(small & large) >= params.t * len(small) and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in sets if find(i) != i}


def test_banding_reaches_its_recall():
    p = near_dedup.Params()
    for part in range(25):
        for target in (part, part + 1):
            bands, rows = p.banding(part, target)
            assert bands * rows <= p.perms and 1 - (1 - p.jaccard(part, target) ** rows) ** bands >= p.recall - 1e-9
    low, high = p.bounds(7)
    assert p.partition(low) == p.partition(high) == 7 and p.partition(high + 1) == 8


def brute_parts(rows, roots, params=near_dedup.Params()):
    """(root, head) of the classes that go with a container's, from classes as ``brute_groups`` gives them."""
    words = WordHashes()
    sets = defaultdict(list)
    for i, t in rows:
        h = words.of((t or "").split())
        h = h[h != 0]
        if i is not None and len(h):
            sets[i].append(set(shingles(h, params.k).tolist()))
    most = Counter()
    for i, own in sets.items():
        r = roots.get(i, i)
        most[r] = max(most[r], max(map(len, own)))
    owners = defaultdict(set)
    for i, own in sets.items():
        for x in set().union(*own):
            owners[x].add(i)
    heads = {}
    for i in (i for i in sets if i not in roots):
        for a in sets[i]:
            for j in set().union(*(owners[x] for x in a)) - {i}:
                if any(len(b) > params.ratio * len(a) and len(a & b) >= params.t * len(a) for b in sets[j]) and most[roots.get(j, j)] > most[i]:
                    heads.setdefault(i, set()).add(roots.get(j, j))
    return heads


def gone(rows):
    """The documents that near-duplicate detection takes away."""
    roots = brute_groups(rows)
    return set(roots) | set(brute_parts(rows, roots))


def test_near_duplicates(spark, awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = {r["doc_id"]: r for r in near_dedup.duplicates(awkward).collect()}
    want = brute_groups(rows)
    heads = brute_parts(rows, want)
    assert heads == {12: {13}} and set(got) == set(want) | {12}
    assert {i: r["kept_doc_id"] for i, r in got.items()} == {i: 13 if k == 12 else k for i, k in (want | {12: 12}).items()}
    assert {i for i, r in got.items() if r["part"]} == {12, 16}
    assert want[2] == 1 and want[3] == 1 and want[8] == 7 and want[10] == 9 and want[16] == 12 and got[12]["kept_doc_id"] == 13
    kept = near_dedup.keep_one(awkward)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == awkward.columns and ids[None] == 2 and ids[1] == 1 and ids[2] == ids[3] == 0 and ids[4] == ids[5] == ids[6] == 1
    assert near_dedup.duplicates(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0


@pytest.mark.parametrize("filtered", [True, False])
def test_parts_of_larger_documents(spark, monkeypatch, filtered):
    """Documents contained in others of 1.6 to 100 times their size, whole and with edits, and a line that many share and one consists of."""
    if not filtered:
        monkeypatch.setattr(near_dedup, "FILTER_BYTES", 0)
    r, line, rows = random.Random(8), prose(12, 77), []
    for n, times in enumerate([1.6, 2, 3, 5, 10, 30, 100] * 6):
        small = prose(r.choice([5, 20, 60, 200]), 1000 + n).split()
        large = prose(int(times * len(small)) + 2, 2000 + n).split()
        at = r.randrange(len(large) - len(small))
        copy = list(small)
        for _ in range(n % 3 * len(small) // 40):
            copy[r.randrange(len(copy))] = "edited"
        large[at : at + len(small)] = copy
        rows += [(10 * n + n % 2, " ".join(small)), (10 * n + 1 - n % 2, " ".join(large))]
    rows += [(1000 + n, prose(200, 3000 + n) + " " + line) for n in range(40)] + [(1100, line), (1101, line + " end"), (1102, prose(9, 5) + " " + line)]
    got = {x["doc_id"]: x for x in near_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    roots = brute_groups(rows)
    heads = brute_parts(rows, roots)
    assert len(heads) > 30 and {1101: 1100}.items() <= roots.items() and 1100 in heads and not any(1000 <= i < 1100 for i in roots)
    found = {i for i, x in got.items() if x["part"] and i not in roots}
    assert found <= set(heads) and len(found) >= 0.97 * len(heads)
    assert all(got[i]["kept_doc_id"] in heads[i] and got[i]["n_links"] > 0 for i in found) and got[1101]["kept_doc_id"] == got[1100]["kept_doc_id"]


def test_every_target_of_a_kind_is_asked(spark):
    """Seven targets hold the 16 hashes that a part looks up; only one that is neither the largest, the first nor the last holds the part."""
    part, p = prose(120, 71).split(), near_dedup.Params()
    runs = shingles(WordHashes().of(part), 3)
    asked = " ".join(" ".join([*part[k : k + 3], f"gap{k}"]) for k in np.argsort(runs)[: p.sample])
    rows = [(50, " ".join(part))] + [(n, asked + " " + prose(400 + 10 * n, 500 + n)) for n in (10, 20, 30, 60, 70, 80)]
    rows += [(40, prose(300, 540) + " " + " ".join(part))]
    got = {x["doc_id"]: (x["kept_doc_id"], x["part"], x["n_links"]) for x in near_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(runs.tolist())) > p.whole and got == {50: (40, True, 1)} and brute_parts(rows, {}) == {50: {40}}


def test_every_container_is_a_link(spark, monkeypatch):
    """Parts that look up all of their hashes and parts that look up some, each in 12 containers and one equal to the first; the cells of pairs are split."""
    monkeypatch.setattr(near_dedup, "_HELD", 700)
    rows = []
    for g, n in enumerate((12, 150)):
        part = prose(n, 90 + g)
        rows += [(1000 * g + 7, part)] + [(1000 * g + 20 + k, prose(2 * n, 1000 * g + k) + " " + part) for k in range(12)]
        rows += [(1000 * g + 90, rows[-12][1])]
    got = {x["doc_id"]: (x["kept_doc_id"], x["part"], x["n_links"]) for x in near_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {7: (20, True, 12), 90: (20, False, 0), 1007: (1020, True, 12), 1090: (1020, False, 0)}


def test_parts_times_containers_are_not_made(spark, monkeypatch):
    """A line, with words of their own, that 40 documents consist of and 120 have: every link counts, and no table has them all."""
    most, cut = [], near_dedup.cut

    def counted(*args, **kwargs):
        out = cut(*args, **kwargs)
        if {"b", "ask"} <= set(out.columns) or {"a", "b"} <= set(out.columns):
            most.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "cut", counted)
    line, words = prose(18, 77), [prose(3, 600 + n) for n in range(40)]
    # the words that each has beside the line are in another text as well
    rows = [(n, words[n] + " " + line) for n in range(40)] + [(1000 + n, prose(120, 3000 + n) + " " + line) for n in range(120)] + [(2000 + n, prose(60, 4000 + n) + " " + words[n]) for n in range(40)]
    got = {x["doc_id"]: (x["kept_doc_id"], x["part"], x["n_links"]) for x in near_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert brute_parts(rows, brute_groups(rows)) == {0: set(range(1000, 1120))}
    assert set(got) == set(range(40)) and all(x[:2] == (1000, True) and x[2] > 120 for x in got.values())
    assert max(most) < 40 * 120 / 2


def test_texts_that_share_half_are_not_paired(spark, monkeypatch):
    """150 texts of which half is one passage, and two copies among them: those that left with a leader in vain are not all paired."""
    asked, verify = [], near_dedup.verify

    def counted(pairs, *args, **kwargs):
        asked.append(pairs.distinct().count())
        return verify(pairs, *args, **kwargs)

    monkeypatch.setattr(near_dedup, "verify", counted)
    passage = prose(70, 77)
    rows = [(n, prose(50, 5000 + n) + " " + passage) for n in range(150)]
    rows += [(200, rows[7][1] + " one more")]
    got = {x["doc_id"]: x["kept_doc_id"] for x in near_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows) == {200: 7} and sum(asked[1:]) < 1000


def test_hot_bucket_of_unlike_rows():
    """One bucket of 20,000 rows that are no copies of each other."""
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 2**63, size=(20_000, 2)).astype(np.uint64)
    began = time.monotonic()
    found, stay = near_dedup._lead(sig, np.full(20_000, 300), near_dedup.Params(), 0.16)
    assert time.monotonic() - began < 60 and len(stay) == 20_000 - sum(int(x.sum()) for _, _, x in found)


def test_signatures_of_other_widths(spark):
    base = prose(300, 1).split()
    rows = [(1, " ".join(base)), (2, " ".join(base[:290])), (3, prose(300, 2))]
    for perms in (32, 100):
        params = near_dedup.Params(perms=perms)
        sig = [near_dedup.sketch(np.unique(shingles(WordHashes().of(t.split()), 3)), params, near_dedup._seeds(perms))[1] for _, t in rows]
        assert near_dedup.agreement(np.stack(sig), sig[0], perms)[2] < 0.25
        assert [(r["doc_id"], r["kept_doc_id"]) for r in near_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string"), params=params).collect()] == [(2, 1)]


def test_who_is_refused_goes_back_to_its_bucket(spark, monkeypatch):
    """Signatures say that all are alike; the texts are two kinds."""
    kinds = [prose(100, 1), prose(100, 2)]
    rows = [(i, kinds[i % 2] + f" {i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    params = near_dedup.Params()
    reps = spark.createDataFrame([(i, bytes([i]), [5], [1, 2], 100) for i, _ in rows], "id long, content binary, keys array<bigint>, sig array<bigint>, size int")
    roots = {r["node"]: r["root"] for r in near_dedup.components(near_dedup.copies(reps, docs, "doc_id", "text", params)).collect()}
    assert roots == {i: i % 2 for i in range(2, 12)}


def test_near_duplicates_of_many_copies(spark):
    r = random.Random(3)
    rows = []
    for g in range(6):
        base = prose(200, 50 + g).split()
        for c in range(40):
            words = list(base)
            for _ in range(r.randrange(0, 6)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            rows.append((g * 1000 + c, " ".join(words)))
    rows += [(10_000 + k, prose(150, 900 + k)) for k in range(200)]
    got = {r["doc_id"]: r["kept_doc_id"] for r in near_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_groups(rows)
    assert sum(got.get(i) == k for i, k in want.items()) >= 0.98 * len(want) and set(got) <= set(want)


def test_components(spark):
    edges = [(2, 1), (3, 2), (4, 3), (9, 8), (8, 7), (20, 10), (21, 20), (21, 9)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 8: 7, 9: 7, 10: 7, 20: 7, 21: 7}


def test_leaders_across_batches(spark):
    """A bucket of more rows than a batch holds is one bucket, and leaders of parts of it meet."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        bands = spark.range(50).select(F.lit(5).cast("bigint").alias("key"), "id", F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")).alias("sig"), F.lit(100).alias("size"), F.lit(None).cast("bigint").alias("other"), F.lit(None).cast("boolean").alias("leaves"))
        whole = near_dedup.led_pairs(bands.coalesce(1).sortWithinPartitions("key", "id"), near_dedup.Params(), "bigint").collect()
        parts = near_dedup.led_pairs(bands.repartition(4).sortWithinPartitions("key", "id"), near_dedup.Params(), "bigint")
        met = near_dedup.led_pairs(parts.repartition(1).sortWithinPartitions("key", "id"), near_dedup.Params(), "bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["id"], r["other"]) for r in whole if r["other"] is not None) == [(k, 0) for k in range(1, 50)]
    assert [r["id"] for r in whole if r["other"] is None] == [0]
    assert sorted(r["id"] for r in met if r["other"] is not None) == list(range(1, 50)) and [r["id"] for r in met if r["other"] is None] == [0]


# ---- 8: repeated passages


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(text):
    sa = suffix_dedup.suffix_array(text)
    assert sa == sorted(range(len(text)), key=lambda i: text[i:])
    lcp = suffix_dedup.common_prefixes(text, sa)
    for k in range(1, len(sa)):
        a, b = text[sa[k - 1] :], text[sa[k] :]
        assert lcp[k] == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_repeats(rows, n):
    owners = defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        if i is not None:
            for k in range(len(w) - n + 1):
                owners[tuple(w[k : k + n])].add(i)
    out = defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        if i is not None:
            for k in range(len(w) - n + 1):
                own = owners[tuple(w[k : k + n])]
                if len(own) > 1:
                    out[i, min(own)].update(range(k, k + n))
    return dict(out)


def covered(found):
    out = defaultdict(set)
    for i, keeper, a, b in found:
        out[i, keeper].update(range(a, b))
    return dict(out)


def test_repeats(spark, awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert covered(suffix_dedup.repeats(awkward).collect()) == brute_repeats(rows, 50)
    out = suffix_dedup.passages(awkward).where("doc_id = 13").first()
    assert out["first_doc_id"] == 12 and out["removed"] and [tuple(s) for s in out["spans"]] == [(20, 80)]
    left = {(r["doc_id"], r["text"]) for r in suffix_dedup.remove(awkward).collect()}
    assert (13, prose(20, 4) + " " + prose(20, 5)) in left and (3, "tail words") in left and not any(i == 2 for i, _ in left)
    assert {i for i, _ in left} == {i for i, _ in rows} - {2}
    assert suffix_dedup.passages(empty).count() == 0 and suffix_dedup.remove(empty).count() == 0


def mixed_texts():
    r = random.Random(1)
    pool = [prose(70, 300 + k) for k in range(4)]
    return [(i, " ".join([prose(r.randrange(0, 30), 400 + i), r.choice(pool), prose(r.randrange(0, 9), 500 + i), r.choice(pool), "la " * r.choice([0, 40, 90])])) for i in range(60)]


@pytest.mark.parametrize("hot,windows", [(0, 2000), (0, 1), (3, 3), (10**9, 1)])
def test_repeats_of_hot_runs(spark, monkeypatch, hot, windows):
    """All runs hot, some, or none; buckets beyond an array: the result is the same."""
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(suffix_dedup, "ARRAY_WINDOWS", windows)
    rows = mixed_texts() + [(100 + i, prose(40, 700 + i) + " " + prose(47, 1) + " " + prose(40, 800 + i % 7)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert covered(suffix_dedup.repeats(docs).collect()) == brute_repeats(rows, 50)


def test_boilerplate_of_very_many_documents(spark):
    """One passage in 50,000 documents, between words of their own."""
    own = lambda k: F.array_join(F.transform(F.sequence(F.lit(k), F.lit(k + 29)), lambda i: F.substring(F.md5(F.concat_ws(":", "id", i)), 1, 14)), " ")
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", own(1), F.lit(prose(60, 9)), own(40)).alias("text"))
    began = time.monotonic()
    got = suffix_dedup.passages(docs).select("doc_id", "first_doc_id", F.explode("spans").alias("s"), "removed").groupBy("first_doc_id", "s", "removed").count().collect()
    assert sorted((r["first_doc_id"], tuple(r["s"]), r["removed"], r["count"]) for r in got) == [(0, (30, 90), False, 1), (0, (30, 90), True, 49_999)]
    assert time.monotonic() - began < 120


def test_repeats_of_mixed_and_periodic_texts(spark):
    rows = mixed_texts()
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    for length, run in ((50, 8), (12, 3)):
        assert covered(suffix_dedup.repeats(docs, length=length, run=run).collect()) == brute_repeats(rows, length)
    after = suffix_dedup.remove(docs).collect()
    assert all(x["n_chars"] == len(x["text"]) for x in after)
    # what is left of a document is what no lesser one has; cuts may join words to new passages, which the next pass would find
    want = {}
    for (i, k), words in brute_repeats(rows, 50).items():
        if i != k:
            want.setdefault(i, set()).update(words)
    texts = dict(rows)
    left = {i: [w for k, w in enumerate(texts[i].split()) if k not in want.get(i, ())] for i in texts}
    assert {x["doc_id"]: x["text"].split() for x in after} == {i: w for i, w in left.items() if w} and want


# ---- 4: sharding


def test_sharding(spark, awkward, empty):
    sizes = {r["slot"]: (r["n_docs"], r["n_bytes"]) for r in sharding.slot_bytes(awkward, slots=64).collect()}
    want = defaultdict(lambda: [0, 0])
    for r in awkward.collect():
        s = int(hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:8], 16) % 64
        want[s][0] += 1
        want[s][1] += len((r["text"] or "").encode())
    assert sizes == {s: tuple(v) for s, v in want.items()}
    slot_map = sharding.balanced(awkward, 4, 6, slots=64)
    out = sharding.assign(awkward, slot_map, versions={"v1": 1, "v3": 3})
    assert out.count() == awkward.count() and out.where("v1 is null or v3 is null").count() == 0
    assert all(r["v1"] == slot_map.at(1)[int(r["slot"])] and r["v3"] == slot_map.at(3)[int(r["slot"])] for r in out.collect())
    assert sharding.assign(awkward, slot_map).schema["shard"].dataType.simpleString() == "int"
    assert sharding.balanced(empty, 4, 6, slots=64).at() == sharding.balanced(empty, 4, 6, slots=64).at() and sharding.assign(empty, slot_map).count() == 0
    assert slot_map.log(spark).where("version = 1").count() == 64


def test_rebalance():
    r = random.Random(2)
    sizes = {s: r.randrange(1, 1000) for s in range(4096)}
    sizes[7] = 20_000
    m = sharding.SlotMap(4096, 64)
    moved = m.rebalance(sizes)
    load = Counter()
    for s, k in enumerate(m.at(2)):
        load[k] += sizes[s]
    mean = sum(sizes.values()) / 64
    assert max(load.values()) <= 1.02 * mean and len(moved) < 1000 and set(moved) == {s for s in range(4096) if m.at(1)[s] != m.at(2)[s]}
    gone = m.rebalance(sizes, 60)
    assert max(m.at()) == 59 and all(m.at(2)[s] == m.at(3)[s] for s in range(4096) if s not in gone)
    with pytest.raises(ValueError, match="version"):
        m.at(9)


def test_slot_map_is_kept(spark, awkward, tmp_path):
    """The map is read again from its tables, version by version, and a later rebalancing edits it."""
    path = str(tmp_path / "map")
    made = sharding.balanced(awkward, 4, 6, slots=64, path=path)
    again = sharding.stored(spark, path)
    assert again.edits == made.edits and again.widths == [4, 4, 6] and again.shards == 6
    moved = sharding.rebalance_stored(spark, path, {5: 100, 6: 100}, 3)
    last = sharding.stored(spark, path)
    assert last.version == 4 and [last.at(v) for v in (1, 2, 3)] == [made.at(v) for v in (1, 2, 3)] and max(last.at()) == 2
    assert set(moved) == {s for s in range(64) if last.at(3)[s] != last.at(4)[s]}
    assert sharding.rebalance_stored(spark, path, {}) == {} and sharding.stored(spark, path).version == 5
    out = sharding.assign(awkward, sharding.stored(spark, path), versions={"v3": 3, "v5": 5})
    assert all(r["v3"] == made.at(3)[r["slot"]] and r["v5"] == last.at()[r["slot"]] for r in out.select("slot", "v3", "v5").collect())
    with pytest.raises(ValueError, match="has a slot map"):
        sharding.balanced(awkward, 4, 6, slots=64, path=path)
    with pytest.raises(ValueError, match="no slot map"):
        sharding.stored(spark, str(tmp_path / "none"))


# ---- 5: mixing


def draws(rows, weights=None, seed=42, temperature=0.7):
    chars = Counter()
    for _, t, s in rows:
        chars[s] += len(t or "")
    total = sum(chars.values())
    w = {s: ((n / total) ** temperature if n else 0.0) for s, n in chars.items()} if weights is None else {s: weights.get(s, 0.0) for s in chars}
    rate = {s: (w[s] / sum(w.values()) * total / n if n and sum(w.values()) else 1.0) for s, n in chars.items()}
    out = Counter()
    for i, t, s in rows:
        u = int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, math.exp(-rate[s]), math.exp(-rate[s])
        while c <= u and k < 500:
            k += 1
            p *= rate[s] / k
            c += p
        for j in range(k):
            out[i, t, s, j] += 1
    return out


@pytest.mark.parametrize("weights", [None, {"src0": 3.0, "src1": 1.0}])
def test_mixing(awkward, empty, weights):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()]
    got = Counter((r["doc_id"], r["text"], r["source"], r["copy"]) for r in mixing.replicate(awkward, weights=weights).collect())
    assert got == draws(rows, weights)
    assert mixing.replicate(empty).count() == 0 and set(mixing.replicate(awkward).columns) == set(awkward.columns)


def test_mixing_of_many_sources(awkward, monkeypatch):
    """Distributions too many to be sent: the same draws by a salted join."""
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 0)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()]
    assert Counter((r["doc_id"], r["text"], r["source"], r["copy"]) for r in mixing.replicate(awkward).collect()) == draws(rows)


def test_mixing_reaches_its_weights(spark):
    rows = [(i, "x" * 100, "big" if i % 10 else "small") for i in range(20_000)]
    out = mixing.replicate(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights={"big": 0.5, "small": 0.5})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 10_000) < 500 and abs(n["small"] - 10_000) < 500
    order = [r["doc_id"] for r in out.collect()]
    assert sum(a < b for a, b in itertools.pairwise(order)) / len(order) < 0.6


# ---- 6: nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 3
    x = (centres[rng.integers(0, 20, 900)] + rng.normal(size=(900, 16))).astype(np.float32)
    x[10] = x[11]
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)]
    odd = [(900, None), (901, []), (902, [1.0]), (903, [float("nan")] * 16), (904, [None] * 16), (None, rows[0][1]), rows[5]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = ann.neighbours(table.withColumn("id", F.lit(1)).withColumn("rank", F.lit("x")), shard_rows=250).collect()
    near = defaultdict(dict)
    for r in got:
        near[r["vec_id"]][r["rank"]] = (r["neighbour_vec_id"], r["distance"])
    assert set(near) == set(range(900)) and all(len(v) == 10 for v in near.values())
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    true = np.argsort(d, axis=1)[:, :10]
    assert np.mean([len({n for n, _ in near[i].values()} & set(true[i])) / 10 for i in range(900)]) >= 0.95
    assert near[10][1] == (11, 0.0) and near[11][1] == (10, 0.0)
    few = ann.neighbours(table.where("vec_id < 3")).collect()
    assert len(few) == 6
    assert ann.neighbours(table.where("false")).count() == 0 and ann.neighbours(table.where("vec_id = 1")).count() == 0
    some = ann.neighbours(table, shard_rows=250, every=50).collect()
    assert {(r["vec_id"], r["rank"]): (r["neighbour_vec_id"], r["distance"]) for r in some} == {(i, k): x for i in range(0, 900, 50) for k, x in near[i].items()}
    assert ann.neighbours(table.where("vec_id % 50 <> 0"), every=50).count() == 0


def test_neighbours_of_equal_vectors(spark):
    """Groups of 1 to 100 copies in shards of several; each copy's nearest are the other copies of least id, then the next vectors."""
    rng = np.random.default_rng(9)
    sizes = [3, 4, 5, 8, 10, 11, 12, 40, 100] + [1] * 300
    of = rng.permutation(np.repeat(np.arange(len(sizes)), sizes))
    x = rng.normal(size=(len(sizes), 64)).astype(np.float32)[of]
    x[of == 0, 0] = 0.0
    x[np.flatnonzero(of == 0)[0], 0] = -0.0
    table = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<float>")
    near = defaultdict(list)
    for r in sorted(ann.neighbours(table, shard_rows=150).collect(), key=lambda r: (r["vec_id"], r["rank"])):
        near[r["vec_id"]].append((r["neighbour_vec_id"], r["distance"]))
    hits = 0
    for i in range(len(x)):
        equal = [j for j in np.flatnonzero(of == of[i]).tolist() if j != i][:10]
        assert near[i][: len(equal)] == [(j, 0.0) for j in equal] and len(near[i]) == len({j for j, _ in near[i]}) == 10
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1, dtype=np.float64))
        d[i] = np.inf
        hits += len({j for j, _ in near[i]} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 10 * len(x)
    some = ann.neighbours(table, shard_rows=150, every=7).collect()
    assert {(r["vec_id"], r["rank"]): (r["neighbour_vec_id"], r["distance"]) for r in some} == {(i, k + 1): v for i in range(0, len(x), 7) for k, v in enumerate(near[i])}


def test_query_of_neighbours_has_its_recall(spark, sf_dir):
    """The registered query against brute force over all rows."""
    rows = registry.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["vec_id"] for r in rows])
    near = defaultdict(list)
    for r in registry.op6_ann(spark, sf_dir).collect():
        near[r["vec_id"]].append(r["distance"])
    assert set(near) == {int(i) for i in ids if i % 50 == 0}
    hits = 0
    for i, own in near.items():
        d = np.sort(np.sqrt(((x - x[ids == i]) ** 2).sum(axis=1))[ids != i])[:10]
        hits += sum(v <= d[-1] + 1e-4 for v in own)
    assert hits >= 0.95 * 10 * len(near)


# ---- 10: media


def test_hot_chunks(spark):
    """One chunk in all payloads, several times in each."""
    r = random.Random(1)
    rows = [(k, bytes(40_000) + bytes(r.randrange(256) for _ in range(500))) for k in range(30)]
    table = spark.createDataFrame(rows, "page_id long, html binary")
    out = media.rebuild(media.manifest(table), media.store(table)).collect()
    assert {r["page_id"]: bytes(r["payload"]) for r in out} == dict(rows) and all(r["verified"] for r in out)


def brute_cuts(data, least, bits, most):
    out, begin, h = [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + int(media._GEAR[byte])) & 0xFFFFFFFF
        n = i + 1 - begin
        if (n >= least and h >> (32 - bits) == 0) or n >= most or i == len(data) - 1:
            out.append(i + 1)
            begin = i + 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_cuts(data):
    assert media.cuts(data, 32, 5, 300) == brute_cuts(data, 32, 5, 300)


def test_media(spark):
    r = random.Random(6)
    shared = bytes(r.randrange(256) for _ in range(60_000))
    rows = [(1, shared), (2, shared), (3, b"head" + shared[:40_000]), (4, b""), (5, None), (6, shared[5000:]), (None, shared), (7, b"x"), (7, b"x"), (8, bytes(100_000))]
    table = spark.createDataFrame(rows, "page_id long, html binary").withColumn("digest", F.lit("d")).withColumn("id", F.lit(0))
    words = media.train_dictionary(table)
    for d in (b"", words):
        out = {r["page_id"]: r for r in media.rebuild(media.manifest(table), media.store(table, dictionary=d), dictionary=d).collect()}
        assert {k: bytes(v["payload"]) for k, v in out.items()} == {k: v for k, v in rows if k is not None and v is not None}
        assert all(v["verified"] for v in out.values()) and out[4]["n_chunks"] == 0
    # the store against brute force: every distinct chunk once, and nothing else
    pieces = {}
    for k, v in rows:
        if k is not None and v:
            at = 0
            for end in brute_cuts(v, media.LEAST, media.MASK_BITS, media.MOST):
                pieces[v[at:end]] = None
                at = end
    _, unpack = media._codec(b"")
    assert Counter(unpack(bytes(r["chunk"])) for r in media.store(table).collect()) == Counter(list(pieces))
    kept = media.store(table)
    stored = kept.agg(F.sum("size")).first()[0]
    assert stored < 0.45 * sum(len(v) for k, v in rows if k is not None and v)
    lost = kept.where("size <> 16384").limit(10**6)
    assert not all(r["verified"] for r in media.rebuild(media.manifest(table), lost.where("size > 3000")).collect())
    assert media.rebuild(media.manifest(table.where("false")), media.store(table.where("false"))).count() == 0
