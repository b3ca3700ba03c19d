"""Queries and the pipeline over the driver's smallest tables, against brute force."""

from __future__ import annotations

import os
import random
import uuid
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from test_llm_operators import brute_repeats, draws, gone, prose, reference_encoder

from tallyloom.llm import near_dedup, registry, suffix_dedup, toxicity
from tallyloom.llm.common import WordHashes, shingles, table


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "bpe"]


def test_run_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text", "source").collect()]
    chain = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    clean = [d for d, (p, _) in zip(docs, toxicity.score_texts(chain, [t for _, t, _ in docs])) if not len(p) or p.max() < toxicity.THRESHOLD]
    repeated = gone([(i, t) for i, t, _ in clean])
    one = [d for d in clean if d[0] not in repeated]
    spans = {}
    for (i, keeper), words in brute_repeats([(i, t) for i, t, _ in one], suffix_dedup.LENGTH).items():
        if i != keeper:
            spans.setdefault(i, set()).update(words)
    left = []
    for i, t, s in one:
        if i in spans:
            t = suffix_dedup.without(t, [{"start": k, "end": k + 1} for k in sorted(spans[i])])
        if t.strip():
            left.append((i, t, s))
    want = Counter()
    for (i, t, _, _), n in draws(left).items():
        want[i, tuple(reference_encoder().encode_ordinary(t))] += n
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in rows) == want
    assert all(r["round_trip"] for r in rows)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns


def test_stages_on_awkward_and_empty_documents(spark, sf_dir):
    """Null and repeated ids, null, empty, blank and long texts, and columns of clashing names, through all stages; each works on what the last one kept."""
    words = " ".join(f"w{k}" for k in range(120))
    rows = [(1, words), (2, words), (2, words), (None, words), (None, None), (3, None), (4, ""), (5, "  "), (6, "one"), (7, "x" * 50_000), (8, "zz " * 20_000), (9, "own words " + words)]
    names = "__id long, __row int, n string, gone string, place int, s string, cdf int, cuts int, salt int"
    base = spark.createDataFrame([(i, t, "en", "src" if (i or 0) % 2 else None, None if t is None else len(t), *[None] * 9) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    for docs in (base, base.where("false")):
        last = docs
        for name, stage in corpus_pipeline.STAGES:
            before, last = last, stage(spark, last, sf_dir)
            if name != "bpe":
                assert last.columns == docs.columns
            last = spark.createDataFrame(last.collect(), last.schema)
            if name in ("toxicity", "near_dedup", "suffix_dedup"):
                assert {r["doc_id"] for r in last.collect()} <= {r["doc_id"] for r in before.collect()}
            if name == "near_dedup" and docs is base:
                assert Counter(r["doc_id"] for r in last.collect()) == {1: 1, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1}
        assert all(r["round_trip"] for r in last.collect() if r["token_ids"] is not None) and (last.count() > 0) == (docs is base)


def test_a_part_of_one_document_among_alike_ones_goes(spark, sf_dir):
    """Seven documents hold the hashes that a part looks up, the one that holds the part is neither the largest, the first nor the last."""
    part = prose(120, 71).split()
    asked = " ".join(" ".join([*part[k : k + 3], f"gap{k}"]) for k in np.argsort(shingles(WordHashes().of(part), 3))[: near_dedup.Params().sample])
    rows = [(50, " ".join(part)), (40, prose(300, 540) + " " + " ".join(part))] + [(n, asked + " " + prose(400 + 10 * n, 500 + n)) for n in (10, 20, 30, 60, 70, 80)]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted(r["doc_id"] for r in left.collect()) == [10, 20, 30, 40, 60, 70, 80]


@pytest.mark.parametrize("alike", [True, False])
def test_a_copy_of_one_that_left_with_a_leader_goes(spark, sf_dir, monkeypatch, alike):
    """A chain of copies in one bucket: 3 leaves with a leader that 4 is no copy of, and 4 is a copy of 3 alone; 4 leaves in vain, or isn't like the leader."""
    words = prose(200, 71).split()
    a, b, c = (" ".join(words[k : k + 100]) for k in (0, 24, 48))
    rows = [(0, a), (1, a + " one"), (2, a + " two"), (3, b), (4, c), (5, prose(100, 72))]
    near = [[0, 0], [0, 0], [0, 0], [(1 << 44) - 1, 0], [(1 << 44) - 1, (1 << 44) - 1], [-1, -1]]
    sketched = [(i, bytes([i]), [5], [0, 0] if alike else near[i], 98, [0]) for i, _ in rows]
    made = spark.createDataFrame(sketched, "id long, content binary, keys array<bigint>, sig array<bigint>, size int, least array<bigint>")
    monkeypatch.setattr(near_dedup, "sketches", lambda *_: made)
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert gone(rows) == {1, 2, 3, 4} and sorted(r["doc_id"] for r in left.collect()) == [0, 5]


def jobs_of(spark, run) -> int:
    """The jobs that ``run`` starts."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_training_leaves_the_driver_alone(spark, monkeypatch):
    """The field is fitted in a task, to the same sample in the same order; without documents it is the same as well."""
    texts = [(k, prose(30, k) + (" vileword" if k % 3 == 0 else "")) for k in random.Random(4).sample(range(60), 60)]
    docs = spark.createDataFrame([*texts, (90, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in texts], "doc_id long, toxic int")
    got, want = toxicity.train(docs, labels), toxicity.fit([(t, int(k % 3 == 0)) for k, t in sorted(texts)])
    assert got.weights == want.weights and (got.transitions == want.transitions).all() and got.start == want.start and "wvileword" in got.weights
    none = toxicity.train(docs.where("false"), labels)
    assert none.weights == toxicity.fit([]).weights
    monkeypatch.setattr(toxicity, "fit", lambda docs: toxicity.Chain({"pid": float(os.getpid())}, np.zeros((2, 2))))
    assert toxicity.train(docs, labels).weights["pid"] != os.getpid()


@pytest.mark.parametrize("kind", ["long", "string", "binary", "decimal(20,0)"])
def test_components_of_few_edges_take_no_rounds(spark, monkeypatch, kind):
    """One task gives what the rounds give, and union by hand; a long chain takes no more jobs than a short one."""
    r = random.Random(3)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(250)] + [(k, k + 1) for k in r.sample(range(1000, 1060), 60)] + [(5, 5), (None, 7)]
    own = spark.createDataFrame(edges, "a long, b long").selectExpr(*(f"cast(cast({c} as {'string' if kind == 'binary' else kind}) as {kind}) as {c}" for c in "ab"))
    rows = [(x["a"], x["b"]) for x in own.collect() if x["a"] is not None]
    root = {x: x for pair in rows for x in pair}
    for _ in root:
        for a, b in rows:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: y for x, y in root.items() if x != y}
    got = {x["node"]: x["root"] for x in near_dedup.components(own).collect()}
    assert got == want and near_dedup.components(own.where("false")).count() == 0
    if kind == "long":
        chain = spark.range(40).selectExpr("id as a", "id + 1 as b")
        assert jobs_of(spark, lambda: near_dedup.components(chain)) == jobs_of(spark, lambda: near_dedup.components(chain.where("a < 2")))
    monkeypatch.setattr(near_dedup, "ONE_TASK_EDGES", 0)
    assert {x["node"]: x["root"] for x in near_dedup.components(own).collect()} == want


def test_batches_of_texts_are_bounded(spark, sf_dir):
    """What a stage returns is read and sent to Python by no more than so many rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for _, stage in corpus_pipeline.STAGES[3:]:
            spark.conf.set(name, 10_000)
            stage(spark, table(spark, sf_dir, "documents"), sf_dir)
            sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
            assert max(r["n"] for r in sizes) <= corpus_pipeline.BATCH_ROWS and sum(r["n"] for r in sizes) == 5000
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name])
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        order = [want.columns.index(c) for c in columns]
        assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=repr)
