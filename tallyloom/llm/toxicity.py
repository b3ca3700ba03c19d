"""Toxic spans by a linear-chain conditional random field.

Two tags, clean and toxic; a token's features are its word, the word's first
3 to 5 and last 3 characters (those unseen in training weigh nothing), and the
chain has free transition weights.  The model is trained on tokens labelled from the
document labels: in toxic documents the words that mark such documents (by
log odds, and in several contexts, so that copies of one document don't count
as evidence) are toxic, all others clean.  Forward-backward marginals give
each token's probability, a document's score is the largest, and runs of
tokens from the threshold up are the offending offsets.

Two tags make the recursions Mobius maps of one ratio, so a batch of whole
documents is cut in blocks whose 2x2 products are taken side by side.

Training reads at most ``max_docs`` labelled documents (half of them toxic, as
far as there are any), chosen by a hash of the id, in one task, and takes them
``_FIT_TOKENS`` tokens at a time; scoring reads every word of every document, without a shuffle.

Defined results: documents of null, empty or blank text score 0 and have no
span; very long ones are scored whole.  A label that isn't 0 or 1, or is null,
doesn't count; a document with both labels counts as both.  A word is evidence
only with four different contexts in the sample's toxic documents; without any
toxic label, or where no word has as many, nothing is toxic.  Repeated rows are
scored apart; an empty table gives no row.  Only the named columns are read, and
``reject`` passes all others on as they are, whatever their names.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_slices
from .common import bounded_sample

#: Labelled documents that training may read; scoring has no bound.
MAX_TRAIN_DOCS = 3000
#: Least probability of an offending token; at it, held-out labels show no false alarm.
THRESHOLD = 0.9

_BLOCK = 64
#: Tokens whose marginals training holds at once.
_FIT_TOKENS = 200_000
_CACHE = 200_000
_STRIP = ".,;:!?\"'()[]{}<>|*_-#`~"
_TOKEN = re.compile(r"\S+")


def normal(token: str) -> str:
    return token.strip(_STRIP).lower()


def features(word: str) -> tuple[str, ...]:
    """A normalised word's features: one name for every word, itself, and its affixes."""
    return ("b",) if not word else ("b", "w" + word, "3" + word[:3], "4" + word[:4], "5" + word[:5], "s" + word[-3:])


@dataclass
class Chain:
    """Weights of the field: of each feature for toxic against clean, and the log weights of the transitions from (row) and to (column) clean and toxic."""

    weights: dict[str, float]
    transitions: np.ndarray
    start: float = 0.0
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def emission(self, token: str) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features(normal(token))])

    def emissions(self, tokens: list[str]) -> list[float]:
        known = self.cache
        if len(known) > _CACHE:
            known.clear()
        found = list(map(known.get, tokens))
        if None in found:
            for k, e in enumerate(found):
                if e is None:
                    found[k] = known[tokens[k]] = self.emission(tokens[k])
        return found


def marginals(emission: np.ndarray, counts: np.ndarray, transitions: np.ndarray, start: float, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each token's probability of being toxic, for documents of ``counts`` (all positive) tokens laid end to end; with ``pairs`` also the expected transitions, summed."""
    blocks = -(-counts // _BLOCK)
    n_blocks = int(blocks.sum())
    doc_block = np.cumsum(blocks) - blocks
    doc_start = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(int(counts.sum())) - doc_start[owner]
    row, column = inside % _BLOCK, doc_block[owner] + inside // _BLOCK
    grid = np.zeros((_BLOCK, n_blocks))
    grid[row, column] = np.exp(np.clip(emission, -50, 50))
    real = np.zeros((_BLOCK, n_blocks), dtype=bool)
    real[row, column] = True
    a = np.exp(transitions)
    first = np.zeros(n_blocks, dtype=bool)
    first[doc_block] = True
    order = np.argsort(-blocks, kind="stable")
    longest_first, sizes = doc_block[order], blocks[order]
    upto = np.searchsorted(-sizes, -np.arange(int(sizes.max()) if len(sizes) else 0), side="left")

    def sweep(forward: bool) -> np.ndarray:
        """Forward: alpha(toxic) / alpha(clean) at each token; backward: the same of beta."""
        steps = range(_BLOCK) if forward else range(_BLOCK - 1, -1, -1)
        # the block's map of the ratio: r -> (p r + q) / (s r + t)
        p, q, s, t = np.ones(n_blocks), np.zeros(n_blocks), np.zeros(n_blocks), np.ones(n_blocks)
        for k in steps:
            e, on = grid[k], real[k]
            if forward:
                np_, nq, ns, nt = e * (a[1, 1] * p + a[0, 1] * s), e * (a[1, 1] * q + a[0, 1] * t), a[1, 0] * p + a[0, 0] * s, a[1, 0] * q + a[0, 0] * t
                if k == 0:  # a document's first token has the start weight, whatever comes in
                    np_, nq, ns, nt = (np.where(first, x, y) for x, y in ((0.0, np_), (e * math.exp(start), nq), (0.0, ns), (1.0, nt)))
            else:
                # beta before a token, from beta after it
                np_, nq, ns, nt = a[1, 1] * e * p + a[1, 0] * s, a[1, 1] * e * q + a[1, 0] * t, a[0, 1] * e * p + a[0, 0] * s, a[0, 1] * e * q + a[0, 0] * t
            scale = np_ + nq + ns + nt
            p, q, s, t = (np.where(on, x / scale, y) for x, y in ((np_, p), (nq, q), (ns, s), (nt, t)))
        # the ratio that comes into each block, block by block along the documents
        into = np.ones(n_blocks)
        span = range(len(upto) - 1) if forward else range(len(upto) - 1, 0, -1)
        for b in span:
            if forward:
                here = longest_first[: upto[b + 1]] + b
                into[here + 1] = (p[here] * into[here] + q[here]) / (s[here] * into[here] + t[here])
            else:
                here = longest_first[: upto[b]] + b
                into[here - 1] = (p[here] * into[here] + q[here]) / (s[here] * into[here] + t[here])
        out, r = np.ones((_BLOCK, n_blocks)), into
        for k in steps:
            e, on = grid[k], real[k]
            if forward:
                new = e * (a[0, 1] + a[1, 1] * r) / (a[0, 0] + a[1, 0] * r)
                if k == 0:
                    new = np.where(first, e * math.exp(start), new)
                r = np.where(on, new, r)
                out[k] = r
            else:
                out[k] = r
                r = np.where(on, (a[1, 0] + a[1, 1] * e * r) / (a[0, 0] + a[0, 1] * e * r), r)
        return out[row, column]

    alpha, beta = sweep(True), sweep(False)
    p = alpha * beta / (1 + alpha * beta)
    if not pairs:
        return p, None
    later = np.flatnonzero(inside > 0)
    r, e = alpha[later - 1], grid[row, column][later] * beta[later]
    w = np.stack([np.full(len(later), a[0, 0]), a[0, 1] * e, a[1, 0] * r, a[1, 1] * r * e])
    return p, (w / w.sum(axis=0)).sum(axis=1).reshape(2, 2)


def label_tokens(docs: list[tuple[list[str], int]], min_contexts: int = 4, min_log_odds: float = 2.5) -> list[np.ndarray]:
    """Token labels from document labels; see the module's docstring."""
    seen = [Counter(), Counter()]
    for words, toxic in docs:
        seen[toxic].update(set(words))
    n = [sum(t == k for _, t in docs) for k in (0, 1)]
    odds = lambda w: math.log((seen[1][w] + 0.5) / (n[1] + 1)) - math.log((seen[0][w] + 0.5) / (n[0] + 1))
    contexts: dict[str, set] = {w: set() for w in seen[1] if w and odds(w) >= min_log_odds}
    for words, toxic in docs:
        if toxic:
            for k, w in enumerate(words):
                if w in contexts:
                    contexts[w].add((words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""))
    bad = {w for w, around in contexts.items() if len(around) >= min_contexts}
    return [np.fromiter((bool(t) and w in bad for w in words), dtype=bool, count=len(words)) for words, t in docs]


def fit(docs: list[tuple[str, int]], epochs: int = 40, rate: float = 0.5, l2: float = 1e-6) -> Chain:
    """The field fitted to (text, toxic) documents by Adagrad on the whole sample's likelihood."""
    split = [([intern(normal(t)) for t in text.split()], toxic) for text, toxic in docs]
    split = [(words, toxic) for words, toxic in split if words]
    bias = -6.0
    transitions, start = np.zeros((2, 2)), 0.0
    labels = label_tokens(split)
    if not split or not any(x.any() for x in labels):
        return Chain({"b": bias}, transitions, bias)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words, _ in split for w in words), dtype=np.int32)
    counts = np.array([len(words) for words, _ in split])
    names: dict[str, int] = {"b": 0}
    width = 6
    table = np.array([(f := [names.setdefault(x, len(names)) for x in features(w)]) + [-1] * (width - len(f)) for w in number])
    weights = np.zeros(len(names))
    weights[0] = bias
    filled = table >= 0
    y = np.concatenate(labels)
    del split, labels
    begin = np.cumsum(counts) - counts
    later = np.ones(len(y), dtype=bool)
    later[begin] = False
    at = np.flatnonzero(later)
    observed = np.bincount(2 * y[at - 1] + y[at], minlength=4).reshape(2, 2)
    squares, t_squares, s_square = np.full(len(names), 1e-8), np.full((2, 2), 1e-8), 1e-8
    # runs of whole documents of about ``_FIT_TOKENS`` tokens
    firsts = np.flatnonzero(np.r_[True, np.diff(begin // _FIT_TOKENS) > 0])
    parts = [(begin[a], begin[b] if b < len(begin) else len(y), counts[a:b]) for a, b in zip(firsts, [*firsts[1:], len(counts)])]
    p = np.zeros(len(y))
    for _ in range(epochs):
        per_word = (weights[table] * filled).sum(axis=1)
        expected = np.zeros((2, 2))
        for a, b, own in parts:
            p[a:b], x = marginals(per_word[ids[a:b]], own, transitions, start, pairs=True)
            expected += x
        gap = np.bincount(ids, weights=y - p, minlength=len(number))
        gradient = np.bincount(table[filled], weights=np.broadcast_to(gap[:, None], table.shape)[filled], minlength=len(names)) / len(y) - l2 * weights
        squares += gradient**2
        weights += rate * gradient / np.sqrt(squares)
        t_gradient = (observed - expected) / len(y) - l2 * transitions
        t_squares += t_gradient**2
        transitions = transitions + 0.1 * rate * t_gradient / np.sqrt(t_squares)
        s_gradient = float((y[begin] - p[begin]).sum()) / len(y) - l2 * start
        s_square += s_gradient**2
        start += 0.1 * rate * s_gradient / math.sqrt(s_square)
    return Chain({f: w for f, k in names.items() if (w := float(weights[k]))}, transitions, start)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_TRAIN_DOCS) -> Chain:
    """Fit on at most ``max_docs`` labelled documents, chosen by a hash of the id."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__toxic")).distinct()
    half = max_docs // 2
    pick = lambda k: bounded_sample(marked.where(F.col("__toxic") == k), "__id", half)
    chosen = pick(1).unionByName(pick(0))
    # at most max_docs short rows, so this side can be broadcast at any size of the input
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where("__text is not null").join(F.broadcast(chosen), "__id").select("__id", "__toxic", "__text")
    # repeated ids could exceed the bound
    sample = rows.orderBy(F.xxhash64("__id"), "__id", "__toxic", "__text").limit(max_docs).coalesce(1).sortWithinPartitions("__id", "__toxic", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = [(text, toxic) for batch in batches for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(docs))], type=pa.binary())], names=["chain"])

    # fitted in a task: what that takes would stay with the driver's Python through all later steps
    found = sample.select("__toxic", "__text").mapInArrow(run, "chain binary").first()
    return pickle.loads(found["chain"]) if found else fit([])


def score_texts(chain: Chain, texts: list[str | None]) -> list[tuple[np.ndarray, str]]:
    """Each text's token probabilities, beside the text."""
    tokens = [t.split() if t else [] for t in texts]
    counts = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    emission = np.array(chain.emissions([w for ws in tokens for w in ws]), dtype=float)
    p = marginals(emission, counts[counts > 0], chain.transitions, chain.start)[0] if len(emission) else emission
    ends = np.cumsum(counts)
    return [(p[e - c : e], t or "") for t, e, c in zip(texts, ends, counts)]


def spans(text: str, p: np.ndarray, threshold: float) -> list[dict]:
    """Character offsets of the runs of toxic tokens, with the runs' largest probability."""
    out: list[dict] = []
    places = [m.span() for m in _TOKEN.finditer(text)]
    # str.split and \S differ in a few control characters; the words themselves then say where they are
    if len(places) != len(p):
        places, at = [], 0
        for w in text.split():
            at = text.index(w, at)
            places.append((at, at + len(w)))
            at += len(w)
    last = -2
    for k in np.flatnonzero(p >= threshold):
        begin, end = places[k]
        if k == last + 1:
            out[-1]["end"], out[-1]["probability"] = end, max(out[-1]["probability"], float(p[k]))
        else:
            out.append({"start": begin, "end": end, "probability": float(p[k])})
        last = k
    return out


SPANS = "array<struct<start:int,end:int,probability:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def tag(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, toxic_tokens, spans) of every document: the largest and the summed marginal, and the offending offsets."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for first, texts in text_slices(x.as_py() for x in batch.column(1)):
                scored = score_texts(model, texts)
                score = np.array([float(p.max()) if len(p) else 0.0 for p, _ in scored])
                total = [float(p.sum()) for p, _ in scored]
                found = [spans(t, p, threshold) if s >= threshold else [] for (p, t), s in zip(scored, score)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(score), pa.array(total), pa.array(found, type=_SPANS)], names=["id", "score", "toxic_tokens", "spans"])

    given = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return given.mapInArrow(run, f"id {id_type}, score double, toxic_tokens double, spans {SPANS}").withColumnRenamed("id", id_col)


def reject(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for first, texts in text_slices(x.as_py() for x in batch.column(place)):
                clean = [not len(p) or float(p.max()) < threshold for p, _ in score_texts(model, texts)]
                yield batch.slice(first, len(texts)).filter(pa.array(clean, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
