"""Token counts that follow edits without encoding a document anew.

Each document keeps a segment tree over its words (the pre-tokens of the BPE
split): a leaf holds a word's characters and ids, an inner node the sums of
its children.  Trees are stored beside the texts as packed leaf arrays
(``with_trees``); their sums are added up when a tree is loaded, which encodes
nothing.  An edit (``update``) descends by characters to the words it touches,
takes the few words before that can see the edited characters, splits and
encodes only that stretch of the new text, up to the first word that begins
where an old one began, and updates the sums on the way to the root.  The
edited text and its tree come out in the same form, for the next edits.

Defined results: a null text has a null tree and null counts and its edits are
ignored; an empty text counts 0 tokens and can be inserted into.  Edits apply
one after another, each to the text the earlier ones left; offsets beyond the
text's end mean its end, a negative start means 0, an end before the start
inserts, null offsets or a null edit do nothing, a null replacement deletes.
Very long texts are split and encoded whole, once; their edits cost no more
than others' but for loading the tree.  Repeated rows, and rows of null id, are
counted apart.  An empty table gives no row.  Only the named columns are read,
so extra columns with clashing names don't matter; ``with_trees`` replaces
columns of the names that it adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import DEFAULT_VOCAB, PartCache, part_cache, text_slices
from .common import cut

EDITS = "array<struct<start:int,end:int,replacement:string>>"

#: A word's match looks at most this far beyond its own end ('re and its kin).
_LOOK = 3
#: Words of a bottom node.
_LEAF = 64


class WordTree:
    """Segment tree over a document's words.

    The bottom nodes hold runs of words, which may grow when an edit adds some;
    ``chars`` and ``ids`` are the heap-ordered sums above them.
    """

    def __init__(self, chars, ids):
        self.build(np.asarray(chars, dtype=np.int64), np.asarray(ids, dtype=np.int64))

    def build(self, chars: np.ndarray, ids: np.ndarray) -> None:
        begin = np.arange(0, len(chars), _LEAF)
        self.word_chars, self.word_ids = ([x[i : i + _LEAF] for i in begin] or [[]] for x in (chars, ids))
        self.n = n = 1 << (len(self.word_chars) - 1).bit_length()
        self.chars, self.ids = (self._sums(x, begin, n) for x in (chars, ids))

    @staticmethod
    def _sums(values: np.ndarray, begin: np.ndarray, n: int) -> list[int]:
        level = np.zeros(n, dtype=np.int64)
        if len(values):
            level[: len(begin)] = np.add.reduceat(values, begin)
        levels = [level]
        while len(level) > 1:
            level = level.reshape(-1, 2).sum(axis=1)
            levels.append(level)
        return np.concatenate([[0], *reversed(levels)]).tolist()

    def run(self, node: int) -> list[int]:
        """The words' characters of a bottom node, which are arrays until they are asked for."""
        if not isinstance(self.word_chars[node], list):
            self.word_chars[node], self.word_ids[node] = self.word_chars[node].tolist(), self.word_ids[node].tolist()
        return self.word_chars[node]

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and ids of all words."""
        return tuple(np.concatenate([np.asarray(r, dtype=np.int64) for r in runs]) for runs in (self.word_chars, self.word_ids))

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.ids[1]

    def find(self, offset: int) -> tuple[int, int, int]:
        """(bottom node, word in it, the word's first character) of the word at a character; the place after the last word for the end."""
        if offset >= self.chars[1]:
            last = len(self.word_chars) - 1
            return last, len(self.word_chars[last]), self.chars[1]
        node, begin = 1, 0
        while node < self.n:
            node *= 2
            if offset >= begin + self.chars[node]:
                begin += self.chars[node]
                node += 1
        node -= self.n
        for k, c in enumerate(self.run(node)):
            if offset < begin + c:
                return node, k, begin
            begin += c
        raise AssertionError("sums don't match the words")

    def replace(self, first: tuple[int, int], last: tuple[int, int], chars: list[int], ids: list[int]) -> None:
        """Put words in the place of those from ``first`` up to ``last``, exclusive, and update the sums above."""
        (a, i), (b, j) = first, last
        self.run(a), self.run(b)
        if a == b:
            self.word_chars[a][i:j], self.word_ids[a][i:j] = chars, ids
        else:
            self.word_chars[a][i:], self.word_ids[a][i:] = chars, ids
            del self.word_chars[b][:j], self.word_ids[b][:j]
            for k in range(a + 1, b):
                self.word_chars[k], self.word_ids[k] = [], []
        if len(self.word_chars[a]) > 4 * _LEAF:  # as deep as the words ask for
            self.build(*self.leaves())
            return
        above = set()
        for k in range(a, b + 1):
            self.chars[self.n + k], self.ids[self.n + k] = sum(self.run(k)), sum(self.word_ids[k])
            above.add((self.n + k) // 2)
        while above - {0}:
            for k in above:
                self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
                self.ids[k] = self.ids[2 * k] + self.ids[2 * k + 1]
            above = {k // 2 for k in above if k > 1}


def apply_edit(text: str, tree: WordTree, start: int, end: int, replacement: str, cache: PartCache) -> tuple[str, int]:
    """The edited text, and how many words were encoded; the tree follows."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    new = text[:start] + replacement + text[end:]
    shift = len(new) - len(text)
    # words that end further left than this can't have seen the edited characters
    node, k, begin = tree.find(max(0, start - _LOOK))
    if k and begin and begin > start - _LOOK:
        k -= 1
        begin -= tree.run(node)[k]
    stop_node, stop_k, stop = tree.find(end)
    if stop < end:
        stop += tree.run(stop_node)[stop_k]
        stop_k += 1
    words: list[str] = []
    at = begin
    for match in cache.pattern.finditer(new, begin):
        at = match.start()
        while stop < at - shift:  # pass the old words that this stretch has grown over
            while stop_k >= len(tree.word_chars[stop_node]):
                stop_node, stop_k = stop_node + 1, 0
            stop += tree.run(stop_node)[stop_k]
            stop_k += 1
        if at >= start + len(replacement) and stop == at - shift:
            break
        words.append(match.group())
    else:
        stop_node = len(tree.word_chars) - 1
        stop_k = len(tree.word_chars[stop_node])
    tree.replace((node, k), (stop_node, stop_k), [len(w) for w in words], [cache.count_word(w) for w in words])
    return new, len(words)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in as many bytes each as the largest needs (1, 2 or 4), which the first byte says."""
    top = int(values.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1)


def edit_document(text: str, chars: bytes, ids: bytes, edits: list[dict | None] | None, cache: PartCache) -> tuple[str, WordTree, int, int]:
    """(text, tree, tokens before, words encoded) after the edits, from a stored tree."""
    tree = WordTree(unpack(chars), unpack(ids))
    before, again = tree.n_tokens, 0
    for e in edits or ():
        if e and e["start"] is not None and e["end"] is not None:
            text, n = apply_edit(text, tree, e["start"], e["end"], e["replacement"] or "", cache)
            again += n
    return text, tree, before, again


def with_trees(docs: DataFrame, text_col: str = "text", vocab: str = DEFAULT_VOCAB, chars_col: str = "word_chars", ids_col: str = "word_ids") -> DataFrame:
    """``docs`` with each text's tree, as two columns of packed leaves.  This is the one full encoding; no shuffle."""
    docs = docs.drop(*(c for c in (chars_col, ids_col) if c in docs.columns))
    place, names = docs.columns.index(text_col), [*docs.columns, chars_col, ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = part_cache(vocab)
        for batch in batches:
            for first, texts in text_slices(x.as_py() for x in batch.column(place)):
                found = cache.words([t for t in texts if t is not None])
                rows = [(None, None) if t is None else tuple(map(pack, next(found))) for t in texts]
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, type=pa.binary()) for c in zip(*rows))], names=names)

    own = T.StructType([T.StructField(c, T.BinaryType()) for c in (chars_col, ids_col)])
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + own.fields))


def update(stored: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB, chars_col: str = "word_chars", ids_col: str = "word_ids", with_text: bool = True) -> DataFrame:
    """(id, text, word_chars, word_ids, n_words, n_tokens, n_tokens_edited, n_reencoded): the edited texts with their trees, words and tokens before, tokens after, and how many words were encoded again.

    ``edits`` is a column of type ``EDITS`` (see ``attach_edits`` for edits in a
    table of their own).  Without ``with_text`` only the counts come out.  No shuffle.
    """
    id_type = stored.schema[id_col].dataType.simpleString()
    counts = ["n_words", "n_tokens", "n_tokens_edited", "n_reencoded"]
    names = ["id", *(["text", "chars", "ids"] if with_text else []), *counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = part_cache(vocab)
        for batch in batches:
            for first, texts in text_slices(x.as_py() for x in batch.column(1)):
                chars, ids, given = (batch.column(k).slice(first, len(texts)).to_pylist() for k in (2, 3, 4))
                rows: list[tuple] = []
                for text, c, i, own in zip(texts, chars, ids, given):
                    if text is None or c is None:
                        rows.append((text, c, i, *(None,) * 4))
                        continue
                    text, tree, before, again = edit_document(text, c, i, own, cache)
                    rows.append((*((text, *map(pack, tree.leaves())) if with_text else (None,) * 3), (len(c) - 1) // c[0], before, tree.n_tokens, again))
                columns = [pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.binary(), *(pa.int64(),) * 4))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *columns[0 if with_text else 3 :]], names=names)

    schema = f"id {id_type}, " + "text string, chars binary, ids binary, " * with_text + ", ".join(f"{c} bigint" for c in counts)
    given = stored.select(stored[id_col].alias("id"), stored[text_col].cast("string").alias("text"), stored[chars_col].alias("chars"), stored[ids_col].alias("ids"), edits.cast(EDITS).alias("edits"))
    out = given.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), *([F.col("text").alias(text_col), F.col("chars").alias(chars_col), F.col("ids").alias(ids_col)] if with_text else []), *counts)


def count_edited(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(id, n_words, n_tokens, n_tokens_edited, n_reencoded) of each document: its tree is stored first, and edited from there."""
    given = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), edits.cast(EDITS).alias("edits"))
    stored = cut(with_trees(given, vocab=vocab), codec="zstd")
    return update(stored, F.col("edits"), "id", vocab=vocab, with_text=False).withColumnRenamed("id", id_col)


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edits) from edits in rows (id, seq, start, end, replacement), applied by ``seq``; ties by offset.

    One shuffle of the edits and, unless it is bucketed by the id, of the texts.
    """
    order = F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement")))
    own = edits.groupBy(edits[id_col].alias("__id")).agg(F.transform(order, lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["replacement"].alias("replacement"))).alias("edits"))
    base = docs.select(id_col, text_col)
    return base.join(own, base[id_col] == own["__id"], "left").drop("__id")
