"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array.  Each round looks every
adjacent pair up by binary search in a sorted array of pair keys, takes the
lowest rank of each word, and merges there; words without a known pair leave
the array.  Python touches a text only to split it at spaces and to look the
parts up in a per-worker cache, so a word is merged once per worker and not
once per occurrence.

The vocabulary is a rank file (``base64(token) rank`` per line); its path is a
parameter.  Ids equal the ranks.

Defined results: a null text gives null ids, a null count and a null round
trip; an empty text gives an empty list.  Rows are independent, so repeated
rows give repeated results.  Only the id and the text column are read, so
other columns of any name don't matter.  Invalid ids decode to an error.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of public vocabularies; every operator takes ``vocab`` as a parameter.
VOCAB_DIR = "/opt/tokenizers"
DEFAULT_VOCAB = os.path.join(VOCAB_DIR, "byte_bpe_50k.tiktoken")

#: The split of a text into words before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.int32(2**31 - 1)
#: Longer words are merged with a heap: a round a merge would be quadratic.
_LONG = 256
#: Entries after which a worker's cache starts anew.
_CACHE = 200_000
#: Characters encoded at once, which bounds a worker's memory.
_SLICE = 1_500_000


class Vocabulary:
    """Tokens by id, and the sorted keys of all mergeable pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        rank = {base64.b64decode(token): int(number) for token, number in pairs}
        self.rank = rank
        self.tokens = [b""] * (max(rank.values()) + 1)
        for token, number in rank.items():
            self.tokens[number] = token
        self.byte_ids = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, merged = [], []
        for token, number in rank.items():
            for cut in range(1, len(token)):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(number)
        keys_array = np.array(keys, dtype=np.int64)
        order = np.argsort(keys_array)
        self.pair_keys = keys_array[order]
        self.pair_ranks = np.array(merged, dtype=np.int32)[order]
        every = np.indices((256, 256)).reshape(2, -1)
        self.byte_pairs = self.pair_rank(self.byte_ids[every[0]], self.byte_ids[every[1]]).reshape(256, 256)
        lengths = np.fromiter(map(len, self.tokens), dtype=np.int64, count=len(self.tokens))
        self.token_lengths = lengths
        self.token_starts = np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NONE`` where the vocabulary lacks it."""
        if not len(self.pair_keys):
            return np.full(len(left), _NONE, dtype=np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        counts = np.zeros(len(words), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.flatnonzero(lengths > _LONG):
            ids = self.merge_word(words[w])
            parts.append((np.full(len(ids), w, dtype=np.int64), np.array(ids, dtype=np.int32)))
        short = [words[w] for w in np.flatnonzero(lengths <= _LONG)]
        raw = np.frombuffer(b"".join(short), dtype=np.uint8)
        sym = self.byte_ids[raw]
        word = np.repeat(np.flatnonzero(lengths <= _LONG), lengths[lengths <= _LONG])
        rank = np.full(len(sym), _NONE, dtype=np.int32)  # of each symbol with the next one of its word
        if len(sym) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self.byte_pairs[raw[:-1], raw[1:]], _NONE)
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(sym)))
            live = low != _NONE
            if not live.all():  # finished words leave the array
                done = np.repeat(~live, size)
                parts.append((word[done], sym[done]))
                sym, word, rank = sym[~done], word[~done], rank[~done]
                low, size = low[live], size[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            owner = word[hit]
            hit = hit[np.r_[True, owner[1:] != owner[:-1]]]  # the leftmost of each word
            sym[hit] = rank[hit]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            hit -= np.arange(len(hit))  # one symbol before each has gone
            for at in (hit - (hit > 0), hit):  # only the pairs beside a merge are new
                after = np.minimum(at + 1, len(sym) - 1)
                same = (word[at] == word[after]) & (after > at)
                rank[at] = np.where(same, self.pair_rank(sym[at], sym[after]), _NONE)
        if len(sym):
            parts.append((word, sym))
        if not parts:
            return np.zeros(0, dtype=np.int32), counts
        word = np.concatenate([w for w, _ in parts])
        ids = np.concatenate([s for _, s in parts])
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.int32), np.bincount(word, minlength=len(words)).astype(np.int64)

    def merge_word(self, word: bytes) -> list[int]:
        """The same merges for one word, in O(n log n)."""
        ids: list[int] = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        tokens, rank, n = self.tokens, self.rank, len(word)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(tokens[ids[i]] + tokens[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    right = after[left]
                    if (x := rank.get(tokens[ids[left]] + tokens[ids[right]])) is not None:
                        heapq.heappush(heap, (x, left, ids[left], ids[right]))
        return [x for x, ok in zip(ids, alive) if ok]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of an id array, by one gather."""
        ids = np.asarray(ids)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("an id is not in the vocabulary")
        return gather(self.token_bytes, self.token_starts[ids], self.token_lengths[ids]).tobytes()


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[s : s + n]`` for all starts and lengths."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - (ends - lengths), lengths)
    return flat[shift + np.arange(total)]


class _Parts(dict):
    """Part of a text -> number; a new part gets the next one and waits."""

    def __init__(self, cache: PartCache, prefix: str):
        self.cache, self.prefix = cache, prefix

    def __missing__(self, part: str) -> int:
        cache = self.cache
        number = cache.size + len(cache.waiting)
        cache.waiting.append(self.prefix + part)
        self[part] = number
        return number


class PartCache:
    """Word splits and ids of the parts between single spaces.

    A space always begins a word or a run of white space, so the parts can be
    encoded apart, unless a part ends in white space; a text with such a part
    inside is split as a whole.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.pattern = vocab, regex.compile(SPLIT)
        self.find = self.pattern.findall
        self.clear()

    def clear(self) -> None:
        self.size, self.waiting = 0, []
        self.counts: dict[str, int] = {}
        self.spaced, self.plain = _Parts(self, " "), _Parts(self, "")
        empty = np.zeros(0, dtype=np.int64)
        self.unsafe = np.zeros(0, dtype=bool)
        #: Of each part: where its ids and its words begin, and their number.
        self.id_start, self.id_count, self.word_start, self.word_count = empty, empty, empty, empty
        self.ids, self.word_ids, self.word_chars = np.zeros(0, dtype=np.int32), empty, empty

    def _resolve(self) -> None:
        if not self.waiting:
            return
        parts, self.waiting = self.waiting, []
        found = list(map(self.find, parts))
        words = [w for ws in found for w in ws]
        unique = dict.fromkeys(words)
        for n, w in enumerate(unique):
            unique[w] = n
        which = np.fromiter(map(unique.__getitem__, words), dtype=np.int64, count=len(words))
        ids, counts = self.vocab.merge_words([w.encode("utf-8", "surrogatepass") for w in unique])
        starts = np.cumsum(counts) - counts
        per_word = counts[which]
        flat = gather(ids, starts[which], per_word)
        word_count = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        word_start = np.cumsum(word_count) - word_count
        upto = np.concatenate([[0], np.cumsum(per_word)])
        id_start = upto[word_start]
        id_count = upto[word_start + word_count] - id_start
        self.id_start = np.concatenate([self.id_start, id_start + len(self.ids)])
        self.id_count = np.concatenate([self.id_count, id_count])
        self.word_start = np.concatenate([self.word_start, word_start + len(self.word_ids)])
        self.word_count = np.concatenate([self.word_count, word_count])
        self.ids = np.concatenate([self.ids, flat])
        self.word_ids = np.concatenate([self.word_ids, per_word])
        self.word_chars = np.concatenate([self.word_chars, np.fromiter(map(len, words), dtype=np.int64, count=len(words))])
        self.unsafe = np.concatenate([self.unsafe, np.fromiter((p[-1:].isspace() for p in parts), dtype=bool, count=len(parts))])
        self.size += len(parts)

    def parts_of(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's parts."""
        if self.size > _CACHE:
            self.clear()
        numbers = []
        for text in texts:
            first, *rest = text.split(" ")
            own = np.empty(len(rest) + 1, dtype=np.int64)
            own[0] = self.plain[first]
            own[1:] = list(map(self.spaced.__getitem__, rest))
            numbers.append(own)
        self._resolve()
        for k, own in enumerate(numbers):
            if self.unsafe[own[:-1]].any():
                numbers[k] = np.array(list(map(self.plain.__getitem__, self.find(texts[k]))), dtype=np.int64)
        self._resolve()
        return numbers

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has."""
        numbers = self.parts_of(texts)
        if not numbers:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        flat = np.concatenate(numbers)
        per_part = self.id_count[flat]
        upto = np.concatenate([[0], np.cumsum(per_part)])
        ends = np.cumsum(np.fromiter(map(len, numbers), dtype=np.int64, count=len(numbers)))
        counts = np.diff(np.concatenate([[0], upto[ends]]))
        return gather(self.ids, self.id_start[flat], per_part), counts

    def count_word(self, word: str) -> int:
        """How many ids one word has; for the few words of an edit, where arrays cost more than they save."""
        known = self.counts.get(word)
        if known is None:
            if len(self.counts) > _CACHE:
                self.counts.clear()
            known = self.counts[word] = len(self.vocab.merge_word(word.encode("utf-8", "surrogatepass")))
        return known

    def words(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text: characters and ids of each of its words."""
        for own in self.parts_of(texts):
            n = self.word_count[own]
            at = self.word_start[own]
            yield gather(self.word_chars, at, n), gather(self.word_ids, at, n)


_CACHES: dict[str, PartCache] = {}


def part_cache(vocab: str) -> PartCache:
    """This process's cache for a vocabulary."""
    if vocab not in _CACHES:
        _CACHES[vocab] = PartCache(Vocabulary(vocab))
    return _CACHES[vocab]


def text_slices(texts: Iterable[str | None], most: int = _SLICE) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about ``most`` characters, with the index of the first."""
    run: list[str | None] = []
    first, size, at = 0, 0, -1
    for at, text in enumerate(texts):
        run.append(text)
        size += len(text or "") + 16
        if size >= most:
            yield first, run
            run, first, size = [], at + 1, 0
    if run:
        yield first, run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB, verify: bool = False) -> DataFrame:
    """(id, token_ids array<int>, n_tokens[, round_trip]) of each document.

    ``verify`` decodes the ids again and compares bytes.  No shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = part_cache(vocab)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for first, texts in text_slices(x.as_py() for x in column):
                some = [t for t in texts if t is not None]
                ids, counts = cache.encode(some)
                null = np.fromiter((t is None for t in texts), dtype=bool, count=len(texts))
                per_row = np.zeros(len(texts), dtype=np.int64)
                per_row[~null] = counts
                bounds = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(bounds, mask=np.append(null, False)), pa.array(ids, type=pa.int32()))
                out = [keys.slice(first, len(texts)), rows, pa.array(per_row, mask=null)]
                if verify:
                    ends = np.cumsum(counts)
                    same = (cache.vocab.decode(ids[e - c : e]) == t.encode() for t, e, c in zip(some, ends, counts))
                    flags = np.zeros(len(texts), dtype=bool)
                    flags[~null] = np.fromiter(same, dtype=bool, count=len(some))
                    out.append(pa.array(flags, mask=null))
                yield pa.RecordBatch.from_arrays(out, names=["id", "token_ids", "n_tokens", "round_trip"][: len(out)])

    schema = f"id {id_type}, token_ids array<int>, n_tokens bigint" + ", round_trip boolean" * verify
    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(id, text) of each id list; bytes that aren't UTF-8 become U+FFFD."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = part_cache(vocab).vocab
        for batch in batches:
            texts = [None if x.as_py() is None else known.decode(x.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["id", "text"])

    out = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, f"id {id_type}, text string")
    return out.withColumnRenamed("id", id_col)
