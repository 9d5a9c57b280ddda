"""Byte-level BPE with a rank queue over a hierarchical bitmap.

Symbols are a linked list of byte positions. Candidate pairs wait in one bucket
per merge rank; three levels of 64-bit words say which buckets are filled, so
the next rank to merge is found by three find-first-set steps, however long the
text is. Entries whose pair has changed since are stale and skipped when their
bucket comes up. All pre-tokens of a batch of texts share one queue: links do
not cross pre-tokens, so the lowest rank of all is the lowest rank of each
pre-token that has it, and a bucket is merged as one array operation.

Merging a whole bucket at once equals merging its positions from left to right
if no merge can make a pair of a lower rank. Ranks where one could (known from
the vocabulary) take only the leftmost position of each pre-token at a time: the
bucket holds one head a pre-token, the others wait in a heap of their own, so a
merge costs what it changes, and a pre-token of any length takes n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's cache of encoded words; beyond it the cache starts anew.
CACHE = 250_000
#: Longest word that is cached.
CACHED_LENGTH = 64
#: Characters of text whose new words are encoded together.
BATCH_CHARS = 8_000_000
#: New words that share one queue; its arrays and buckets take some 300 bytes a word.
QUEUE_WORDS = 150_000
#: A space with other characters on both sides always starts a pre-token.
INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
ODD_SPACE = re.compile(r"\s\s|^ | $")


class RankQueue:
    """Buckets of positions by merge rank (below 2**18)."""

    __slots__ = ("top", "mid", "low", "buckets")

    def __init__(self):
        self.top, self.mid, self.low, self.buckets = 0, [0] * 64, [0] * 4096, {}

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank that has positions, with all of them; its bucket is empty then."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        self.low[b] = word & (word - 1)
        if not self.low[b]:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        return rank, self.buckets.pop(rank)


class Merges:
    """``(left id, right id) -> rank`` for every pair whose bytes are a token, as
    an open-addressing table of arrays; ``unsafe[r]``: token r is a part of a
    token of lower rank."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        a, b, r = np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int64)
        size = 1 << max(4, (4 * len(r)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = size - 1
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        keys = a << 32 | b
        slot, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            self.ranks[slot[free]] = r[free]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask
        self.few = int(self.shift)
        self.unsafe = np.zeros(max(ranks.values(), default=0) + 1, bool)
        self.unsafe[a[r < a]] = True
        self.unsafe[b[r < b]] = True

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; -1 where the pair makes no token."""
        keys = left << 32 | right
        at = self.slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], -1)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at = (at[todo] if len(at) != len(todo) else at) + 1 & self.mask
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            go = ~hit & (found != -1)
            todo, at = todo[go], at[go]
        return out


    def one(self, left: int, right: int) -> int:
        """The rank of one pair."""
        key = left << 32 | right
        at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> self.few
        while (found := self.keys[at]) != -1:
            if found == key:
                return int(self.ranks[at])
            at = at + 1 & self.mask
        return -1


def merge_all(pieces: list[bytes], byte_ids: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces in a row, and where each piece's ids end."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    ids = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(ids)
    ends = np.cumsum(sizes)
    if n < 2:
        return ids, ends
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    filled = sizes > 0
    nxt[ends[filled] - 1] = -1
    prv[(ends - sizes)[filled]] = -1
    rank = np.full(n, -1, np.int64)
    rank[:-1] = merges.of(ids[:-1], ids[1:])
    rank[nxt < 0] = -1
    live = np.ones(n, bool)
    queue = RankQueue()

    def push(at: np.ndarray, ranks: np.ndarray) -> None:
        keep = ranks >= 0
        at, ranks = at[keep], ranks[keep]
        if len(at) < 16:
            for p, r in zip(at.tolist(), ranks.tolist()):
                queue.push(r, [p])
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cut = np.flatnonzero(np.diff(ranks)) + 1
        lo, positions = [0, *cut.tolist()], at.tolist()
        for a, b, r in zip(lo, [*lo[1:], len(positions)], ranks[lo].tolist()):
            queue.push(r, positions[a:b])

    waiting: dict[int, dict[int, list[int]]] = {}  # rank -> piece -> heap of positions behind its head

    def leftmost(r: int, at: np.ndarray) -> np.ndarray:
        """Of the popped positions of an unsafe rank, the first valid one of each
        piece; the next one becomes the head in the bucket, the rest wait."""
        heaps = waiting.setdefault(r, {})
        piece = np.searchsorted(ends, at, side="right")
        valid = rank[at] == r
        several = np.r_[False, piece[1:] == piece[:-1]]
        if not heaps and not several.any():
            return at[valid]
        mixed = np.isin(piece, [*heaps, *piece[several].tolist()])
        chosen, heads = at[valid & ~mixed].tolist(), []
        own: dict[int, list[int]] = {}
        for p, x, ok in zip(at[mixed].tolist(), piece[mixed].tolist(), valid[mixed].tolist()):
            new = own.setdefault(x, [])
            if ok:
                new.append(p)
        for x, new in own.items():
            heap = heaps.pop(x, [])
            for p in new:
                heappush(heap, p)
            for target in (chosen, heads):
                while heap and rank[heap[0]] != r:
                    heappop(heap)
                if heap:
                    target.append(heappop(heap))
            if heap:
                heaps[x] = heap
        if heads:
            queue.push(r, heads)
        return np.array(sorted(chosen), np.int64)

    def merge_one(p: int, r: int) -> None:
        right = int(nxt[p])
        after = int(nxt[right])
        ids[p] = r
        rank[right] = rank[p] = -1
        live[right] = False
        nxt[p] = after
        if after >= 0:
            prv[after] = p
            made = merges.one(r, int(ids[after]))
            rank[p] = made
            if made >= 0:
                queue.push(made, [p])
        before = int(prv[p])
        if before >= 0:
            made = merges.one(int(ids[before]), r)
            rank[before] = made
            if made >= 0:
                queue.push(made, [before])

    push(np.arange(n), rank)
    while (got := queue.pop()) is not None:
        r, bucket = got
        unsafe = merges.unsafe[r]
        if len(bucket) == 1 and not (unsafe and waiting.get(r)):
            if rank[bucket[0]] == r:
                merge_one(bucket[0], r)
            continue
        at = np.unique(np.array(bucket, np.int64))
        if unsafe:
            at = leftmost(r, at)
        else:
            at = at[rank[at] == r]  # the others are stale
            follows = np.r_[False, nxt[at[:-1]] == at[1:]] if len(at) else np.zeros(0, bool)  # overlaps the one before it
            if follows.any():  # in a run of overlaps every second one merges
                i = np.arange(len(at))
                run = np.maximum.accumulate(np.where(follows, -1, i))
                at = at[(i - run) % 2 == 0]
        if len(at) == 1:
            merge_one(int(at[0]), r)
            continue
        if not len(at):
            continue
        right = nxt[at]
        after = nxt[right]
        ids[at] = r
        rank[right] = -1
        live[right] = False
        nxt[at] = after
        has = after >= 0
        prv[after[has]] = at[has]
        rank[at] = -1
        to_right = at[has]
        before = prv[at]
        before = before[before >= 0]
        changed = np.concatenate([to_right, before])
        if len(changed):
            made = merges.of(ids[changed], ids[nxt[changed]])
            rank[changed] = made
            push(changed, made)
    kept = np.cumsum(live)
    return ids[live], np.where(ends > 0, kept[np.maximum(ends, 1) - 1], 0)


class Codec:
    """Encodes and decodes texts by a rank file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.by_id = {i: b for b, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.merges = Merges(self.ranks)
        self.cache: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Parts of the text that the pattern splits the same way alone; all but
        the first have lost the space they begin with."""
        if not text:
            return []
        return INNER_SPACE.split(text) if ODD_SPACE.search(text) else text.split(" ")

    def fresh(self, words: Iterable[str]) -> dict[str, bytes]:
        """Encode words that the cache lacks, ``QUEUE_WORDS`` of them in one queue."""
        words, out = list(words), {}
        for at in range(0, len(words), QUEUE_WORDS):
            out.update(self.queued(words[at : at + QUEUE_WORDS]))
        return out

    def queued(self, words: list[str]) -> dict[str, bytes]:
        pieces: dict[bytes, int] = {}
        split, made = self.split, []
        for w in words:
            made.append([pieces.setdefault(p.encode(), len(pieces)) for p in split(w)])
        ids, ends = merge_all(list(pieces), self.byte_ids, self.merges)
        packed, stop = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        part = [packed[a:b] for a, b in zip([0, *stop], stop)]
        return {w: b"".join([part[i] for i in own]) for w, own in zip(words, made)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        first, rest = set(), set()
        for t in texts:
            parts = self.words(t)
            first.update(parts[:1])
            rest.update(parts[1:])
        cache = self.cache
        new = {w for w in first if w not in cache} | {w for w in (" " + x for x in rest) if w not in cache}
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = first | {" " + x for x in rest}
        del first, rest
        cache.update(self.fresh(new))
        out = []
        for t in texts:
            parts = self.words(t)
            out.append(b"".join([cache[w] for w in parts[:1]] + [cache[" " + w] for w in parts[1:]]))
        if len(cache) > CACHE:
            cache.clear()
        else:
            for w in new:
                if len(w) > CACHED_LENGTH:
                    del cache[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        by_id = self.by_id
        return b"".join([by_id[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: tuple[str, str] | None = None) -> DataFrame:
    """One row per input row: ``id, n_tokens, ids`` (array of int), and
    ``lossless``: whether the ids decode to the text's bytes. A null or empty
    text has no ids. Repeated rows and null ids are rows like others; other columns
    are not read; an empty table gives no rows."""
    path, pattern = ranks or default_ranks()
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    extra = {"n_tokens": F.lit(0).cast("long"), "ids": F.array().cast("array<int>"), "lossless": F.lit(True)}
    schema = rows.drop("_text").withColumns(extra).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for keys, texts in grouped(batches):
            encoded = c.encode(texts)
            for at in range(0, len(texts), 2000):
                part, done = texts[at : at + 2000], encoded[at : at + 2000]
                sizes = [len(x) // 4 for x in done]
                flat = pa.array(np.frombuffer(b"".join(done), "<u4").astype("int32"))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype("int32")), flat)
                same = [c.decode(x) == t.encode() for x, t in zip(done, part)]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(part)), pa.array(sizes, pa.int64()), lists, pa.array(same, pa.bool_())],
                    names=[id_col, "n_tokens", "ids", "lossless"],
                )

    return rows.mapInArrow(run, schema)


def decode_ids(docs: DataFrame, ids_col: str = "ids", ranks: tuple[str, str] | None = None, out: str = "decoded") -> DataFrame:
    """``docs`` with a binary column ``decoded``: the bytes of the ids, empty for null.
    All other columns and rows stay; a column of that name is replaced."""
    path, pattern = ranks or default_ranks()

    @F.pandas_udf("binary")
    def decoded(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for batch in ids:
            yield pd.Series([c.decode(np.asarray([] if x is None else x, "<u4").tobytes()) for x in batch])

    return docs.withColumn(out, decoded(F.col(f"`{ids_col}`")))


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: tuple[str, str] | None = None) -> DataFrame:
    """One row per input row: ``id, n_tokens, ids_sha256, decoded_sha256``; ids
    are encoded and decoded in the same pass, so nothing is shuffled. A null
    text is empty. Rows may repeat; other columns are not read."""
    path, pattern = ranks or default_ranks()
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    schema = rows.drop("_text").withColumns(
        {"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for keys, texts in grouped(batches):
            done = c.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array([len(x) // 4 for x in done], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in done], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in done], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts of (key, text) batches, in groups of some ``BATCH_CHARS``."""
    pa.default_memory_pool().release_unused()  # what earlier tasks of this worker held
    keys, texts, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            keys.append(part.column(0))
            texts += [t or "" for t in part.column(1).to_pylist()]
            held += sum(map(len, texts[-part.num_rows :]))
            if held >= BATCH_CHARS:
                yield pa.concat_arrays(keys), texts
                keys, texts, held = [], [], 0
    if texts:
        yield pa.concat_arrays(keys), texts
