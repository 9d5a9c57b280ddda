r"""Ranked search of a set of items over all documents by blocked matrix products.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased. A document scores, for each term of an item (repeats included),
``weight(term) * ((10**9 * tf) div (1000 * tf + 12 * m))``.

1. Items come in groups of ``GROUP_BYTES`` of text, so what goes to the tasks is
   bounded; a group takes one pass over the texts.
2. The pass over the texts counts terms and keeps, for each document with a term,
   its length and the counts of the group's terms: a written narrow table.
3. Document frequencies are partial sums by term, added by Spark.
4. Items are dealt to tiles with a vocabulary of their own, documents to tiles of
   rows. A tile pair is one dense product in float64 of item counts by document
   impacts (weight times quotient, integers). Vocabulary tiles are cut where the sum
   of a product could reach 2**53, so every partial sum is an exact integer; tiles
   add up as 64-bit integers.
5. Each task keeps its best ``k`` by (score, id), with all that tie with the k-th
   until ids decide, so cutting is the same in any order of tiles. Merging takes
   two windows, by (item, salt) and by item: no task gets all rows of an item.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import materialize

#: Text of the items that are searched together.
GROUP_BYTES = 4 << 20
ITEM_TILE = 64
VOCABULARY_TILE = 4096
#: Entries of a dense tile of documents.
DENSE = 1 << 20
EXACT = 1 << 53
#: The quotient of a term is below this.
UNIT = 10**9 // 1000
CHUNK = 1 << 22
SALTS = 64

_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[65:91] += 32
_KEEP[[b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = 32
_TABLE = _KEEP.tobytes()


def terms(text: str | None) -> Counter:
    """How often each term (UTF-8 bytes) stands in a text, by stretches of some MB."""
    data = (text or "").encode().translate(_TABLE)
    if len(data) <= CHUNK:
        return Counter(data.split())
    counts: Counter = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        counts.update(data[at:end].split())
        at = end
    return counts


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def bag_table(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``id, n, ids, counts`` of each document with a term: all its terms counted, and
    of those in the vocabulary (place in it) how often, as little-endian integers."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    place = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.keys()
        for batch in batches:
            ids, n, found, counts = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                bag = terms(text.as_py())
                if not bag:
                    continue
                hit = sorted((place[t], bag[t]) for t in known & bag.keys())
                tf = np.array([c for _, c in hit], np.uint64)
                kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if tf.max(initial=0) <= np.iinfo(k).max)
                ids.append(i)
                n.append(bag.total())
                found.append(np.array([p for p, _ in hit], "<u4").tobytes())
                counts.append(tf.astype(kind).tobytes())
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "ids", "counts"])

    return rows.mapInArrow(run, "id long, n long, ids binary, counts binary")


def corpus_counts(bags: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms in all, and the document frequency of each vocabulary term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 2, np.int64)
        for batch in batches:
            df[size] += batch.num_rows
            df[size + 1] += sum(batch.column("n").to_pylist())
            for ids in batch.column("ids").to_pylist():
                df[np.frombuffer(ids, "<u4")] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["term", "df"])

    sums = bags.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(size + 2, np.int64)
    for term, n in sums.collect():  # at most the vocabulary of one group of items
        df[term] = n
    return int(df[size]), int(df[size + 1]), df[:size]


def tiles_of(items: list[dict[int, int]], weights: np.ndarray) -> list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """``first item, [(columns, counts)]``: for each tile of items its vocabulary tiles
    and the float64 matrix of items by columns. No sum over a tile's columns can reach
    2**53; a term repeated so often that it could alone has several columns."""
    out = []
    for first in range(0, len(items), ITEM_TILE):
        part = items[first : first + ITEM_TILE]
        tiles, columns, held, bound = [], [], [], np.zeros(len(part), np.float64)

        def close() -> None:
            if columns:
                tiles.append((np.array(columns), np.array(held).T.copy()))

        for t in sorted({t for item in part for t in item if weights[t] > 0}):
            left = np.array([item.get(t, 0) for item in part], np.int64)
            most = (EXACT - 1) // (int(weights[t]) * UNIT)
            while left.any():
                now = np.minimum(left, most)
                reach = now * float(int(weights[t]) * UNIT)
                if len(columns) == VOCABULARY_TILE or (bound + reach).max() >= EXACT:
                    close()
                    columns, held, bound = [], [], np.zeros(len(part), np.float64)
                columns.append(t)
                held.append(now.astype(float))
                bound = bound + reach
                left = left - now
        close()
        out.append((first, tiles))
    return out


def lengths(n: list[int], n_docs: int, n_terms: int) -> np.ndarray:
    return np.array([75 + (25 * v * n_docs) // n_terms for v in n], np.int64)


def best_of_blocks(bags: DataFrame, items: list[dict[int, int]], k: int) -> DataFrame:
    """``item, id, score``: the ``k`` best documents of each task for each item."""
    size = 1 + max((t for item in items for t in item), default=0)
    n_docs, n_terms, df = corpus_counts(bags, size)
    weights = np.array([weight(n_docs, int(d)) if d else 0 for d in df], np.int64)
    tiles = tiles_of(items, weights)
    widest = max((len(c) for _, parts in tiles for c, _ in parts), default=1)
    block = max(16, DENSE // widest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]  # (-score, id is null, id), the best first
        local = np.full(size, -1, np.int64)

        def keep(item: int, scores: np.ndarray, ids: list) -> None:
            least = -best[item][-1][0] if len(best[item]) == k else 1
            at = np.flatnonzero(scores >= least)
            if len(at) > k:
                at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
            if len(at):
                new = [(-int(scores[a]), ids[a] is None, ids[a] or 0) for a in at]
                best[item] = heapq.nsmallest(k, best[item] + new)

        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                doc_ids = part.column("id").to_pylist()
                found = [np.frombuffer(b, "<u4") for b in part.column("ids").to_pylist()]
                counts = part.column("counts").to_pylist()
                tf = [np.frombuffer(b, f"<u{len(b) // len(f)}").astype(np.int64) if len(f) else np.zeros(0, np.int64) for f, b in zip(found, counts)]
                per = np.array([len(f) for f in found])
                col, tf = np.concatenate(found).astype(np.int64), np.concatenate(tf)
                row = np.repeat(np.arange(len(per)), per)
                m = lengths(part.column("n").to_pylist(), n_docs, n_terms)[row]
                impact = (weights[col] * ((10**9 * tf) // (1000 * tf + 12 * m))).astype(float)
                for first, parts in tiles:
                    scores = None
                    for columns, matrix in parts:
                        local[columns] = np.arange(len(columns))
                        dense = np.zeros((len(per), len(columns)))
                        at = local[col]
                        hit = at >= 0
                        dense[row[hit], at[hit]] = impact[hit]
                        for twin in np.flatnonzero(columns[1:] == columns[:-1])[::-1]:
                            dense[:, twin] = dense[:, twin + 1]
                        product = (matrix @ dense.T).astype(np.int64)
                        scores = product if scores is None else scores + product
                        local[columns] = -1
                    for i in range(0 if scores is None else len(scores)):
                        keep(first + i, scores[i], doc_ids)
        flat = [(i, None if null else d, -s) for i, b in enumerate(best) for s, null, d in b]
        columns = [pa.array([r[c] for r in flat], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "id", "score"])

    return bags.mapInArrow(run, "item long, id long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``item, rank, id, score`` (named by ``item_col`` and ``id_col``): for each row of
    ``items`` the ``k`` documents of the highest score above 0, equal scores by
    ascending id (a null id last), ranks from 1.

    Ids are longs; they may be null or repeat (each row is a document of its own),
    item ids may be of any type and repeat (each row is ranked by itself). Null and
    empty texts have no terms: such documents count nowhere, such items find nothing.
    Texts may be of any length. Other columns are not read. Empty tables give no rows."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType
    found = None

    def run_group(group: list[tuple]) -> None:
        nonlocal found
        bags = [terms(text) for _, text in group]
        vocabulary = sorted(set().union(*bags))
        place = {t: i for i, t in enumerate(vocabulary)}
        counts = [{place[t]: c for t, c in bag.items()} for bag in bags]
        table = materialize(bag_table(docs, vocabulary, id_col, text_col), "search-bags")
        best = best_of_blocks(table, counts, k)
        order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
        salted = best.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        for keys in (["item", "salt"], ["item"]):
            salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, g[0]) for i, g in enumerate(group)], f"item long, name {kind.simpleString()}")
        # one row an item of a group that is bounded by the bytes of its texts
        ranked = salted.join(F.broadcast(names), "item").select(
            F.col("name").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        found = ranked if found is None else found.unionByName(ranked)

    group, held = [], 0
    for row in items.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{item_text_col}`").alias("t")).where("t is not null").toLocalIterator():
        group.append((row["i"], row["t"]))
        held += len(row["t"].encode()) + 64
        if held >= GROUP_BYTES:
            run_group(group)
            group, held = [], 0
    if group:
        run_group(group)
    if found is None:
        return spark.createDataFrame([], f"`{item_col}` {kind.simpleString()}, rank int, `{id_col}` long, score long")
    return found
