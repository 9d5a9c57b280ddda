"""Exact Jaccard join of documents' word shingles in metric space.

Jaccard distance is a metric, so pivots bound distances that are not computed.
Two documents without a common shingle are at distance 1, and so is nearly
every document from any few pivots: pivots chosen from the whole corpus cut
nothing. The join therefore begins with small pivots and goes on with documents.

1. Sets. Equal shingle sets are one point (by a 64-bit hash; two sets that
   share it stop the join instead of being mixed up). A point with more than
   n (1 - t) shingles that no other point has is at more than 1 - t from all
   others: it links with nothing and goes no further. Shingles are counted for
   a fixed share of the shingle space, which can only keep points, not lose them.
2. Root regions. The shingle space is cut into as many parts as two linked sets
   of that size can differ in, and one more (a little more for sets that leave
   parts empty): linked sets agree on a whole part. A part's content is a pivot
   set at distance 0, and the points that have it are its region. Shingles that
   very many documents have are left out where a set has enough others, so that
   a passage that many documents share makes no region. Sizes come in
   classes; a point is replicated to the class above if a partner can be there,
   the window |x| >= t |y| that the triangle inequality gives for the empty set
   as a pivot. Points that share a good part of their regions, directly or through
   others, are a core. A point with more than n (1 - t) shingles that only its core
   has links with no other core; cores of the other points are joined where
   these share a region. That makes components; no link leaves one.
3. Voronoi regions. A component of more than ``leaf_points`` points is cut by
   document pivots: each point belongs to its nearest pivot p and is replicated
   to the region of q if d(x, q) <= d(x, p) + 2 eps and d(x, q) <= r_q + eps,
   with r_q the radius of q's region and eps = 1 - t. Points at 1 - eps or more
   from each pivot form a region of their own; those near it, beyond
   1 - 2 eps, are replicated to that. Regions are cut again until they are small
   enough. A cut is made only if all its rows are at most ``SPREAD`` times the
   points at home in the region; each point is at home once, so no level has more
   than ``SPREAD`` times the points. A region that is not cut, and a new one with
   more than half of its parent's rows, is compared in blocks.
4. Leaves. In a leaf the points of few pivots are windows again: x and y link
   only if |d(x, p) - d(y, p)| <= eps for each p. What passes is counted exactly.

Every point sees all its links in the leaf it belongs to, so links are counted
exactly once from each end, and the links of all leaves form the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import materialize as written
from textmill.llm.words import mix, shingle_hashes, word_hashes

#: Families of partitions tried for sets that leave parts empty; the last counts empty parts as equal.
FAMILIES = 10
#: Shingles that a part of the smaller set of a pair has on average, at least.
PART_SHINGLES = 2.5
#: Rows that a cut may make for each point at home; beyond it the region is compared in blocks.
SPREAD = 4
#: A point is in the core of another one that is first in one of CORE of its regions.
CORE = 20
_GOLD = 0x9E3779B97F4A7C15


#: Whether Spark removes a query's shuffle files when it ends; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back; shuffle files of one step go before the next one."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(_CLEANUP, before)


class Threshold:
    """``100 * |x & y| >= percent * |x | y|`` and what follows from it."""

    def __init__(self, percent: int):
        self.percent = percent
        # a class spans about two steps of the window, or less where parts would get
        # so small that many are empty: a pair's smaller set has t times the class's
        # first size at least, and the class's last size says how many parts there are
        t = percent / 100
        growth = min(t**-2, t / (2 * (1 - t) / (1 + t) * 9 / 8 * PART_SHINGLES)) if percent < 100 else 2.0
        self.bounds = [1]  # first size of each class
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * growth)))
        self.starts = np.array(self.bounds, np.int64)

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def classes(self, n: int) -> range:
        """Classes of the larger set of a pair whose smaller set has ``n``."""
        return range(self.size_class(n), self.size_class(n * 100 // self.percent) + 1)

    def differ(self, size_class: int) -> int:
        """The most shingles in which linked sets differ, if the larger is of the class."""
        largest = self.bounds[size_class + 1] - 1
        return 2 * largest * (100 - self.percent) // (100 + self.percent)

    def linked(self, common, n, m):
        return 100 * common >= self.percent * (n + m - common)


def region_keys(shingles: np.ndarray, th: Threshold, common: np.ndarray) -> np.ndarray:
    """Keys of the root regions of a set (ascending distinct hashes).

    ``common`` (ascending) are shingles that many documents have. Linked sets
    differ in no more of their other shingles than of all, so where a set has
    enough others they alone are cut into parts. Sets near that bound have
    the keys of both ways, so that a pair always meets in one of them."""
    n = len(shingles)
    out = []
    at = np.searchsorted(common, shingles)
    known = np.zeros(n, bool)
    inside = at < len(common)
    known[inside] = common[at[inside]] == shingles[inside]
    rest = shingles[~known]
    for c in th.classes(n) if n else ():
        differ = th.differ(c)
        if differ == 0:
            continue  # only equal sets link
        enough = 3 * (differ + 1)
        if len(rest) >= enough:
            out += part_keys(rest, c, differ, 0)
        if len(rest) < enough + differ:
            out += part_keys(shingles, c, differ, 1)
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def part_keys(h: np.ndarray, size_class: int, differ: int, way: int) -> list[np.ndarray]:
    """Keys of the parts of a set, of which sets that differ in ``differ`` at most share one.

    There are ``spare`` parts more than the argument needs, so that as many may be
    empty. A set with more empty ones has keys of another partition too; linked
    sets meet in the first partition in which one of them has enough filled
    parts, or in the last, where empty parts are keys as well."""
    out, n = [], len(h)
    spare = differ // 8
    parts = differ + 1 + spare
    for family in range(FAMILIES):
        cut = np.searchsorted((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1).astype(np.uint64))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(_GOLD)), out=total[1:])
        content = total[cut[1:]] - total[cut[:-1]]
        filled = cut[1:] > cut[:-1]
        last = family == FAMILIES - 1
        tag = np.uint64((size_class * 2 + way) * FAMILIES + family << 32) + np.arange(parts).astype(np.uint64)
        keys = mix(content + mix(tag + np.uint64(1)))
        out.append(keys if last else keys[filled])
        if parts - int(filled.sum()) <= spare:
            break
        h = np.sort(mix(h + np.uint64(family + 1)))
    return out


def common_shingles(
    docs: DataFrame, id_col: str, text_col: str, words: int, one_in: int = 16, least: int = 3, most: int = 1 << 20
) -> np.ndarray:
    """Shingles that at least ``least`` of one document in ``one_in`` have, the
    ``most`` most frequent of them, ascending.

    Which shingles these are changes only how many candidates meet, not what is
    linked: any fixed list gives the same join. So a sample by id and a bound on
    the list (8 MB, broadcast) are allowed here."""
    ident = F.col(f"`{id_col}`")
    drawn = docs.where(F.pmod(F.xxhash64(ident, F.lit("common")), F.lit(one_in)) == 0)
    rows = drawn.select(F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                sets = [shingles_of(t.as_py(), words) for t in whole.slice(at, 500).column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["s"])

    counts = rows.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    top = counts.orderBy(F.desc("c"), "s").limit(most).select("s")
    return np.sort(np.array([r[0] for r in top.collect()], np.int64).view(np.uint64))


def shingles_of(text: str | None, size: int) -> np.ndarray:
    return shingle_hashes(word_hashes((text or "").encode())[0], size)


def set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a whole set, as signed integers."""
    a = mix(np.array([mix(shingles).sum() + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0]
    b = mix(shingles ^ np.uint64(0xD6E8FEB86659FD93)).sum().view(np.int64)
    return int(a), int(b)


def point_table(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id, h, n, point, check`` for each row: a hash of its text, and size and two
    hashes of its set. One pass over the texts; nothing is shuffled."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for t in batch.column(1):
                s = shingles_of(t.as_py(), words)
                got.append((len(s), *(set_hashes(s) if len(s) else (0, 0))))
            n, a, b = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                names=["id", "h", "n", "point", "check"],
            )

    schema = f"id {dict(rows.dtypes)['id']}, h long, n long, point long, check long"
    return rows.mapInArrow(run, schema)


def low_shingles(percent: int) -> np.uint64:
    """The end of the lowest ``2 (1 - t)`` of the hash space."""
    return np.uint64(min(2**64 - 1, int(2**64 * 2 * (100 - percent) / 100)))


def own_shingles(docs: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    """``point, own``: how many shingles a point has that no other point has, counted
    in the lowest ``2 (1 - t)`` of the hash space, so that a point whose shingles
    are its own by half can be told. Counts are partial before they move; of
    equal sets in one partition only the first is counted."""
    top = low_shingles(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                points, low = [], []
                for t in whole.slice(at, 500).column(0):
                    s = shingles_of(t.as_py(), words)
                    if not len(s) or (p := set_hashes(s)[0]) in seen:
                        continue
                    seen.add(p)
                    s = s[: np.searchsorted(s, top)]
                    points.append(np.full(len(s), p, np.int64))
                    low.append(s.view(np.int64))
                if low:
                    cols = [pa.array(np.concatenate(low)), pa.array(np.concatenate(points))]
                    yield pa.RecordBatch.from_arrays(cols, names=["s", "point"])

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "s long, point long")
    owner = rows.groupBy("s").agg(F.min("point").alias("point"), F.max("point").alias("other")).where("point = other")
    return owner.groupBy("point").agg(F.count("*").alias("own"))


def smallest_reachable(edges: DataFrame, name: str) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)``: the smallest node that is
    reachable. In each round a node and its label take the smallest label among
    the node's neighbours (so whole trees hang on to smaller ones), then every
    node takes its label's label. Rounds are written to the shared folder and
    end when none changes; their number grows with the logarithm of the longest
    path. Labels move as partial minima, so a node with very many links is no
    single group."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    both = materialize(both.distinct(), f"{name}-edges")
    labels = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
    labels = materialize(labels, f"{name}-labels")
    while True:
        seen = both.join(labels.withColumnsRenamed({"node": "v"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(seen, "node")
        lower = F.least("root", "near")
        told = F.explode(F.array(
            F.struct(F.col("node").alias("to"), lower.alias("label"), F.col("root").alias("old")),
            F.struct(F.col("root").alias("to"), lower.alias("label"), F.lit(None).cast("long").alias("old")),
        ))
        hung = step.select(told.alias("t")).groupBy(F.col("t.to").alias("node")).agg(F.min("t.label").alias("root"), F.max("t.old").alias("old"))
        jump = hung.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = hung.join(jump, "root").select("node", "old", F.least("root", "far").alias("root"))
        new = materialize(new, f"{name}-labels")
        if new.where("old <> root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def region_rows(sets: DataFrame, percent: int, common: np.ndarray) -> DataFrame:
    """``(node, key)``: the keys of the root regions of ``sets(node, shingles)``."""
    shared = sets.sparkSession.sparkContext.broadcast(common)  # of bounded length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        th = Threshold(percent)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                nodes, keys = [], []
                part = whole.slice(at, 500)
                for p, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    k = region_keys(np.frombuffer(b, "<u8"), th, shared.value)
                    nodes.append(np.full(len(k), p, np.int64))
                    keys.append(k)
                if keys:
                    cols = [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(keys))]
                    yield pa.RecordBatch.from_arrays(cols, names=["node", "key"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, key long")


def region_stars(rows: DataFrame) -> DataFrame:
    """``(a, b)`` for each of ``rows(node, key)``: the key's first node and the row's own."""
    # a region's nodes in order of their number: the window streams, it holds one
    # 16-byte row at a time
    first = F.first("node").over(Window.partitionBy("key").orderBy("node"))
    return rows.select(first.alias("a"), F.col("node").alias("b"))


def open_points(cored: DataFrame, percent: int) -> DataFrame:
    """``point``: those of ``cored(core, point, shingles)`` that may link with a point
    of another core. As in ``own_shingles``, a point links with none if it has more than
    n (1 - t) shingles that only points of its core have."""
    top = low_shingles(percent)

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                sets = [np.frombuffer(b, "<u8") for b in part.column(2).to_pylist()]
                sets = [x[: np.searchsorted(x, top)].view(np.int64) for x in sets]
                if sets:
                    held = [len(x) for x in sets]
                    cols = [np.concatenate(sets), *(np.repeat(part.column(i).to_numpy(), held) for i in (0, 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["s", "core", "point"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sets = [np.frombuffer(b, "<u8") for b in part.column(1).to_pylist()]
            cols = [part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([int(np.searchsorted(x, top)) for x in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["point", "n", "low"])

    rows = cored.select("core", "point", "shingles").mapInArrow(low, "s long, core long, point long")
    mixed = rows.groupBy("s").agg(F.min("core").alias("core"), F.max("core").alias("other")).where("core <> other")
    mixed = mixed.select(F.col("s").alias("m_s"))
    shared = rows.select("s", "point").join(mixed, F.col("s") == F.col("m_s"), "left_semi").groupBy("point").agg(F.count("*").alias("shared"))
    sizes = cored.select("point", "shingles").mapInArrow(count, "point long, n long, low long")
    own = F.col("low") - F.coalesce("shared", F.lit(0))
    return sizes.join(shared, "point", "left").where(100 * (F.col("n") - own) >= percent * F.col("n")).select("point")


def root_members(kept: DataFrame, percent: int, common: np.ndarray) -> DataFrame:
    """``kept`` with the component of each point: points that share a root region,
    directly or through others, unless they are known not to link.

    Points that share a good part of their regions are a core. Sets that have only
    a common passage or a few common words in a region would tie all cores to
    one component, which grows faster than the corpus; so, of points of different
    cores, only open ones are tied by their regions."""
    stars = region_stars(region_rows(kept.withColumnRenamed("point", "node"), percent, common))
    stars = materialize(stars.groupBy("a", "b").agg(F.count("*").alias("keys")), "jaccard-stars")
    total = stars.groupBy(F.col("b").alias("t_b")).agg(F.sum("keys").alias("total"))
    stars = stars.where("a <> b")
    strong = stars.join(total, F.col("b") == F.col("t_b")).where(CORE * F.col("keys") >= F.col("total"))
    cores = smallest_reachable(strong.select("a", "b"), "jaccard-cores")
    met = stars.select(F.explode(F.array("a", "b")).alias("met")).distinct()
    label = met.join(cores, F.col("met") == F.col("node"), "left").select("met", F.coalesce("root", "met").alias("core"))
    cored = kept.join(label, F.col("point") == F.col("met")).select("core", "point", "copies", "shingles")
    cored = materialize(cored, "jaccard-cored")
    loose = materialize(open_points(cored, percent), "jaccard-open")
    sets = cored.join(loose, "point", "left_semi").select(F.col("core").alias("node"), "shingles")
    ties = region_stars(region_rows(sets, percent, common)).where("a <> b").distinct()
    roots = smallest_reachable(ties, "jaccard-regions")
    members = cored.join(roots, F.col("core") == F.col("node"), "left")
    return members.select(F.coalesce("root", "core").alias("region"), "point", F.lit(True).alias("home"), "copies", "shingles")


def distances(th: Threshold, sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """Jaccard distances of each set from each pivot."""
    out = np.ones((len(sets), len(pivots)))
    for j, p in enumerate(pivots):
        for i, s in enumerate(sets):
            common = np.intersect1d(s, p, assume_unique=True).size
            out[i, j] = 1 - common / max(1, len(s) + len(p) - common)
    return out


#: Entries of the dense part of a leaf, and rows of it that are multiplied at once.
DENSE, ROWS = 24_000_000, 256


def leaf_links(
    th: Threshold, points: np.ndarray, home: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, pivots: int = 8
) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a leaf that keep its components, and for each point the linked
    points' copies. Only points at home look for links.

    Common shingles are counted exactly: those that many points of the leaf have
    (near copies have nearly all of them) by a matrix product, the others by
    postings. Distances to a few pivots narrow first."""
    eps = 1 - th.percent / 100 + 1e-9
    n = len(points)
    sizes = np.array([len(s) for s in sets], np.int64)
    links = np.zeros(n, np.int64)
    if n < 2:
        return np.empty((0, 2), np.int64), links
    narrow = n > 64
    if narrow:
        chosen = np.linspace(0, n - 1, pivots).astype(int)
        far = distances(th, sets, [sets[i] for i in chosen])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    values, first = np.unique(flat, return_index=True)
    stop = np.append(first[1:], len(flat))
    held = stop - first
    often = np.flatnonzero(held >= max(64, n // 16))
    often = often[np.argsort(-held[often], kind="stable")][: DENSE // n]
    dense = np.zeros((n, len(often)), np.float32)
    for c, k in enumerate(often.tolist()):
        dense[owner[first[k] : stop[k]], c] = 1
    rare = np.ones(len(values), bool)
    rare[often] = False
    label = np.arange(n)
    at_home = np.flatnonzero(home)
    for start in range(0, len(at_home), ROWS):
        block = at_home[start : start + ROWS]
        product = dense[block] @ dense.T
        for x, shared in zip(block.tolist(), product):
            common = shared.astype(np.int64)
            at = np.searchsorted(values, sets[x])
            posts = [owner[first[k] : stop[k]] for k in at[rare[at]].tolist()]
            if posts:
                common += np.bincount(np.concatenate(posts), minlength=n)
            ok = (100 * np.minimum(sizes, sizes[x]) >= th.percent * np.maximum(sizes, sizes[x])) & (common > 0)
            if narrow:
                ok &= (np.abs(far - far[x]) <= eps).all(1)
            ok[x] = False
            found = np.flatnonzero(ok)
            found = found[th.linked(common[found], sizes[x], sizes[found])]
            links[x] = copies[found].sum()
            near = label[found]
            if len(near) and (near != label[x]).any():
                joined = np.unique(np.append(near, label[x]))
                label[np.isin(label, joined[1:])] = joined[0]
    joined = np.flatnonzero(label != np.arange(n))
    return np.stack([points[label[joined]], points[joined]], 1), links


LEAF = "a long, b long, links long"


def join_leaves(members: DataFrame, percent: int) -> DataFrame:
    """Links of ``members(region, point, home, copies, shingles)``: rows ``a <> b``
    are edges, rows ``a = b`` say how many documents the point's links reach."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        th = Threshold(percent)
        pdf = pdf.sort_values(["point", "home"], ascending=[True, False]).drop_duplicates("point")
        points = pdf["point"].to_numpy(np.int64)
        home = pdf["home"].to_numpy(bool)
        sets = [np.frombuffer(b, "<u8") for b in pdf["shingles"]]
        edges, links = leaf_links(th, points, home, sets, pdf["copies"].to_numpy(np.int64))
        a = np.concatenate([edges[:, 0], points[home]])
        b = np.concatenate([edges[:, 1], points[home]])
        return pd.DataFrame({"a": a, "b": b, "links": np.concatenate([np.zeros(len(edges), np.int64), links[home]])})

    return members.groupBy("region").applyInPandas(run, LEAF)


def block_pairs(members: DataFrame, sizes: DataFrame, leaf_points: int, leaf_shingles: int) -> DataFrame:
    """Members of regions that pivots do not shrink, dealt to pairs of blocks: block
    i is at home with each block j, so each point meets all others. Blocks are as
    many as the points and the shingles of ``sizes(region, count, weight)`` need.
    Returns the rows of leaves ``(region, i, j)``; a point's links add up over j."""
    need = F.greatest(F.ceil(F.col("count") / (leaf_points / 2)), F.ceil(F.col("weight") / (leaf_shingles / 2)))
    dealt = members.join(sizes, "region").withColumn("blocks", F.least(need, "count").cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("point", F.lit("block")), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    at_home = dealt.select("*", other.alias("j")).where("home or j = own").withColumn("leaf", F.xxhash64("region", "own", "j"))
    guests = dealt.select("*", other.alias("i")).where("i <> own").withColumn("leaf", F.xxhash64("region", "i", "own"))
    # a block's own points see each other once, where j = own
    return (
        at_home.withColumn("inner", F.col("j") == F.col("own"))
        .select(F.col("leaf").alias("region"), "point", "home", "copies", "shingles", "inner")
        .unionByName(
            guests.select(F.col("leaf").alias("region"), "point", F.lit(False).alias("home"), "copies", "shingles", F.lit(False).alias("inner"))
        )
    )


def join_blocks(members: DataFrame, percent: int) -> DataFrame:
    """As ``join_leaves`` for block pairs: points at home meet the guests, or each
    other where the block meets itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        th = Threshold(percent)
        pdf = pdf.sort_values("point").reset_index(drop=True)
        inner = bool(pdf["inner"].any())
        points, home = pdf["point"].to_numpy(np.int64), pdf["home"].to_numpy(bool)
        sets = [np.frombuffer(b, "<u8") for b in pdf["shingles"]]
        copies = pdf["copies"].to_numpy(np.int64)
        edges, links = leaf_links(th, points, home, sets, copies)
        if not inner:  # leave out links between points at home: the inner leaf has them
            same = leaf_links(th, points[home], np.ones(home.sum(), bool), [s for s, h in zip(sets, home) if h], copies[home])[1]
            links[home] -= same
        a = np.concatenate([edges[:, 0], points[home]])
        b = np.concatenate([edges[:, 1], points[home]])
        return pd.DataFrame({"a": a, "b": b, "links": np.concatenate([np.zeros(len(edges), np.int64), links[home]])})

    return members.groupBy("region").applyInPandas(run, LEAF)


def voronoi_step(members: DataFrame, percent: int, pivots: int, level: int) -> DataFrame:
    """Cut each region of ``members`` by ``pivots`` of its own points; rows of the
    new regions, with ``home`` true in exactly one region for each point that was
    at home. The cut is counted before a set is copied: a region whose cut makes
    more than ``SPREAD`` rows for each point at home stays as it is, with
    ``stalled`` true, which also marks new regions of more than half its rows."""
    eps = 1 - percent / 100
    order = Window.partitionBy("region").orderBy(F.xxhash64("point", F.lit(level)))
    narrow = members.select("region", "point").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= pivots)
    chosen = members.select("region", "point", "shingles").dropDuplicates(["region", "point"]).join(narrow, ["region", "point"])
    # ``pivots`` sets a region
    per = chosen.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("r", "shingles"))).alias("piv")).select("region", F.col("piv.shingles").alias("piv"))

    @F.pandas_udf("array<double>")
    def dist(sets: pd.Series, piv: pd.Series) -> pd.Series:
        th = Threshold(percent)
        return pd.Series([
            distances(th, [np.frombuffer(s, "<u8")], [np.frombuffer(p, "<u8") for p in ps])[0] for s, ps in zip(sets, piv)
        ])

    d = members.join(per, "region").withColumn("d", dist("shingles", "piv")).drop("piv")
    d = d.withColumn("near", F.array_min("d")).withColumn("p", (F.array_position("d", F.col("near")) - 1).cast("int"))
    d = d.withColumn("p", F.when(F.col("near") >= 1 - eps, F.lit(-1)).otherwise(F.col("p")))
    d = materialize(d, "jaccard-voronoi")
    radius = d.where("p >= 0 and home").groupBy("region", "p").agg(F.max("near").alias("radius"))
    per_region = radius.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("p", "radius"))).alias("radii"))
    d = d.join(per_region, "region", "left")
    slack = 1e-9

    def replicated(x, i):
        r = F.try_element_at("radii", i)
        return r.isNotNull() & (x <= F.col("near") + 2 * eps + slack) & (x <= r + eps + slack)

    to = F.filter(F.transform("d", lambda x, i: F.when(replicated(x, i) & (i != F.col("p")), i)), lambda i: i.isNotNull())
    far = F.when((F.col("p") >= 0) & (F.col("near") >= 1 - 2 * eps - slack), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    targets = F.concat(F.array(F.struct(F.col("p").alias("q"), F.col("home").alias("home"))), F.transform(F.concat(to, far), lambda q: F.struct(q.alias("q"), F.lit(False).alias("home"))))
    d = d.withColumn("targets", targets)
    parts = d.select("region", F.explode("targets").alias("t")).groupBy("region", "t.q").agg(
        F.count("*").alias("rows"), F.sum(F.col("t.home").cast("long")).alias("homes")
    )
    # a region without a point at home finds nothing
    parts = parts.where("homes > 0").join(members.groupBy("region").agg(F.count("*").alias("before")), "region")
    # ``pivots`` + 1 entries a region
    stalled = F.map_from_entries(F.collect_list(F.struct("q", F.col("rows") * 2 > F.col("before"))))
    fate = parts.groupBy("region").agg((F.sum("rows") <= SPREAD * F.sum("homes")).alias("cut"), stalled.alias("parts"))
    into = F.transform(F.filter("targets", lambda t: F.map_contains_key("parts", t["q"])), lambda t: F.struct(
        F.xxhash64("region", t["q"], F.lit(level)).alias("region"), t["home"].alias("home"), F.try_element_at("parts", t["q"]).alias("stalled")
    ))
    stay = F.array(F.struct("region", "home", F.lit(True).alias("stalled")))
    out = d.join(materialize(fate, "jaccard-cuts"), "region").withColumn("t", F.explode(F.when(F.col("cut"), into).otherwise(stay)))
    return out.select("t.region", "point", "t.home", "copies", "shingles", "t.stalled")


def links_of(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    percent: int = 85,
    leaf_points: int = 16_000,
    leaf_shingles: int = 6_000_000,
    pivots: int = 16,
    levels: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """``(points, found)``: the point of each row, and the leaves' edges and counts."""
    common = common_shingles(docs, id_col, text_col, words)
    points = materialize(point_table(docs, id_col, text_col, words), "jaccard-points")
    sets = points.where("n > 0").groupBy("point").agg(
        F.min(F.struct("id", "h")).alias("carrier"), F.count("*").alias("copies"), F.max("n").alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1")
    )
    sets = materialize(sets, "jaccard-sets")
    if not sets.where("c0 <> c1").isEmpty():
        raise ValueError("two different shingle sets share a 64-bit hash; join them under another hash")
    own = own_shingles(docs, text_col, words, percent).withColumnRenamed("point", "o_point")
    near = sets.join(own, F.col("point") == F.col("o_point"), "left")
    near = near.where(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= percent * F.col("n"))
    carriers = near.select(F.col("carrier.id").alias("c_id"), F.col("carrier.h").alias("c_h"), F.col("point").alias("c_point"), "copies")
    carriers = materialize(carriers, "jaccard-carriers")
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    # carriers grow with the corpus: always a shuffle join, at every size the same plan;
    # by id and text hash, so that rows of one id (or none) do not all meet its carriers
    texts = docs.select(ident.alias("id"), text.alias("text"), F.xxhash64(text).alias("h")).join(
        carriers.hint("merge"), F.col("id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h"))
    )

    def sets_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                got = [shingles_of(t.as_py(), words) for t in batch.column(0)]
                same = [len(s) > 0 and set_hashes(s)[0] == p for s, p in zip(got, batch.column(1).to_pylist())]
                made = pa.array([s.astype("<u8").tobytes() for s in got], pa.binary())
                out = pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), made], names=["point", "copies", "shingles"])
                yield out.filter(pa.array(same, pa.bool_()))

    kept = texts.select("text", "c_point", "copies").mapInArrow(sets_again, "point long, copies long, shingles binary")
    kept = materialize(kept.dropDuplicates(["point"]), "jaccard-kept")
    members = root_members(kept, percent, common)
    members = materialize(members.withColumn("stalled", F.lit(False)), "jaccard-members")
    found = None

    def add(rows: DataFrame, name: str) -> None:
        nonlocal found
        rows = materialize(rows, name)
        found = rows if found is None else found.unionByName(rows)

    for level in range(levels + 1):
        weight = F.sum(F.octet_length("shingles") / 8).alias("weight")
        sizes = members.groupBy("region").agg(F.count("*").alias("count"), weight, F.max("stalled").alias("last"))
        sizes = materialize(sizes.withColumn("last", F.col("last") | F.lit(level == levels)), "jaccard-region-sizes")
        small = (F.col("count") <= leaf_points) & (F.col("weight") <= leaf_shingles)
        # one point alone links with nothing
        fits, large = sizes.where(small & (F.col("count") > 1)).select("region"), sizes.where(~small)
        add(join_leaves(members.join(fits, "region"), percent), "jaccard-links")
        if large.isEmpty():
            break
        whole = large.where("last").select("region", "count", "weight")
        if not whole.isEmpty():
            rest = members.join(whole.select("region"), "region")
            add(join_blocks(block_pairs(rest, whole, leaf_points, leaf_shingles), percent), "jaccard-links")
        again = large.where(~F.col("last")).select("region")
        if again.isEmpty():
            break
        members = materialize(voronoi_step(members.join(again, "region"), percent, pivots, level), "jaccard-members")
    return points, found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, n_links``.

    ``component_id`` is the smallest id reachable by links, itself included;
    ``n_links`` the number of other rows that the row links with. Rows without
    words link with nothing: each is its own component. Rows that repeat an id
    and text link with each other. A null id takes part; a component of null ids
    only has a null id."""
    points, found = links_of(docs, id_col, text_col, **how)
    edges = found.where("a <> b").select("a", "b")
    labels = smallest_reachable(edges, "jaccard-components")
    degree = found.where("a = b").groupBy(F.col("a").alias("d_point")).agg(F.sum("links").alias("links"))
    has = points.where("n > 0").select("id", "n", "point")
    sets = has.groupBy("point").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    sets = sets.join(labels, F.col("point") == F.col("node"), "left").withColumn("root", F.coalesce("root", "point"))
    sets = sets.join(degree, F.col("point") == F.col("d_point"), "left")
    sets = sets.select("point", "least", "root", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    sets = materialize(sets, "jaccard-classes")
    smallest = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = sets.join(smallest, "root").select("point", "component_id", "n_links")
    out = has.join(classes, "point").select("id", "n", "component_id", "n_links")
    alone = points.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = out.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")
