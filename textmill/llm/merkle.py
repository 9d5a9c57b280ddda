"""Merkle fixity audit of WARC archives.

Records are hashed, and the hashes of the records that begin in one range of
``leaf_bytes`` of the archive are hashed in offset order to a leaf. ``fanout``
neighbouring nodes make a node of the next level, up to one root an archive.
Two replicas are compared from their roots: only the children of a node whose
hashes differ are looked at, down to the leaves, and only records of leaves that
differ are compared one by one.

A node's group is bounded by ``leaf_bytes`` or ``fanout``, so an archive of any
size is spread over many tasks. Nodes are written by level, so a comparison
reads one level at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import materialize


def warc_record(url: Column, record_id: Column, body: Column) -> Column:
    """One response record: version line, headers, blank line, block, two line ends."""
    block = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
        F.lit("\r\n\r\n"),
    ).cast("binary")


def digests(records: DataFrame) -> DataFrame:
    """``archive, offset, length, digest`` of ``records(archive, offset, payload)``.

    A null payload is empty. A record that repeats archive, offset and payload
    counts once; several payloads at one offset are all kept, in hash order."""
    payload = F.coalesce("payload", F.lit("").cast("binary"))
    return records.select(
        "archive",
        F.col("offset").cast("long").alias("offset"),
        F.octet_length(payload).cast("long").alias("length"),
        F.sha2(payload, 256).alias("digest"),
    ).distinct()


def _fold(children: DataFrame, group: list[str], order: str, *more: Column) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda c: F.concat(c[order].cast("string"), F.lit(":"), c["digest"])), "\n")
    return children.groupBy(*group).agg(F.sha2(joined.cast("binary"), 256).alias("digest"), *more)


def tree(hashed: DataFrame, leaf_bytes: int = 1 << 20, fanout: int = 16, name: str = "merkle") -> DataFrame:
    """``archive, level, node, digest, n_records``: all nodes of all archives, from
    the leaves (level 0) to the level where every archive has one node, 0."""
    level = 0
    nodes = _fold(
        hashed.withColumn("node", F.floor(F.col("offset") / leaf_bytes).cast("long")),
        ["archive", "node"],
        "offset",
        F.count("*").alias("n_records"),
    )
    nodes = materialize(nodes.withColumn("level", F.lit(0)), f"{name}-0")
    every = nodes
    while (top := nodes.agg(F.max("node")).first()[0]) is not None and top > 0:
        level += 1
        up = nodes.select("archive", F.floor(F.col("node") / fanout).cast("long").alias("parent"), "node", "digest", "n_records")
        up = _fold(up, ["archive", "parent"], "node", F.sum("n_records").alias("n_records"))
        nodes = materialize(up.withColumnRenamed("parent", "node").withColumn("level", F.lit(level)), f"{name}-{level}")
        every = every.unionByName(nodes)
    return every


def differing_leaves(a: DataFrame, b: DataFrame, fanout: int = 16) -> DataFrame:
    """``archive, node`` of the leaves whose digests differ between two trees, or
    that only one has, found from the roots down."""

    def level_of(t: DataFrame, n: int) -> DataFrame:
        return t.where(F.col("level") == n).select("archive", "node", "digest")

    high = [t.agg(F.max("level")).first()[0] for t in (a, b)]
    level = max((x for x in high if x is not None), default=-1)
    suspects = None
    while level >= 0:
        x, y = level_of(a, level), level_of(b, level).withColumnRenamed("digest", "other")
        if suspects is not None:
            x = x.join(suspects, ["archive", "node"], "left_semi")
            y = y.join(suspects, ["archive", "node"], "left_semi")
        bad = x.join(y, ["archive", "node"], "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select("archive", "node")
        bad = materialize(bad, "merkle-suspects")
        if level == 0:
            return bad
        child = F.explode(F.sequence(F.col("node") * fanout, F.col("node") * fanout + (fanout - 1)))
        suspects = bad.select("archive", child.alias("node"))
        level -= 1
    return a.select("archive", "node").limit(0)


def corrupt_records(a: DataFrame, b: DataFrame, leaves: DataFrame, leaf_bytes: int = 1 << 20) -> DataFrame:
    """``archive, offset, status``: records of the named leaves that are ``changed``,
    ``missing`` in replica ``b`` or ``extra`` there. Several payloads at one offset
    are one entry; without leaves there are no rows."""

    def within(t: DataFrame) -> DataFrame:
        node = F.floor(F.col("offset") / leaf_bytes).cast("long")
        t = t.withColumn("node", node).join(leaves, ["archive", "node"], "left_semi")
        # several payloads at one offset are one entry
        return t.groupBy("archive", "offset").agg(F.array_sort(F.collect_list("digest")).alias("digest"))

    both = within(a).join(within(b).withColumnRenamed("digest", "other"), ["archive", "offset"], "full")
    status = (
        F.when(F.col("other").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("digest") != F.col("other"), "changed")
    )
    return both.withColumn("status", status).where("status is not null").select("archive", "offset", "status")


def audit(
    replica_a: DataFrame, replica_b: DataFrame, leaf_bytes: int = 1 << 20, fanout: int = 16
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare two replicas ``(archive, offset, payload)``, as ``audit_digests`` does."""
    return audit_digests(digests(replica_a), digests(replica_b), leaf_bytes, fanout)


def audit_digests(
    hashed_a: DataFrame, hashed_b: DataFrame, leaf_bytes: int = 1 << 20, fanout: int = 16
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare two replicas by the digests of their records ``(archive, offset,
    length, digest)``: the roots ``archive, root_a, root_b`` (null where a replica
    lacks the archive), the leaves that differ, and the records that do. Empty
    replicas have no roots."""
    hashed = [materialize(h, f"merkle-digests-{i}") for i, h in enumerate((hashed_a, hashed_b))]
    trees = [tree(h, leaf_bytes, fanout, f"merkle-{i}") for i, h in enumerate(hashed)]
    leaves = differing_leaves(*trees, fanout)
    bad = corrupt_records(*hashed, leaves, leaf_bytes)

    def roots(t: DataFrame, name: str) -> DataFrame:
        top = t.groupBy("archive").agg(F.max(F.struct("level", "digest", "n_records")).alias("top"))
        return top.select("archive", F.col("top.digest").alias(f"root_{name}"), F.col("top.n_records").alias(f"n_{name}"))

    return roots(trees[0], "a").join(roots(trees[1], "b"), "archive", "full"), leaves, bad


#: Archives that share the pages without an id.
LOOSE = 4096


def rendered(pages: DataFrame, pages_each: int = 500) -> DataFrame:
    """``page_id, archive, payload, length, digest``: pages rendered as WARC records, a
    fixed number of consecutive ids to an archive. Pages without an id go to
    ``LOOSE`` archives below 0 by their digest."""
    body = warc_record(F.col("url"), F.col("page_id"), F.col("html"))
    rows = pages.select("page_id", body.alias("payload"))
    rows = rows.select("page_id", "payload", F.octet_length("payload").cast("long").alias("length"), F.sha2("payload", 256).alias("digest"))
    loose = -1 - F.pmod(F.crc32("digest"), F.lit(LOOSE))
    return rows.withColumn("archive", F.coalesce(F.floor(F.col("page_id") / pages_each).cast("long"), loose))


def with_offsets(records: DataFrame) -> DataFrame:
    """``records(page_id, archive, length, digest, ...)`` with ``offset``: the bytes
    before each record of its archive, in the order of ids, then digests. Only the
    columns that ``records`` has are shuffled: leave payloads out where their
    lengths and digests do."""
    order = Window.partitionBy("archive").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))


def archives_of(pages: DataFrame, pages_each: int = 500) -> DataFrame:
    """``page_id, archive, offset, payload``: the archives of ``rendered`` pages."""
    return with_offsets(rendered(pages, pages_each)).select("page_id", "archive", "offset", "payload")
