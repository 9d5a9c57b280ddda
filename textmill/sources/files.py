"""File sources: list a tree of files with their bytes, decode them as text.

``scan_files`` gives ``files(project, path, length, content)`` for a file, a
folder (every file below it) or a glob. The folder case is a Python Data
Source (``filetree``): the driver lists directories only, breadth first, until
there are enough sub-trees for the cluster (``target_partitions``); each
becomes one input partition and the executors walk their own sub-tree,
pruning excluded folders while walking; a folder with more than
``files_per_partition`` files of its own is split into hash shards. Unlike
``binaryFile`` it keeps names starting with '.' or '_' (``.env``,
``__init__.py``) when ``include_hidden`` is set.

Spark's own ``binaryFile`` source is the fast path for very large trees
where hidden files do not matter: ``fast_scan``.
"""

from __future__ import annotations

import glob as _glob
import os
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.corpus import LISTING_EXCLUDES

SCHEMA = "project string, path string, length bigint, content binary"
FILES_PER_GLOB_PARTITION = 1000


class _Part(InputPartition):
    def __init__(self, kind: str, value):
        super().__init__(value)
        self.kind = kind  # "top" files of the root, "dir" a sub-tree, "list" explicit files
        self.value = value


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_")


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path")
        self.glob = options.get("glob")
        self.project = options.get("project") or ""
        self.exclude = [s for s in options.get("exclude", "").split(",") if s]
        self.include_hidden = options.get("include_hidden", "true") == "true"
        self.with_content = options.get("content", "true") == "true"
        self.target = int(options.get("target_partitions", "64"))
        self.max_expand = int(options.get("max_expand", "10000"))
        self.files_per_part = int(options.get("files_per_partition", "10000"))

    def _skip(self, name: str) -> bool:
        return name in self.exclude or (not self.include_hidden and _hidden(name))

    def partitions(self):
        if self.glob:
            matches = sorted(m for m in _glob.glob(self.glob, recursive=True) if os.path.isfile(m))
            chunks = [matches[i:i + FILES_PER_GLOB_PARTITION]
                      for i in range(0, len(matches), FILES_PER_GLOB_PARTITION)]
            return [_Part("list", c) for c in chunks] or [_Part("list", [])]
        if os.path.isfile(self.root):
            return [_Part("list", [self.root])]
        # Breadth-first over directories only (never files) until there are
        # enough sub-trees to keep every executor busy, so one huge folder
        # does not become one task. Each expanded folder contributes its own
        # files as one partition; each frontier folder is walked by a task.
        expanded, frontier, parts = [], [self.root], []
        while frontier and len(frontier) < self.target and len(expanded) < self.max_expand:
            d = frontier.pop(0)
            expanded.append(d)
            n_files, subs = 0, []
            with os.scandir(d) as it:
                for e in it:
                    if e.is_dir(follow_symlinks=False):
                        if not self._skip(e.name):
                            subs.append(e.path)
                    else:
                        n_files += 1
            frontier.extend(sorted(subs))
            # a large flat folder is read by several tasks, each keeping the
            # files whose name hashes to its shard
            shards = max(1, -(-n_files // self.files_per_part))
            parts.extend(_Part("top", (d, i, shards)) for i in range(shards))
        return parts + [_Part("dir", d) for d in sorted(frontier)]

    def _row(self, full: str, rel: str):
        try:
            size = os.path.getsize(full)
            data = None
            if self.with_content:
                with open(full, "rb") as f:
                    data = f.read()
        except OSError:
            return None
        return (self.project, rel.replace(os.sep, "/"), size, data)

    def read(self, partition):
        if partition.kind == "list":
            for full in partition.value:
                if self.root and os.path.isfile(self.root):
                    rel = os.path.basename(full)
                else:
                    rel = full
                if any(self._skip(seg) for seg in rel.replace(os.sep, "/").split("/")):
                    continue
                row = self._row(full, rel)
                if row:
                    yield row
            return
        if partition.kind == "top":
            folder, shard, shards = partition.value
            with os.scandir(folder) as it:
                for e in sorted(it, key=lambda e: e.name):
                    if not e.is_file() or self._skip(e.name):
                        continue
                    if shards > 1 and zlib.crc32(e.name.encode()) % shards != shard:
                        continue
                    row = self._row(e.path, os.path.relpath(e.path, self.root))
                    if row:
                        yield row
            return
        for dirpath, dirnames, filenames in os.walk(partition.value):
            dirnames[:] = sorted(d for d in dirnames if not self._skip(d))
            for name in sorted(filenames):
                if self._skip(name):
                    continue
                full = os.path.join(dirpath, name)
                row = self._row(full, os.path.relpath(full, self.root))
                if row:
                    yield row


class FileTreeSource(DataSource):
    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FileTreeReader(self.options)


def _has_context(spark: SparkSession) -> bool:
    try:
        spark.sparkContext  # noqa: B018
        return True
    except Exception:
        return False


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileTreeSource)


def scan_files(
    spark: SparkSession,
    path: str,
    include_hidden: bool = True,
    exclude=LISTING_EXCLUDES,
    content: bool = True,
    project: str | None = None,
) -> DataFrame:
    """A file gives itself; a folder gives every file below it; otherwise
    ``path`` is a glob. Nothing matched raises ``FileNotFoundError``; matches
    that are all filtered out give an empty frame. Paths are relative to the
    folder (the file name for a single file; as matched for a glob)."""
    register(spark)
    opts = {
        "exclude": ",".join(exclude or []),
        "include_hidden": "true" if include_hidden else "false",
        "content": "true" if content else "false",
        "target_partitions": str(max(8, 4 * spark.sparkContext.defaultParallelism)) if _has_context(spark) else "64",
    }
    if os.path.exists(path):
        base = path if os.path.isdir(path) else os.path.dirname(path)
        opts["path"] = path
        opts["project"] = project if project is not None else os.path.basename(os.path.abspath(base))
    else:
        if not _glob.glob(path, recursive=True):
            raise FileNotFoundError(f"no file or folder matches {path!r}")
        opts["glob"] = path
        opts["project"] = project or ""
    return spark.read.format("filetree").options(**opts).load()


def fast_scan(spark: SparkSession, path: str, exclude=LISTING_EXCLUDES, max_bytes: int | None = None) -> DataFrame:
    """Spark's ``binaryFile`` listing (distributed for large folders). Drops
    names starting with '.' or '_'. The size filter is pushed into the scan,
    so content of larger files is never read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = "file:" + os.path.abspath(path).rstrip("/") + "/" if "://" not in path else path.rstrip("/") + "/"
    if max_bytes is not None:
        df = df.filter(F.col("length") <= max_bytes)
    out = df.select(
        F.lit(os.path.basename(os.path.abspath(path))).alias("project"),
        F.when(F.startswith("path", F.lit(root)), F.substring("path", len(root) + 1, F.lit(1 << 30))).otherwise(F.col("path")).alias("path"),
        "length", "content",
    )
    segs = F.array(*[F.lit(s) for s in (exclude or [])])
    return out.filter(~F.arrays_overlap(F.split("path", "/"), segs)) if exclude else out


def read_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Strict UTF-8 decode of ``content`` (binary) into ``text``; '\\r\\n' and
    '\\r' become '\\n'. Undecodable or unreadable rows keep ``text`` NULL and
    get ``error``."""
    raw = F.col(content).cast("string")
    ok = F.is_valid_utf8(raw)
    text = F.when(ok, F.regexp_replace(raw, "\r\n?", "\n"))
    err = F.when(F.col(content).isNull(), F.lit("not a readable file")).when(~ok, F.lit("not UTF-8"))
    return files.withColumn("text", text).withColumn("error", err)
