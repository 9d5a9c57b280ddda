"""Can the version ranges of a package be met together?

Every clause becomes a half-open interval of version keys. A key is the release
numbers, the rank of the pre- or post-release tag, the tag's number, and 1 for the
place right behind a version: ``>= v`` starts at ``(v, 0)``, ``<= v`` ends before
``(v, 1)``. ``< v`` ends below the pre-releases of a release and ``> v`` starts
above its post-releases. A wildcard ``== 1.2.*`` is all from below the first
development release of 1.2 to below that of 1.3, ``~= 1.4.2`` is from 1.4.2 to below
1.5, ``!=`` is the same interval taken away. Intersecting is then the greatest lower
and the least upper bound: two partial aggregations, whatever the number of clauses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .deps import VERSION, version_key

KEY = "struct<r:array<bigint>,k:int,n:bigint,e:int>"
#: Ranks of ``version_key``: a release, and what is below and above all its tags.
FINAL, BELOW, ABOVE = 4, -1, 6


def _place(release: F.Column, rank: int) -> F.Column:
    return F.struct(release.alias("r"), F.lit(rank).alias("k"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("e"))


def _key(k: F.Column, behind: int = 0) -> F.Column:
    return F.struct(k["r"].alias("r"), k["k"].cast("int").alias("k"), k["n"].alias("n"), F.lit(behind).alias("e"))


def _numbers(version: F.Column) -> F.Column:
    """All release numbers as written."""
    return F.transform(F.split(F.regexp_extract(F.lower(version), VERSION, 1), r"\."), lambda x: x.try_cast("long"))


def _below(numbers: F.Column) -> F.Column:
    """The place below every version that starts with the numbers."""
    last = F.array_max(F.transform(numbers, lambda x, i: F.when(x != 0, i)))
    cut = F.when(last.isNull(), F.slice(numbers, 1, 1)).otherwise(F.slice(numbers, F.lit(1), last + 1))
    return _place(cut, BELOW)


def _next(numbers: F.Column, count: F.Column) -> F.Column:
    """The place below the next prefix of ``count`` numbers: the last one raised by 1."""
    return _below(F.transform(F.slice(numbers, F.lit(1), count), lambda x, i: F.when(i == count - 1, x + 1).otherwise(x)))


def intervals(reqs: DataFrame) -> DataFrame:
    """``reqs`` with ``lo`` and ``hi``, the half-open interval of a clause's versions
    (null: no bound on that side), ``excluded`` (the interval is taken away) and
    ``compared``: false for clauses without an order (addresses, versions that are
    no plain version or wildcard), which bound nothing."""
    op, v = F.col("op"), F.lower(F.col("version"))
    wild = F.coalesce(v.endswith(".*") & op.isin("==", "!="), F.lit(False))
    bare = F.when(wild, F.regexp_replace(v, r"\.\*$", "")).otherwise(v)
    fits = bare.rlike(VERSION) & (~wild | bare.rlike(r"^v?[0-9.]+$")) & (F.col("kind") == "requirement")
    # patterns run once for each clause: what they find comes out of a generator
    d = reqs.select(*reqs.columns, F.inline(F.array(F.struct(
        wild.alias("_wild"), F.coalesce(fits, F.lit(False)).alias("compared"), version_key(bare).alias("_k"), _numbers(bare).alias("_n")))))
    key, numbers, size = F.col("_k"), F.col("_n"), F.size("_n")
    at, behind = _key(key), _key(key, 1)
    first = F.coalesce(F.array_position(F.transform(numbers, lambda x: x > 0), True), F.lit(0)).cast("int")
    caret = F.when(first > 0, first).otherwise(size)
    final = key["k"] == FINAL
    before = F.when(final, _place(key["r"], BELOW)).otherwise(at)
    after = F.when(final, _place(key["r"], ABOVE)).otherwise(behind)
    wild = F.col("_wild")
    lo = F.when(wild, _below(numbers)).when(op.isin("==", "===", "=", "!=", ">=", "~=", "^", "~"), at).when(op == ">", after)
    hi = (F.when(wild, _next(numbers, size)).when(op.isin("==", "===", "=", "!=", "<="), behind).when(op == "<", before)
          .when((op == "~=") & (size > 1), _next(numbers, size - 1)).when(op == "^", _next(numbers, caret))
          .when(op == "~", _next(numbers, F.least(size, F.lit(2)))))
    return d.select(*reqs.columns, F.when(F.col("compared"), lo).cast(KEY).alias("lo"), F.when(F.col("compared"), hi).cast(KEY).alias("hi"),
                    (F.col("compared") & (op == "!=")).alias("excluded"), "compared")


def unsatisfiable(reqs: DataFrame) -> DataFrame:
    """``project, pkg, clauses`` where no version meets all clauses of a package in a
    project: the lower and the upper clause that exclude each other, or those two and
    the exclusions that together take away all between (sorted, joined by ', ').

    ``reqs`` is what ``parse_manifests`` or ``parse_package_json`` returns. Of equal
    bounds the lower one with the largest text and the upper one with the smallest are
    named. Null projects are a project. Empty input gives no rows."""
    r = intervals(reqs).where("compared").withColumn("clause_text", F.concat("op", "version"))
    # bounds are computed once and read twice
    r = materialize(r.select(F.struct("project", "pkg").alias("_pkg"), "lo", "hi", "excluded", "clause_text"), "version-ranges")

    def bound(side: str, pick):
        return pick(F.when(F.col(side).isNotNull() & ~F.col("excluded"), F.struct(side, "clause_text")))

    g = r.groupBy("_pkg").agg(bound("lo", F.max).alias("_lo"), bound("hi", F.min).alias("_hi"), F.max("excluded").alias("_cuts"))
    g = g.select("_pkg", F.col("_lo.lo").alias("lo"), F.col("_lo.clause_text").alias("lo_text"),
                 F.col("_hi.hi").alias("hi"), F.col("_hi.clause_text").alias("hi_text"), "_cuts")
    clash = g.where("lo >= hi").select("_pkg", F.array_distinct(F.array("lo_text", "hi_text")).alias("texts"))
    # a range that is open at one end is never taken away as a whole
    left = g.where("lo < hi and _cuts")
    cuts = r.where("excluded").select("_pkg", F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"), "clause_text").distinct()
    inside = left.join(cuts, "_pkg").where("c_hi > lo and c_lo < hi")
    before = Window.partitionBy("_pkg").orderBy("c_lo", "c_hi", "clause_text").rowsBetween(Window.unboundedPreceding, -1)
    joined = inside.withColumn("reach", F.coalesce(F.max("c_hi").over(before), F.col("lo")))
    gone = joined.groupBy("_pkg").agg(
        F.min(F.col("c_lo") <= F.col("reach")).alias("no_gap"), F.max("c_hi").alias("end"), F.first("hi").alias("hi"),
        F.first("lo_text").alias("lo_text"), F.first("hi_text").alias("hi_text"), F.collect_set("clause_text").alias("cut_texts"))
    gone = gone.where("no_gap and end >= hi").select(
        "_pkg", F.array_distinct(F.concat(F.array("lo_text", "hi_text"), "cut_texts")).alias("texts"))
    out = clash.unionByName(gone)
    return out.select("_pkg.project", "_pkg.pkg", F.array_join(F.array_sort("texts"), ", ").alias("clauses"))
