"""Dependency jobs as relational queries: manifests, imports and the four
checks (unused, missing, conflicting, outdated).

Inputs are line tables ``(project, path, line_no, line)``. All checks are
joins keyed by ``(project, pkg)`` or ``(project, module)``; caller tables
(alias, standard library, latest versions) are dimension tables, broadcast
only after a row-count probe proves them small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import bounded_broadcast
from .lexical import code_lines

# Manifest file names recognised without caller patterns.
MANIFEST_PATTERNS = [r"(^|/)requirements[^/]*\.txt$"]
# Requirement lines, after cutting a " #" comment and white space at both ends:
# the part before ";" is a name, extras in brackets and what follows; that is
# nothing, "@ address", or clauses joined by commas, maybe in parentheses.
NAME = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)$"
CLAUSE = r"^(===|==|~=|!=|<=|>=|<|>)\s*(\S+)$"
# A version: release numbers, then maybe a pre-release or post-release tag.
VERSION = r"^v?(\d+(?:\.\d+)*)(?:[._-]?(dev|a|alpha|b|beta|c|rc|post)[._-]?(\d*))?$"
# package.json: a range operator and a version.
SEMVER = r"^(\^|~|>=|<=|>|<|=)?\s*v?(\d\S*)$"
# Import grammars.
PY_FROM = r"^from\s+([A-Za-z_]\w*)[\w.]*\s+import\b"
PY_IMPORT = r"^import\s+(.+)$"
JS_REQUIRE = r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"
JS_FROM = r"\bfrom\s+['\"]([^'\"]+)['\"]"
JS_SUFFIXES = r"\.(js|jsx|ts|tsx|mjs|cjs)$"


def normalize_pkg(col) -> F.Column:
    """Package names compare lower-cased with runs of '-', '_', '.' as '-'."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(c), r"[-_.]+", "-")


def without_comment(line: str) -> F.Column:
    """The line without ``#`` and what follows, where blank space or nothing is before it."""
    return F.when(F.col(line).contains("#"), F.regexp_replace(line, r"(^|\s)#.*$", "")).otherwise(F.col(line))


def manifest_lines(lines: DataFrame, patterns=MANIFEST_PATTERNS) -> DataFrame:
    cond = None
    for p in patterns:
        c = F.col("path").rlike(p)
        cond = c if cond is None else (cond | c)
    return lines.filter(cond)


def parse_manifests(lines: DataFrame, patterns=MANIFEST_PATTERNS) -> DataFrame:
    """One row per clause of a requirement line, and one per other line that is
    not blank or only a comment: ``project, file, line_no, clause, pkg, op,
    version, marker, kind``. Kind is 'requirement' (``op`` and ``version`` null
    without a clause), 'url' (``name @ address``), 'directive' (lines starting
    with '-') or 'invalid' (a line that fits none of these)."""
    m = manifest_lines(lines, patterns)
    body = py_strip(without_comment("line"))
    m = m.select("project", F.col("path").alias("file"), "line_no", body.alias("_b"))
    head = py_strip(F.substring_index("_b", ";", 1))
    tail = F.when(F.instr("_b", ";") > 0, py_strip(F.regexp_replace("_b", r"^[^;]*;", "")))
    g = m.select("project", "file", "line_no", "_b", tail.alias("_marker"),
                 F.regexp_extract(head, NAME, 1).alias("_name"), F.regexp_extract(head, NAME, 2).alias("_rest"))
    bare = F.when(F.col("_rest") == "", "").otherwise(py_strip(
        F.when(F.col("_rest").startswith("("), F.regexp_replace("_rest", r"^\((.*)\)$", "$1")).otherwise(F.col("_rest"))))
    clauses = F.transform(F.split(bare, ","), lambda c: F.trim(c))
    g = g.withColumn("_clauses", F.when(bare != "", clauses).otherwise(F.array().cast("array<string>")))
    fits = F.forall("_clauses", lambda c: c.rlike(CLAUSE))
    kind = (F.when(F.col("_b") == "", F.lit("blank")).when(F.col("_b").startswith("-"), F.lit("directive"))
            .when(F.col("_name") == "", F.lit("invalid")).when(F.col("_rest").startswith("@"), F.lit("url"))
            .when(fits, F.lit("requirement")).otherwise(F.lit("invalid")))
    g = g.withColumn("kind", kind)
    named = F.col("kind").isin("requirement", "url")

    def row(number, op, version):
        return F.struct(
            number.cast("long").alias("clause"),
            F.when(named, normalize_pkg("_name")).alias("pkg"),
            op.alias("op"),
            version.alias("version"),
            F.when(named, F.nullif(F.col("_marker"), F.lit(""))).alias("marker"),
            F.col("kind").alias("kind"),
        )

    none = F.lit(None).cast("string")
    per_clause = F.transform("_clauses", lambda c, i: row(i, F.regexp_extract(c, CLAUSE, 1), F.regexp_extract(c, CLAUSE, 2)))
    rows = F.when((F.col("kind") == "requirement") & (F.size("_clauses") > 0), per_clause).otherwise(
        F.array(row(F.lit(0), none, none)))
    # the parsed fields come out of one generator: filters on them stay above it
    # instead of re-running the patterns inside every predicate
    return g.select("project", "file", "line_no", F.inline(rows)).filter(F.col("kind") != "blank")


def parse_package_json(files: DataFrame) -> DataFrame:
    """Dependencies of ``package.json`` files ``(project, path, content)``, in the
    columns of ``parse_manifests`` without line numbers: kind 'requirement'
    with ``op`` and ``version`` (both null for '*', 'latest' and the like), 'url'
    for addresses and paths, 'directive' never, 'invalid' for a file that is no
    JSON object. The marker is 'dev' for development dependencies."""
    f = files.filter(F.col("path").rlike(r"(^|/)package\.json$"))
    shape = "struct<dependencies: map<string, string>, devDependencies: map<string, string>>"
    ok = F.json_object_keys("content").isNotNull()
    f = f.select("project", F.col("path").alias("file"), ok.alias("_ok"), F.from_json("content", shape).alias("_j"))

    def entries(field, marker):
        pairs = F.map_entries(F.coalesce(F.col(f"_j.{field}"), F.create_map().cast("map<string,string>")))
        return F.transform(pairs, lambda e: F.struct(e["key"].alias("name"), F.trim(e["value"]).alias("spec"), F.lit(marker).alias("marker")))

    broken = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("spec"), F.lit(None).cast("string").alias("marker")))
    found = F.when(F.col("_ok"), F.concat(entries("dependencies", None), entries("devDependencies", "dev"))).otherwise(broken)
    d = f.select("project", "file", "_ok", F.explode(found).alias("d"))
    spec = F.col("d.spec")
    plain = F.coalesce(spec.rlike(SEMVER), F.lit(False))
    kind = (F.when(~F.col("_ok"), "invalid").when(plain | ~F.coalesce(spec.rlike("[:/]"), F.lit(False)), "requirement")
            .otherwise("url"))
    return d.select(
        "project", "file", F.lit(None).cast("int").alias("line_no"), F.lit(0).cast("long").alias("clause"),
        F.lower("d.name").alias("pkg"),
        F.when(plain, F.coalesce(F.nullif(F.regexp_extract(spec, SEMVER, 1), F.lit("")), F.lit("="))).alias("op"),
        F.when(plain, F.regexp_extract(spec, SEMVER, 2)).alias("version"),
        F.col("d.marker").cast("string").alias("marker"), kind.alias("kind"))


def extract_imports(lines: DataFrame) -> DataFrame:
    """Top-level modules imported per line: Python ``import a, b.c as d`` and
    ``from a.b import c`` (relative imports dropped) in ``.py`` files, in each
    of the statements that ``;`` joins, where the line starts as code: not in
    comments and strings, docstrings of many lines included;
    ``require('x')`` and ``from 'x'`` in JavaScript files, scoped names keep
    two parts, relative paths dropped. ``project, path, line_no, module``."""
    is_py = F.col("path").endswith(".py")
    is_js = F.col("path").rlike(JS_SUFFIXES)
    statements = F.transform(F.split("code", ";"), lambda x: py_strip(x))
    names = F.transform(statements, lambda x: F.concat(
        F.transform(F.split(F.regexp_extract(x, PY_IMPORT, 1), ","),
                    lambda y: F.regexp_extract(F.trim(y), r"^([A-Za-z_]\w*)", 1)),
        F.array(F.regexp_extract(x, PY_FROM, 1))))
    py = F.when(F.col("code").contains("import"), F.filter(F.flatten(names), lambda x: x != ""))
    js = F.when(is_js, F.concat(F.regexp_extract_all("line", F.lit(JS_REQUIRE), 1),
                                F.regexp_extract_all("line", F.lit(JS_FROM), 1)))
    js = F.transform(js, lambda m: F.regexp_extract(m, r"^(@[^/]+/[^/]+|[^/]+)", 1))
    src = lines.select("project", "path", "line_no", "line")
    code = code_lines(src.where(is_py), ("project", "path"), only="import").where("state = 0")
    out = code.select("project", "path", "line_no", F.explode(py).alias("module")).unionByName(
        src.select("project", "path", "line_no", F.explode(js).alias("module")))
    return out.filter((F.col("module") != "") & ~F.col("module").startswith("."))


def imported_packages(imports: DataFrame, alias: DataFrame | None = None, max_dim_rows: int = 1_000_000):
    """``(project, module, pkg)`` of every import: module mapped by the alias table
    (a bounded broadcast, so the mapping is narrow), else its own normalised
    name. Rows repeat as imports do."""
    m = imports.select("project", "module")
    if alias is None:
        return m.withColumn("pkg", normalize_pkg("module"))
    a = alias.select("module", normalize_pkg("pkg").alias("_apkg")).dropDuplicates(["module"])
    out = m.join(bounded_broadcast(a, max_dim_rows), "module", "left")
    return out.select("project", "module", F.coalesce("_apkg", normalize_pkg("module")).alias("pkg"))


def declared_packages(reqs: DataFrame) -> DataFrame:
    """First clause of each declared requirement or address."""
    return reqs.filter(F.col("kind").isin("requirement", "url") & (F.col("clause") == 0))


def unused_deps(reqs: DataFrame, imports: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """Declared requirements whose package no file of the project imports."""
    declared = declared_packages(reqs).select("project", "file", "line_no", "pkg")
    used = imported_packages(imports, alias).select("project", "pkg")
    return declared.join(used, ["project", "pkg"], "left_anti")


def missing_deps(
    reqs: DataFrame,
    imports: DataFrame,
    alias: DataFrame | None,
    stdlib: DataFrame,
    project_modules: DataFrame,
    max_dim_rows: int = 1_000_000,
) -> DataFrame:
    """Imported modules that are not declared, not standard library and not a
    module of the project itself: ``project, module, pkg``.

    Imports, declarations and own modules meet in one aggregation by project and
    package, with map-side partial sets of module names; the standard library
    goes first, by a bounded broadcast."""
    imp = imports.join(bounded_broadcast(stdlib.select("module").distinct(), max_dim_rows), "module", "left_anti")
    none = F.lit(None).cast("string")
    imp = imported_packages(imp, alias, max_dim_rows).select("project", "pkg", F.col("module").alias("used"), none.alias("own"), F.lit(False).alias("declared"))
    own = imported_packages(project_modules, alias, max_dim_rows).select("project", "pkg", none.alias("used"), F.col("module").alias("own"), F.lit(False).alias("declared"))
    decl = declared_packages(reqs).select("project", "pkg", none.alias("used"), none.alias("own"), F.lit(True).alias("declared"))
    every = imp.unionByName(own).unionByName(decl).groupBy("project", "pkg").agg(
        F.collect_set("used").alias("used"), F.collect_set("own").alias("own"), F.max("declared").alias("declared"))
    left = every.filter(~F.col("declared")).select("project", F.explode(F.array_except("used", "own")).alias("module"), "pkg")
    return left.select("project", "module", "pkg")


def project_modules(files: DataFrame) -> DataFrame:
    """Module names a project defines: stems of its Python files and their
    top-level folders."""
    stem = F.regexp_extract("path", r"([A-Za-z_]\w*)\.py$", 1)
    top = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^([A-Za-z_]\w*)/", 1))
    out = files.select("project", F.explode(F.array(stem, top)).alias("module"))
    return out.filter(F.col("module").isNotNull() & (F.col("module") != ""))


def version_conflicts(reqs: DataFrame) -> DataFrame:
    """Per ``(project, pkg)``: more than one exact pin (``==`` or ``===`` without a
    wildcard) is 'multiple pins'; requirements without any upper bound (no
    ``==``, ``===``, ``~=``, ``<`` or ``<=``) are an 'open range'. ``n_pins`` and
    ``pins`` (sorted, ', ') describe the pins."""
    r = reqs.filter(F.col("kind") == "requirement")
    pin = F.when(F.col("op").isin("==", "===") & ~F.col("version").contains("*"), F.col("version"))
    bound = F.coalesce(F.col("op").isin("==", "===", "~=", "<", "<="), F.lit(False))
    g = r.groupBy("project", "pkg").agg(F.array_sort(F.collect_set(pin)).alias("_pins"), F.max(bound).alias("_bound"))
    reason = F.when(F.size("_pins") > 1, F.lit("multiple pins")).when(~F.col("_bound"), F.lit("open range"))
    out = g.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return out.select("project", "pkg", F.size("_pins").cast("long").alias("n_pins"),
                      F.array_join("_pins", ", ").alias("pins"), "reason")


def version_key(col) -> F.Column:
    """What versions are ordered by: release numbers without zeros at the end (so
    1.0 is 1.0.0 and 1.10 is above 1.9), then development, alpha, beta, candidate,
    final and post releases, then the tag's number. Null for anything else,
    wildcards too."""
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    numbers = F.transform(F.split(F.regexp_replace(F.regexp_extract(c, VERSION, 1), r"(\.0+)+$", ""), r"\."), lambda x: x.try_cast("long"))
    tag = F.regexp_extract(c, VERSION, 2)
    rank = (F.when(tag == "dev", 0).when(tag.isin("a", "alpha"), 1).when(tag.isin("b", "beta"), 2)
            .when(tag.isin("c", "rc"), 3).when(tag == "post", 5).otherwise(4))
    number = F.coalesce(F.regexp_extract(c, VERSION, 3).try_cast("long"), F.lit(0).cast("long"))
    return F.when(c.rlike(VERSION), F.struct(numbers.alias("r"), rank.alias("k"), number.alias("n")))


def outdated_deps(reqs: DataFrame, latest: DataFrame) -> DataFrame:
    """Exact pins lower than the newest known version of the package; of several
    rows for a package in ``latest`` the highest counts. Pins that are no plain
    version (wildcards, addresses) are not compared."""
    pins = reqs.filter((F.col("kind") == "requirement") & F.col("op").isin("==", "==="))
    lt = latest.select(normalize_pkg("pkg").alias("pkg"), "version", version_key("version").alias("_k"))
    lt = lt.filter(F.col("_k").isNotNull()).groupBy("pkg").agg(F.max(F.struct("_k", "version")).alias("_l"))
    out = pins.join(lt, "pkg")
    return out.filter(version_key("version") < F.col("_l._k")).select(
        "project", "file", "line_no", "pkg", "version", F.col("_l.version").alias("latest"))


def deps_issues(unused: DataFrame, missing: DataFrame, conflicts: DataFrame, outdated: DataFrame) -> DataFrame:
    """The four checks as one issue table ``project, type, file, detail,
    suggestion, pos``: types 'unused', 'missing', 'conflict' and 'outdated'.
    Findings without a manifest line of their own name no file (''). ``pos``
    orders a file's issues: the line they are on, others last."""
    def issue(df, kind, detail, suggestion, file=F.lit(""), pos=F.lit(None)):
        return df.select("project", F.lit(kind).alias("type"), file.alias("file"), detail.alias("detail"),
                         suggestion.alias("suggestion"), F.coalesce(pos.cast("long"), F.lit(1 << 40)).alias("pos"))

    pkg = F.col("pkg")
    file, line = F.col("file"), F.col("line_no")
    return (
        issue(unused, "unused", F.concat(pkg, F.lit(" is never imported")), F.concat(F.lit("remove "), pkg), file, line)
        .unionByName(issue(missing, "missing", F.concat(F.col("module"), F.lit(" is imported but not declared")),
                           F.concat(F.lit("add "), pkg)))
        .unionByName(issue(conflicts, "conflict", F.concat(pkg, F.lit(": "), F.col("reason")),
                           F.when(F.col("n_pins") > 1, F.concat(F.lit("keep one of "), F.col("pins"))).otherwise(F.lit("set an upper bound"))))
        .unionByName(issue(outdated, "outdated", F.concat(pkg, F.lit(" "), F.col("version")),
                           F.concat(F.lit("raise to "), F.col("latest")), file, line))
    )
