"""DuckDB SQL of the queries over code and manifests that need recursion."""

from __future__ import annotations

from ..operators.lexical import patterns
from .oracle import _KIND, _NAME, VERSIONS

CODE_ORACLE: dict[str, str] = {}


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# The rendering of tables.part_script_lines.
SCRIPT = r"""
SELECT 'brand' || regexp_extract(p_brand, '([0-9]+)', 1) || '.py' AS path,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS line_no,
  CASE p_size % 15
    WHEN 0 THEN 'import m' || p_partkey
    WHEN 1 THEN 'def f' || p_partkey || '(x):'
    WHEN 2 THEN '    return f' || (p_partkey - 1) || '(x) + v' || (p_partkey - 2)
    WHEN 3 THEN 'v' || p_partkey || ' = ' || p_size
    WHEN 4 THEN 'class C' || p_partkey || ':'
    WHEN 5 THEN 'from pkg' || p_size || ' import name' || p_partkey || ' as alias' || p_partkey
    WHEN 6 THEN '# f' || (p_partkey - 1) || ' is old, ''see v' || (p_partkey - 2)
    WHEN 7 THEN '    ' || repeat(chr(34), 3) || ' doc of f' || (p_partkey - 1) || ' ' || repeat(chr(34), 3)
    WHEN 8 THEN 'text = ' || repeat(chr(34), 3) || 'starts with v' || (p_partkey - 1)
    WHEN 9 THEN 'ends v' || (p_partkey - 2) || repeat(chr(34), 3) || ' + f' || (p_partkey - 1) || '(1)'
    WHEN 10 THEN 'w' || p_partkey || ' = ''it\''s # no comment'' + v' || (p_partkey - 1)
    WHEN 11 THEN 'y' || p_partkey || ' = 1 + \'
    WHEN 12 THEN 's' || p_partkey || ' = r''part one \'
    WHEN 13 THEN 'print(f"{v' || (p_partkey - 1) || '} is # v' || (p_partkey - 2) || '")'
    ELSE 'x = ''''''a'''''' ; import os' || p_partkey || ' # v' || (p_partkey - 1) END AS line
FROM part
"""

LEX = patterns("")


def rest_sql(state: int) -> str:
    """The part of a line that is code, if it starts in ``state``."""
    if state not in (1, 2, 3, 4):
        return "line"
    closing = lit(LEX["closing"][state])
    return f"CASE WHEN regexp_matches(line, {closing}) THEN regexp_replace(line, {closing}, '') END"


def end_sql(state: int) -> str:
    """The state after a line that starts in ``state``."""
    rest, escaped = f"({rest_sql(state)})", f"regexp_matches(line, {lit(LEX['continues'])})"
    none = str(state) if state in (1, 2) else f"CASE WHEN {escaped} THEN {state} ELSE 0 END"
    last = f"regexp_replace(regexp_extract_all({rest}, {lit(LEX['token'])})[-1], '^[A-Za-z]+', '')"
    kinds = ""
    for s, mark in ((1, "'''"), (2, '"""'), (3, "'"), (4, '"')):
        open_ = str(s) if s < 3 else f"CASE WHEN regexp_matches(t, {lit(LEX['continues'])}) THEN {s} ELSE 0 END"
        kinds += f"WHEN starts_with(t, {lit(mark)}) THEN CASE WHEN regexp_matches(t, {lit(LEX['closed'][s])}) THEN -1 ELSE {open_} END "
    found = f"list_transform([{last}], lambda t: CASE WHEN t IS NULL THEN -1 WHEN starts_with(t, '#') THEN 0 {kinds} END)[1]"
    return f"""CASE WHEN {rest} IS NULL THEN {none} WHEN {found} >= 0 THEN {found}
               WHEN ends_with({rest}, chr(92)) THEN 5 ELSE 0 END"""


# One line of each file at a time.
CODE_LINES = rf"""
WITH RECURSIVE src AS ({SCRIPT}),
num AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS i,
               [{', '.join(end_sql(s) for s in (0, 1, 2, 3, 4, 0))}] AS ends FROM src),
st AS (SELECT path, CAST(1 AS BIGINT) AS i, 0 AS state FROM (SELECT DISTINCT path FROM src) p
       UNION ALL SELECT st.path, st.i + 1, num.ends[st.state + 1] FROM st JOIN num ON num.path = st.path AND num.i = st.i)
SELECT path, CAST(line_no AS BIGINT) AS line_no, CAST(state AS BIGINT) AS state,
       coalesce(regexp_replace(CASE state {' '.join(f'WHEN {s} THEN {rest_sql(s)}' for s in range(6))} END,
                               {lit(LEX['token'])}, '\1 ', 'g'), '') AS code
FROM num JOIN st USING (path, i)
"""

CODE_ORACLE["code_lines"] = CODE_LINES

CODE_ORACLE["unused_in_code"] = rf"""
WITH c AS ({CODE_LINES}),
l AS (SELECT path, line_no, state, code AS line FROM c),
d AS (SELECT path, line_no, {_KIND} AS kind, {_NAME} AS name FROM l WHERE state = 0),
t AS (SELECT path, unnest(regexp_extract_all(line, '[A-Za-z_]\w*')) AS name FROM l),
n AS (SELECT path, name, count(*) AS n FROM t GROUP BY path, name)
SELECT d.path, d.line_no, d.kind, d.name FROM d JOIN n ON n.path = d.path AND n.name = d.name
WHERE d.name IS NOT NULL AND NOT starts_with(d.name, '__') AND n.n = 1
"""

CODE_ORACLE["imports_in_code"] = rf"""
WITH c AS ({CODE_LINES}),
st AS (SELECT path, line_no, trim(unnest(string_split(code, ';'))) AS x FROM c WHERE state = 0)
SELECT path, line_no, regexp_extract(x, '^import\s+([A-Za-z_]\w*)', 1) AS module FROM st WHERE starts_with(x, 'import ')
UNION ALL SELECT path, line_no, regexp_extract(x, '^from\s+([A-Za-z_]\w*)', 1) FROM st WHERE starts_with(x, 'from ')
"""

# Bounds as numbers: 100 a + b, a release candidate a quarter below, a prefix half below.
RANGES = """
WITH x AS (SELECT 'order-' || l_orderkey AS project, 'lib-' || (l_linenumber % 2) AS pkg, l_partkey % 10 AS k,
                  l_suppkey % 3 + 1 AS a, (l_partkey // 10) % 4 AS b FROM lineitem),
y AS (SELECT *, 100.0 * a + b AS v, a || '.' || b AS t FROM x)
SELECT project, pkg, v AS lo, v + 0.1 AS hi, false AS cut, '==' || t AS txt FROM y WHERE k = 0
UNION ALL SELECT project, pkg, v, NULL, false, '>=' || t FROM y WHERE k IN (1, 9)
UNION ALL SELECT project, pkg, NULL, v - 0.5, false, '<' || t FROM y WHERE k = 2
UNION ALL SELECT project, pkg, NULL, v - 0.15, false, '<=' || t || 'rc1' FROM y WHERE k = 3
UNION ALL SELECT project, pkg, v + 0.1, NULL, false, '>' || t FROM y WHERE k = 4
UNION ALL SELECT project, pkg, v, v + 0.1, true, '!=' || t FROM y WHERE k = 5
UNION ALL SELECT project, pkg, 100.0 * a - 0.5, 100.0 * (a + 1) - 0.5, false, '==' || a || '.*' FROM y WHERE k = 6
UNION ALL SELECT project, pkg, v, 100.0 * (a + 1) - 0.5, false, '~=' || t FROM y WHERE k = 7
UNION ALL SELECT project, pkg, 100.0 * a - 0.5, 100.0 * (a + 1) - 0.5, true, '!=' || a || '.*' FROM y WHERE k = 8
UNION ALL SELECT project, pkg, NULL, 100.0 * (a + 1) - 0.5, false, '<' || (a + 1) || '.0' FROM y WHERE k = 9
"""

# A range is gone when neither its start nor the end of any exclusion is left in it.
CODE_ORACLE["unsatisfiable_ranges"] = f"""
WITH c AS ({RANGES}),
b AS (SELECT project, pkg, max(lo) FILTER (NOT cut) AS lo, min(hi) FILTER (NOT cut) AS hi FROM c GROUP BY project, pkg),
n AS (SELECT b.*, (SELECT max(txt) FROM c WHERE c.project = b.project AND c.pkg = b.pkg AND NOT cut AND c.lo = b.lo) AS lo_t,
                  (SELECT min(txt) FROM c WHERE c.project = b.project AND c.pkg = b.pkg AND NOT cut AND c.hi = b.hi) AS hi_t FROM b),
e AS (SELECT n.project, n.pkg, c.lo AS clo, c.hi AS chi, c.txt FROM n JOIN c ON c.project = n.project AND c.pkg = n.pkg
      WHERE c.cut AND n.lo < n.hi AND c.hi > n.lo AND c.lo < n.hi),
pt AS (SELECT project, pkg, lo AS x FROM n WHERE lo < hi
       UNION SELECT e.project, e.pkg, e.chi FROM e JOIN n ON n.project = e.project AND n.pkg = e.pkg WHERE e.chi < n.hi),
free AS (SELECT DISTINCT project, pkg FROM pt WHERE NOT EXISTS (
           SELECT 1 FROM e WHERE e.project = pt.project AND e.pkg = pt.pkg AND e.clo <= pt.x AND pt.x < e.chi)),
bad AS (SELECT project, pkg, lo_t AS txt FROM n WHERE lo >= hi UNION SELECT project, pkg, hi_t FROM n WHERE lo >= hi
        UNION SELECT n.project, n.pkg, unnest([lo_t, hi_t]) FROM n ANTI JOIN free ON free.project = n.project AND free.pkg = n.pkg WHERE lo < hi
        UNION SELECT e.project, e.pkg, e.txt FROM e ANTI JOIN free ON free.project = e.project AND free.pkg = e.pkg)
SELECT project, pkg, string_agg(txt, ', ' ORDER BY txt) AS clauses FROM bad GROUP BY project, pkg
"""

INCLUDE_EDGES = """
SELECT 'order-' || o_orderkey AS project, 'requirements.txt' AS file, 1 AS line_no, 'requirement' AS kind, 'deps/f1.txt' AS target, 'deps/f1.txt' AS path FROM orders
UNION ALL SELECT 'order-' || o_orderkey, 'constraints/c.txt', 2, 'requirement', '../deps/f2.txt', 'deps/f2.txt' FROM orders
UNION ALL SELECT 'order-' || l_orderkey, 'deps/f' || l_linenumber || '.txt', 1,
  CASE WHEN l_partkey % 8 IN (2, 7) THEN 'constraint' ELSE 'requirement' END,
  CASE l_partkey % 8 WHEN 0 THEN 'f' || (l_linenumber + 1) || '.txt' WHEN 1 THEN './f' || (l_linenumber + 2) || '.txt'
    WHEN 2 THEN '../constraints/c.txt' WHEN 3 THEN '../requirements.txt' WHEN 4 THEN '../deps/f' || (l_linenumber + 1) || '.txt'
    WHEN 5 THEN 'https://example.org/x.txt' WHEN 6 THEN '../../up.txt' ELSE 'f' || (l_linenumber + 3) || '.txt' END,
  CASE l_partkey % 8 WHEN 0 THEN 'deps/f' || (l_linenumber + 1) || '.txt' WHEN 1 THEN 'deps/f' || (l_linenumber + 2) || '.txt'
    WHEN 2 THEN 'constraints/c.txt' WHEN 3 THEN 'requirements.txt' WHEN 4 THEN 'deps/f' || (l_linenumber + 1) || '.txt'
    WHEN 7 THEN 'deps/f' || (l_linenumber + 3) || '.txt' END
FROM lineitem
"""

INCLUDED = f"""
edges AS ({INCLUDE_EDGES}),
there AS (SELECT 'order-' || o_orderkey AS project, unnest(['requirements.txt', 'constraints/c.txt']) AS file FROM orders
          UNION SELECT 'order-' || l_orderkey, 'deps/f' || l_linenumber || '.txt' FROM lineitem),
good AS (SELECT e.* FROM edges e JOIN there t ON t.project = e.project AND t.file = e.path),
reach AS (
  SELECT project, file, 1 AS hard, 0 AS depth FROM there WHERE file = 'requirements.txt'
  UNION SELECT g.project, g.path, CASE WHEN r.hard = 1 AND g.kind = 'requirement' THEN 1 ELSE 0 END, r.depth + 1
  FROM reach r JOIN good g ON g.project = r.project AND g.file = r.file WHERE r.depth < 12),
files AS (SELECT project, file, max(hard) AS hard, min(depth) AS depth FROM reach GROUP BY project, file)"""

CODE_ORACLE["manifest_includes"] = f"""
WITH RECURSIVE {INCLUDED}
SELECT project, file, CASE hard WHEN 1 THEN 'requirement' ELSE 'constraint' END AS kind, CAST(depth AS BIGINT) AS depth FROM files
"""

CODE_ORACLE["include_errors"] = f"""
WITH RECURSIVE {INCLUDED},
used AS (SELECT DISTINCT e.* FROM edges e JOIN files f ON f.project = e.project AND f.file = e.file),
leads AS (SELECT DISTINCT project, file AS a, path AS b FROM good
          UNION SELECT l.project, l.a, g.path FROM leads l JOIN good g ON g.project = l.project AND g.file = l.b)
SELECT u.project, u.file, CAST(u.line_no AS BIGINT) AS line_no, u.target,
  CASE WHEN starts_with(u.target, 'https:') THEN 'address' WHEN u.path IS NULL THEN 'outside the project'
       WHEN t.file IS NULL THEN 'missing file' ELSE 'cycle' END AS error
FROM used u LEFT JOIN there t ON t.project = u.project AND t.file = u.path
WHERE t.file IS NULL OR EXISTS (SELECT 1 FROM leads l WHERE l.project = u.project AND l.a = u.path AND l.b = u.file)
"""

CODE_ORACLE["manifest_closure"] = f"""
WITH RECURSIVE {INCLUDED},
rows AS (SELECT 'order-' || o_orderkey AS project, 'requirements.txt' AS file, 2 AS line_no, 'root-pkg' AS pkg, '>=' AS op, '1' AS version FROM orders
         UNION ALL SELECT 'order-' || o_orderkey, 'constraints/c.txt', 1, 'shared-pkg', '<', '2' FROM orders
         UNION ALL SELECT 'order-' || l_orderkey, 'deps/f' || l_linenumber || '.txt', 2, 'part-' || l_partkey, '==', l_linenumber || '.0' FROM lineitem)
SELECT r.project, r.file, CAST(line_no AS BIGINT) AS line_no, pkg, op, version, CASE hard WHEN 1 THEN 'requirement' ELSE 'constraint' END AS kind
FROM rows r JOIN files f ON f.project = r.project AND f.file = r.file
"""

# What any exact delta has: the lines of each side, and the sides themselves.
CODE_ORACLE["delta_sides"] = f"""
WITH v AS ({VERSIONS}),
n AS (SELECT path, nullif(old, '') AS a, nullif(new, '') AS b FROM v)
SELECT path, CAST(coalesce(len(regexp_extract_all(a, '[^\\n]*\\n|[^\\n]+')), 0) AS BIGINT) AS n_old,
       CAST(coalesce(len(regexp_extract_all(b, '[^\\n]*\\n|[^\\n]+')), 0) AS BIGINT) AS n_new, md5(a) AS old_md5, md5(b) AS new_md5
FROM n WHERE a IS NOT NULL OR b IS NOT NULL
"""
