"""DuckDB SQL for every registered query that SQL can express.

Written independently of the Spark plans where it can be: loops become
recursive CTEs, windows stay windows, range joins are plain BETWEEN joins.
Tables ``documents``, ``conversations``, ... are views over the same parquet.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Lines of every document with their terminators, numbered from 1, as
# ``str.splitlines(keepends=True)`` gives them (documents only contain '\n').
DOC_LINES_KEEPENDS = """
  SELECT doc_id, CAST(i AS BIGINT) AS line_no,
         arr[i] || CASE WHEN i < len(arr) THEN chr(10) ELSE '' END AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents
        WHERE text IS NOT NULL) t,
       LATERAL generate_series(1, len(arr)) AS g(i)
  WHERE NOT (i = len(arr) AND arr[i] = '')
"""

# Same without terminators.
DOC_LINES = """
  SELECT doc_id, CAST(i AS BIGINT) AS line_no, arr[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents
        WHERE text IS NOT NULL) t,
       LATERAL generate_series(1, len(arr)) AS g(i)
  WHERE NOT (i = len(arr) AND arr[i] = '')
"""

ORACLE["chunk_chars"] = """
WITH RECURSIVE c(doc_id, text, L, k, s) AS (
  SELECT doc_id, text, length(text), 0, 0 FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, text, L, k + 1, s + 8000 - 200 FROM c WHERE s + 8000 < L
)
SELECT doc_id, CAST(k AS BIGINT) AS chunk_no, CAST(s AS BIGINT) AS start,
       CAST(length(substring(text, s + 1, 8000)) AS BIGINT) AS chunk_chars,
       md5(substring(text, s + 1, 8000)) AS chunk_md5
FROM c
"""

ORACLE["chunk_counts"] = """
WITH RECURSIVE c(doc_id, source, text, L, s) AS (
  SELECT doc_id, source, text, length(text), 0 FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, source, text, L, s + 7800 FROM c WHERE s + 8000 < L
)
SELECT source, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs,
       CAST(count(*) AS BIGINT) AS n_chunks,
       CAST(sum(length(substring(text, s + 1, 8000))) AS BIGINT) AS chunk_chars
FROM c GROUP BY source
"""

ORACLE["chunk_lines_no_overlap"] = f"""
WITH RECURSIVE l AS ({DOC_LINES_KEEPENDS}),
r(doc_id, line_no, chunk_no, cur) AS (
  SELECT doc_id, line_no, 0, length(line) FROM l WHERE line_no = 1
  UNION ALL
  SELECT r.doc_id, l.line_no,
         CASE WHEN r.cur + length(l.line) <= 500 THEN r.chunk_no ELSE r.chunk_no + 1 END,
         CASE WHEN r.cur + length(l.line) <= 500 THEN r.cur + length(l.line) ELSE length(l.line) END
  FROM r JOIN l ON l.doc_id = r.doc_id AND l.line_no = r.line_no + 1
)
SELECT r.doc_id, CAST(r.chunk_no AS BIGINT) AS chunk_no,
       CAST(min(r.line_no) AS BIGINT) AS start_line,
       CAST(sum(length(l.line)) AS BIGINT) AS chunk_chars,
       md5(string_agg(l.line, '' ORDER BY l.line_no)) AS chunk_md5
FROM r JOIN l ON l.doc_id = r.doc_id AND l.line_no = r.line_no
GROUP BY r.doc_id, r.chunk_no
"""

ORACLE["split_lines"] = DOC_LINES

ORACLE["join_lines"] = f"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       md5(string_agg(line, chr(10) ORDER BY line_no) || chr(10)) AS text_md5
FROM ({DOC_LINES}) l GROUP BY doc_id
"""

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

WRAPPED = """
SELECT conv_id, turn, CASE turn % 5
    WHEN 0 THEN '```python' || chr(10) || text || chr(10) || '```'
    WHEN 1 THEN '```' || chr(10) || text || chr(10) || '```  '
    WHEN 2 THEN '  ' || text || chr(10)
    WHEN 3 THEN '```' || text
    ELSE '```' || text || '```' END AS raw
FROM conversations
"""

ORACLE["fences"] = f"""
WITH s AS (SELECT conv_id, turn, {STRIP.format(x='raw')} AS c FROM ({WRAPPED}) w),
f AS (SELECT conv_id, turn, c, string_split(c, chr(10)) AS ls FROM s),
o AS (SELECT conv_id, turn,
        CASE WHEN starts_with(c, '```') AND ends_with(c, '```') AND len(ls) > 1
             THEN {STRIP.format(x="array_to_string(ls[2:len(ls) - 1], chr(10))")}
             ELSE c END AS cleaned FROM f)
SELECT conv_id, turn, md5(cleaned) AS cleaned_md5, CAST(length(cleaned) AS BIGINT) AS cleaned_chars FROM o
"""

ORACLE["echo"] = f"""
WITH c AS (
  SELECT conv_id, turn, text,
         coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS nxt
  FROM conversations),
a AS (
  SELECT conv_id, turn, {STRIP.format(x='text')} AS o,
         {STRIP.format(x='''CASE turn % 4 WHEN 0 THEN text || chr(10) || nxt WHEN 1 THEN text
              WHEN 2 THEN nxt ELSE text || ' ' || text || ' ok' END''')} AS n
  FROM c),
t AS (SELECT *, CASE WHEN o <> '' THEN {STRIP.format(x='string_split(n, o)[-1]')} END AS tail FROM a)
SELECT conv_id, turn, md5(CASE WHEN o = '' THEN n WHEN n = o THEN n
                               WHEN contains(n, o) AND tail <> '' THEN tail ELSE n END) AS answer_md5
FROM t
"""

ORACLE["suffix_safe_name"] = """
WITH p AS (
  SELECT page_id, url,
         regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)
           || CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '' ELSE '.tar.gz' END AS p
  FROM pages),
s AS (SELECT *, regexp_extract(regexp_extract(p, '[^/]*$', 0), '^.+(\\.[^.]+)$', 1) AS suffix FROM p)
SELECT page_id, suffix,
       CASE WHEN suffix = '' THEN p ELSE left(p, length(p) - length(suffix)) END || '.md' AS swapped,
       regexp_replace(url, '[^\\pL\\pN_-]', '_', 'g') AS safe_url
FROM s
"""

# files(project, path, length, content, doc_id, lang) rendered from documents
FILES = """
SELECT source AS project,
       ['src', 'lib', 'node_modules', 'dist', 'build', '.git', '__pycache__'][doc_id % 7 + 1]
         || '/' || CAST(doc_id AS VARCHAR)
         || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.go'
                      WHEN 'es' THEN '.txt' ELSE '.md' END AS path,
       CAST(octet_length(encode(text)) AS BIGINT) AS length, text AS content, doc_id, lang
FROM documents
"""

EXT = "(VALUES ('.py', 'python'), ('.js', 'javascript'), ('.go', 'go')) AS e(suffix, language)"

TAGGED = f"""
SELECT f.*, coalesce(e.language, 'unknown') AS language
FROM ({FILES}) f
LEFT JOIN {EXT}
  ON e.suffix = lower(regexp_extract(regexp_extract(f.path, '[^/]*$', 0), '^.+(\\.[^.]+)$', 1))
"""

LISTING = "NOT list_has_any(string_split(path, '/'), ['node_modules', 'dist', 'build'])"
CORPUS = ("NOT list_has_any(string_split(path, '/'), "
          "['.git', '.hg', '.svn', '.venv', 'venv', 'node_modules', 'dist', 'build', '__pycache__'])")

ORACLE["exclude_paths"] = f"SELECT project, path FROM ({FILES}) f WHERE {LISTING}"

ORACLE["corpus_cap"] = f"""
WITH e AS (
  SELECT project, path, length, CASE WHEN NOT ({CORPUS}) THEN 'excluded' WHEN length > 16000 THEN 'too large' END AS why
  FROM ({FILES}) f)
SELECT project, path, length,
  coalesce(why, CASE WHEN row_number() OVER (PARTITION BY project, why ORDER BY path) <= 8 THEN 'kept' ELSE 'over the cap' END)
    AS status
FROM e
"""

ORACLE["collect_corpus"] = f"SELECT project, path, length, md5(content) AS content_md5 FROM ({FILES}) f WHERE {CORPUS}"

ORACLE["head_text"] = f"""
SELECT project, min(path) AS path, md5(arg_min(content, path)) AS head_md5,
       CAST(length(arg_min(content, path)) AS BIGINT) AS head_chars
FROM ({FILES}) f WHERE {LISTING} GROUP BY project
"""

ORACLE["tag_language"] = f"SELECT project, path, language FROM ({TAGGED}) t"

ORACLE["corpus_profile"] = f"""
WITH t AS ({TAGGED}),
l AS (
  SELECT t.project, t.path, length(arr[i]) AS len
  FROM (SELECT project, path, string_split(content, chr(10)) AS arr FROM t) t,
       LATERAL generate_series(1, len(arr)) AS g(i)
  WHERE NOT (i = len(arr) AND arr[i] = '')),
pf AS (SELECT project, path, count(*) AS n_lines, max(len) AS longest FROM l GROUP BY project, path)
SELECT t.project, t.language, CAST(count(*) AS BIGINT) AS n_files,
       CAST(sum(coalesce(pf.n_lines, 0)) AS BIGINT) AS n_lines,
       CAST(sum(length(t.content)) AS BIGINT) AS n_chars,
       CAST(max(coalesce(pf.longest, 0)) AS BIGINT) AS longest_line
FROM t LEFT JOIN pf ON pf.project = t.project AND pf.path = t.path
GROUP BY t.project, t.language
"""

# bytes of the project's files before this one, in path order, over 4,000,000
PACK = """coalesce(sum(length) OVER (PARTITION BY project ORDER BY path
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4000000"""

ORACLE["files_block"] = f"""
WITH b AS (
  SELECT project, path, CAST({PACK} AS BIGINT) AS pack, '### file: ' || path || chr(10) || '### language: ' || language
         || chr(10) || content || chr(10) || '### end of file' AS blk
  FROM ({TAGGED}) t)
SELECT project, pack, CAST(count(*) AS BIGINT) AS n_files,
       CAST(length(string_agg(blk, chr(10) || chr(10) ORDER BY path)) AS BIGINT) AS block_chars,
       md5(string_agg(blk, chr(10) || chr(10) ORDER BY path)) AS block_md5
FROM b GROUP BY project, pack
"""

ORACLE["build_snapshot"] = f"""
WITH p AS (SELECT project, path, content, CAST({PACK} AS BIGINT) AS pack FROM ({FILES}) f WHERE {CORPUS})
SELECT project AS root, pack, 'Project to convert from python to go.' AS summary,
       CAST(row_number() OVER (PARTITION BY project, pack ORDER BY path) - 1 AS BIGINT) AS pos,
       path, 'unknown' AS language, md5(content) AS content_md5
FROM p
"""

# ---------------------------------------------------------------- ranges, versions, blocks

LINES_P = f"SELECT 'doc/' || doc_id || '.txt' AS path, line_no, line FROM ({DOC_LINES}) dl"

SELECTIONS = """
SELECT doc_id AS sel_id,
       CASE WHEN doc_id % 10 = 9 THEN 'doc/missing-' || doc_id || '.txt' ELSE 'doc/' || doc_id || '.txt' END AS path,
       CAST(st AS BIGINT) AS start_line,
       CAST(CASE WHEN doc_id % 23 = 5 THEN st - 1 ELSE st + doc_id % 4 END AS BIGINT) AS end_line
FROM (SELECT doc_id, doc_id % 5 + 1 + CASE WHEN doc_id % 13 = 7 THEN 40 ELSE 0 END AS st FROM documents) d
"""

ORACLE["extract_ranges"] = f"""
WITH l AS ({LINES_P}), s AS ({SELECTIONS}),
n AS (SELECT path, max(line_no) AS nl FROM l GROUP BY path),
e AS (SELECT s.*, n.nl,
        CASE WHEN n.nl IS NULL THEN 'file not found'
             WHEN start_line < 1 OR end_line < start_line THEN 'invalid range' END AS error
      FROM s LEFT JOIN n ON n.path = s.path),
x AS (SELECT e.sel_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS snippet, count(*) AS k
      FROM e JOIN l ON l.path = e.path AND l.line_no BETWEEN e.start_line AND e.end_line
      WHERE e.error IS NULL GROUP BY e.sel_id)
SELECT e.sel_id, e.path, e.start_line, e.end_line,
       CASE WHEN e.error IS NULL THEN md5(coalesce(x.snippet, '')) END AS snippet_md5,
       CASE WHEN e.error IS NULL THEN CAST(coalesce(x.k, 0) AS BIGINT) END AS n_snippet_lines,
       e.error
FROM e LEFT JOIN x ON x.sel_id = e.sel_id
"""

EDITS = """
SELECT doc_id * 10 AS edit_id, 'doc/' || doc_id || '.txt' AS path, doc_id % 3 + 1 AS start_line,
       doc_id % 3 + 1 + doc_id % 2 AS end_line, 'edited ' || doc_id || chr(10) || 'second line' AS snippet
FROM documents
UNION ALL SELECT doc_id * 10 + 1, 'doc/' || doc_id || '.txt', 6, 6, '' FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id * 10 + 2, 'doc/' || doc_id || '.txt', 2, 3, 'overlap' FROM documents WHERE doc_id % 9 = 0
UNION ALL SELECT doc_id * 10 + 3, 'doc/' || doc_id || '.txt', 50, 60, 'tail' FROM documents WHERE doc_id % 7 = 3
UNION ALL SELECT doc_id * 10 + 4, 'doc/missing-' || doc_id || '.txt', 1, 1, 'x' FROM documents WHERE doc_id % 11 = 1
UNION ALL SELECT doc_id * 10 + 5, 'doc/' || doc_id || '.txt', 0, 1, 'bad' FROM documents WHERE doc_id % 17 = 2
"""

EDIT_CHECK = f"""
l AS ({LINES_P}),
n AS (SELECT path, max(line_no) AS nl FROM l GROUP BY path),
e AS (SELECT ed.*, n.nl,
        CASE WHEN n.nl IS NULL THEN 'file not found'
             WHEN start_line < 1 OR end_line < start_line THEN 'invalid range' END AS err
      FROM ({EDITS}) ed LEFT JOIN n ON n.path = ed.path),
c AS (SELECT e.*, CASE WHEN err IS NOT NULL THEN err
                       WHEN EXISTS (SELECT 1 FROM e e2 WHERE e2.err IS NULL AND e2.path = e.path
                                    AND e2.edit_id <> e.edit_id AND e2.start_line <= e.end_line
                                    AND e.start_line <= e2.end_line) THEN 'overlapping edit' END AS error
      FROM e)
"""

ORACLE["edit_status"] = f"WITH {EDIT_CHECK} SELECT CAST(edit_id AS BIGINT) AS edit_id, path, error FROM c"

ORACLE["apply_edits"] = f"""
WITH {EDIT_CHECK},
v AS (SELECT * FROM c WHERE error IS NULL),
newl AS (SELECT path, least(start_line, nl + 1) AS anchor, start_line AS s0, edit_id AS e0, i AS seq,
                arr[i] AS line
         FROM (SELECT v.*, string_split(snippet, chr(10)) AS arr FROM v) v,
              LATERAL generate_series(1, len(arr)) AS g(i)
         WHERE NOT (i = len(arr) AND arr[i] = '')),
kept AS (SELECT l.path, l.line_no AS anchor, 0 AS s0, 0 AS e0, 0 AS seq, l.line FROM l
         WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.path = l.path
                           AND l.line_no BETWEEN v.start_line AND v.end_line)),
a AS (SELECT * FROM kept UNION ALL SELECT * FROM newl)
SELECT path, CAST(count(*) AS BIGINT) AS n_lines,
       md5(string_agg(line, chr(10) ORDER BY anchor, s0, e0, seq) || chr(10)) AS text_md5
FROM a GROUP BY path
"""

# the same edits over a tree that has empty files, and whole files deleted
TREE_EDITS = f"""
SELECT * FROM ({EDITS}) o WHERE path NOT IN (SELECT 'doc/' || doc_id || '.txt' FROM documents WHERE doc_id % 19 = 4)
UNION ALL SELECT doc_id * 10 + 6, 'doc/' || doc_id || '.txt', 1, 1000000, '' FROM documents WHERE doc_id % 19 = 4
UNION ALL SELECT doc_id * 10 + 7, 'empty/' || doc_id || '.txt', 1, 1, 'first line' FROM documents WHERE doc_id % 29 = 3
"""

TREE = f"""
l AS ({LINES_P}),
n AS (SELECT 'doc/' || d.doc_id || '.txt' AS path, (SELECT count(*) FROM l WHERE l.path = 'doc/' || d.doc_id || '.txt') AS nl
      FROM documents d
      UNION ALL SELECT 'empty/' || doc_id || '.txt', 0 FROM documents WHERE doc_id % 29 = 3),
e AS (SELECT ed.*, n.nl,
        CASE WHEN n.nl IS NULL THEN 'file not found'
             WHEN start_line < 1 OR end_line < start_line THEN 'invalid range' END AS err
      FROM ({TREE_EDITS}) ed LEFT JOIN n ON n.path = ed.path),
c AS (SELECT e.*, CASE WHEN err IS NOT NULL THEN err
                       WHEN EXISTS (SELECT 1 FROM e e2 WHERE e2.err IS NULL AND e2.path = e.path
                                    AND e2.edit_id <> e.edit_id AND e2.start_line <= e.end_line
                                    AND e.start_line <= e2.end_line) THEN 'overlapping edit' END AS error
      FROM e),
after AS (
  SELECT n.path, CAST(n.nl - coalesce((SELECT count(*) FROM l JOIN c ON c.path = l.path AND c.error IS NULL
                                        AND l.line_no BETWEEN c.start_line AND c.end_line WHERE l.path = n.path), 0)
    + coalesce((SELECT sum(CASE WHEN c.snippet = '' THEN 0 ELSE len(string_split(c.snippet, chr(10))) END)
                FROM c WHERE c.path = n.path AND c.error IS NULL), 0) AS BIGINT) AS n_lines
  FROM n)
"""

ORACLE["edited_files"] = f"WITH {TREE} SELECT path, n_lines FROM after"

ORACLE["edit_tree_status"] = f"""
WITH {TREE}
SELECT CAST(c.edit_id AS BIGINT) AS edit_id, c.path, c.error, nullif(a.n_lines, 0) AS n_lines, nullif(a.n_lines, 0) AS last_line
FROM c LEFT JOIN after a ON a.path = c.path
"""

ORACLE["duplicate_long_blocks"] = f"""
WITH l AS ({LINES_P}),
w AS (SELECT path, line_no, string_agg(line, chr(10)) OVER r AS blk, count(*) OVER r AS k
      FROM l WINDOW r AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
h AS (SELECT path, line_no, sha256(blk) AS block_hash FROM w WHERE k = 5)
SELECT block_hash, CAST(count(*) AS BIGINT) AS n,
       arg_min(path, (path, line_no)) AS first_path,
       CAST(arg_min(line_no, (path, line_no)) AS BIGINT) AS first_line
FROM h GROUP BY block_hash HAVING count(*) > 1
"""

ORACLE["duplicate_blocks"] = f"""
WITH l AS ({LINES_P}),
w AS (SELECT path, line_no, line || chr(10) || lead(line) OVER (PARTITION BY path ORDER BY line_no) AS blk
      FROM l),
h AS (SELECT path, line_no, sha256(blk) AS block_hash FROM w WHERE blk IS NOT NULL)
SELECT block_hash, CAST(count(*) AS BIGINT) AS n,
       arg_min(path, (path, line_no)) AS first_path,
       CAST(arg_min(line_no, (path, line_no)) AS BIGINT) AS first_line
FROM h GROUP BY block_hash HAVING count(*) > 1
"""



def run_places_sql(k: int) -> str:
    """Places of maximal repeated runs, from the counts of k and k + 1 lines."""
    def lines_from(n):
        return " || chr(10) || ".join(["line", *[f"lead(line, {i}) OVER f" for i in range(1, n)]])

    return f"""
WITH l AS ({LINES_P}),
w AS (SELECT path, line_no, sha256({lines_from(k)}) AS u, sha256({lines_from(k + 1)}) AS uv
      FROM l WINDOW f AS (PARTITION BY path ORDER BY line_no)),
c AS (SELECT *, count(*) OVER (PARTITION BY u) AS n, count(*) OVER (PARTITION BY uv) AS n_uv FROM w WHERE u IS NOT NULL),
e AS (SELECT *, uv IS NOT NULL AND n_uv = n AND lead(n) OVER (PARTITION BY path ORDER BY line_no) = n AS linked FROM c),
g AS (SELECT *, CASE WHEN coalesce(lag(linked) OVER (PARTITION BY path ORDER BY line_no), false) THEN 0 ELSE 1 END AS starts FROM e),
s AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY line_no) AS run FROM g)
SELECT path, CAST(min(line_no) AS BIGINT) AS first_line, CAST(count(*) + {k - 1} AS BIGINT) AS n_lines,
       arg_min(u, line_no) AS block_hash, CAST(min(n) AS BIGINT) AS n
FROM s WHERE n > 1 GROUP BY path, run"""


ORACLE["run_places"] = run_places_sql(4)

ORACLE["repeated_runs"] = f"""
SELECT block_hash, max(n_lines) AS n_lines, max(n) AS n, arg_min(path, (path, first_line)) AS first_path,
       arg_min(first_line, (path, first_line)) AS first_line
FROM ({run_places_sql(2)}) r GROUP BY block_hash
"""

NEW_LINES = f"""
SELECT path, line_no * 10 AS k,
       CASE WHEN line_no % 5 = 2 THEN line || ' (edited)' ELSE line END AS line
FROM ({LINES_P}) a WHERE line_no % 7 <> 3
UNION ALL
SELECT path, line_no * 10 + 2, 'added after line ' || line_no FROM ({LINES_P}) b WHERE line_no % 6 = 1
"""

VERSIONS = f"""
WITH ed AS (SELECT path, string_agg(line, chr(10) ORDER BY k) AS text FROM ({NEW_LINES}) nl GROUP BY path),
o AS (SELECT doc_id, 'doc/' || doc_id || '.txt' AS path, text FROM documents),
nw AS (SELECT o.path, CASE WHEN o.doc_id % 4 = 1 THEN o.text ELSE ed.text END AS text
       FROM o LEFT JOIN ed ON ed.path = o.path
       WHERE o.doc_id % 11 <> 0 AND (CASE WHEN o.doc_id % 4 = 1 THEN o.text ELSE ed.text END) IS NOT NULL
       UNION ALL
       SELECT 'doc/' || doc_id || '-copy.txt', text FROM documents WHERE doc_id % 13 = 0)
SELECT coalesce(o.path, nw.path) AS path, o.text AS old, nw.text AS new
FROM o FULL OUTER JOIN nw ON nw.path = o.path
"""

STATUS = """CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed'
                 WHEN old = new THEN 'same' ELSE 'modified' END"""


def split_sql(src: str, key: str, text: str) -> str:
    """Lines (no terminators) of ``text`` in ``src``; text holds only '\\n' breaks."""
    return f"""
SELECT {key}, arr[i] AS line FROM (SELECT {key}, string_split({text}, chr(10)) AS arr FROM {src}
                                   WHERE {text} IS NOT NULL) t,
       LATERAL generate_series(1, len(arr)) AS g(i)
WHERE NOT (i = len(arr) AND arr[i] = '')"""


ORACLE["snapshot_diff"] = f"""
WITH v AS ({VERSIONS}),
st AS (SELECT path, {STATUS} AS status, old, new FROM v),
ch AS (SELECT * FROM st WHERE status <> 'same'),
sl AS (SELECT path, line, -1 AS sign FROM ({split_sql('ch', 'path', 'old')}) a
       UNION ALL SELECT path, line, 1 FROM ({split_sql('ch', 'path', 'new')}) b),
pl AS (SELECT path, line, sum(sign) AS d FROM sl GROUP BY path, line),
pf AS (SELECT path, sum(CASE WHEN d > 0 THEN d ELSE 0 END) AS a, sum(CASE WHEN d < 0 THEN -d ELSE 0 END) AS r
       FROM pl GROUP BY path)
SELECT st.path, st.status, CAST(coalesce(pf.a, 0) AS BIGINT) AS lines_added,
       CAST(coalesce(pf.r, 0) AS BIGINT) AS lines_removed
FROM st LEFT JOIN pf ON pf.path = st.path
"""

ORACLE["changed_only"] = f"""
SELECT path, {STATUS} AS status, md5(old) AS old_md5, md5(new) AS new_md5
FROM ({VERSIONS}) v WHERE old IS DISTINCT FROM new
"""

DELTA = f"""
SELECT path, line_no * 10 AS seq,
       CASE WHEN line_no % 7 = 3 OR line_no % 5 = 2 THEN '- ' ELSE '  ' END || line || chr(10) AS line
FROM ({LINES_P}) a
UNION ALL
SELECT path, line_no * 10 + 1, '+ ' || line || ' (edited)' || chr(10)
FROM ({LINES_P}) b WHERE line_no % 7 <> 3 AND line_no % 5 = 2
UNION ALL
SELECT path, line_no * 10 + 2, '+ added after line ' || line_no || chr(10)
FROM ({LINES_P}) c WHERE line_no % 6 = 1
"""

ORACLE["restore_side"] = f"""
WITH d AS ({DELTA})
SELECT path, CAST(1 AS BIGINT) AS side, CAST(count(*) AS BIGINT) AS n_lines,
       md5(string_agg(substring(line, 3), '' ORDER BY seq)) AS text_md5
FROM d WHERE left(line, 2) IN ('  ', '- ') GROUP BY path
UNION ALL
SELECT path, CAST(2 AS BIGINT), CAST(count(*) AS BIGINT),
       md5(string_agg(substring(line, 3), '' ORDER BY seq))
FROM d WHERE left(line, 2) IN ('  ', '+ ') GROUP BY path
"""

# ---------------------------------------------------------------- requests, answers

REQUESTS = """
SELECT conv_id AS session, turn,
       CASE WHEN conv_id % 4 = 1 AND turn = 2 THEN ' EXIT '
            WHEN conv_id % 6 = 2 AND turn = 1 THEN 'quit'
            WHEN turn % 7 = 3 THEN '   ' ELSE text END AS text
FROM conversations
"""

ORACLE["session_requests"] = f"""
WITH r AS ({REQUESTS}),
f AS (SELECT *, max(CASE WHEN lower({STRIP.format(x='text')}) IN ('exit', 'quit') THEN 1 ELSE 0 END)
               OVER (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING) AS closed
      FROM r)
SELECT session, turn, md5(text) AS text_md5 FROM f
WHERE closed = 0 AND {STRIP.format(x='text')} <> ''
"""

ROUTED = """
SELECT conv_id, turn, CASE turn % 7
    WHEN 0 THEN 'remove dead code in ' WHEN 1 THEN 'convert this project to go: '
    WHEN 2 THEN 'check dependencies of ' WHEN 3 THEN 'simplify ' WHEN 4 THEN 'analyze '
    WHEN 5 THEN 'refactor lines ' || (turn + 1) || '~' || (turn + 5) || ' of ' ELSE '' END || text AS text
FROM conversations
"""

RANGE_RE = "(\\d+)\\s*[~-]\\s*(\\d+)"

ORACLE["route_requests"] = f"""
SELECT conv_id, turn,
  CASE WHEN regexp_matches(lower(text), '{RANGE_RE}') THEN 'refactor_partial'
       WHEN regexp_matches(lower(text), 'dead[ _-]?code') THEN 'refactor_dead_code'
       WHEN regexp_matches(lower(text), 'convert|translate|migrate') THEN 'convert_language'
       WHEN regexp_matches(lower(text), 'dependenc|package|requirement|version') THEN 'deps_analyze'
       WHEN regexp_matches(lower(text), 'simplif|clean|refactor') THEN 'refactor_simplify'
       WHEN regexp_matches(lower(text), 'analy[sz]|explain|review') THEN 'analyze' END AS tool,
  CASE WHEN regexp_matches(lower(text), '{RANGE_RE}')
       THEN TRY_CAST(regexp_extract(lower(text), '{RANGE_RE}', 1) AS BIGINT) END AS start_line,
  CASE WHEN regexp_matches(lower(text), '{RANGE_RE}')
       THEN TRY_CAST(regexp_extract(lower(text), '{RANGE_RE}', 2) AS BIGINT) END AS end_line
FROM ({ROUTED}) r
"""

SPECS = """
SELECT event_id AS request_id, CASE
  WHEN event_id % 16 = 15 THEN 'tool=' || event_type
  WHEN event_id % 8 = 0 THEN '{"tool": "analyze", "path": "src/' || user_id || '"}'
  WHEN event_id % 8 = 1 THEN '{"tool": "refactor_partial", "path": "a.py", "start_line": ' || user_id
       || ', "end_line": ' || (user_id + 3) || ', "kind": "' || event_type || '"}'
  WHEN event_id % 8 = 2 THEN '{"tool": "refactor_partial", "path": "b.py", "start_line": "' || user_id || '"}'
  WHEN event_id % 8 = 3 THEN '{"tool": "refactor_partial", "start_line": "ten"}'
  WHEN event_id % 8 = 4 THEN '{"tool": "convert_language", "path": "proj", "src_lang": "python", "tgt_lang": "go"}'
  WHEN event_id % 8 = 5 THEN '{"tool": "convert_language", "tgt_lang": "rust"}'
  WHEN event_id % 8 = 6 THEN '[' || props || ']'
  ELSE '{"tool": "deps_analyze", "summary": "false", ' || substring(props, 2) END AS body
FROM events
"""

ORACLE["normalize_requests"] = f"""
WITH s AS (SELECT request_id, body,
                  CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' ELSE FALSE END AS obj
           FROM ({SPECS}) x),
g AS (SELECT request_id, obj,
        CASE WHEN obj THEN json_extract_string(body, '$.tool') END AS tool,
        CASE WHEN obj THEN json_extract_string(body, '$.path') END AS path,
        CASE WHEN obj THEN json_type(body, '$.summary') END AS summary_t,
        CASE WHEN obj THEN json_extract_string(body, '$.start_line') END AS start_s,
        CASE WHEN obj THEN json_extract_string(body, '$.end_line') END AS end_s,
        CASE WHEN obj THEN json_extract_string(body, '$.kind') END AS kind,
        CASE WHEN obj THEN json_extract_string(body, '$.instruction') END AS instruction,
        CASE WHEN obj THEN json_extract_string(body, '$.global_instruction') END AS global_instruction,
        CASE WHEN obj THEN json_extract_string(body, '$.scope') END AS scope,
        CASE WHEN obj THEN json_extract_string(body, '$.src_lang') END AS src_lang,
        CASE WHEN obj THEN json_extract_string(body, '$.tgt_lang') END AS tgt_lang,
        CASE WHEN obj THEN json_extract_string(body, '$.target_stack_desc') END AS tsd,
        CASE WHEN obj THEN json_extract(body, '$.summary') END AS summary_j
      FROM s)
SELECT request_id,
  CASE WHEN obj THEN tool END AS tool,
  CASE WHEN obj THEN coalesce(path, '.') END AS path,
  CASE WHEN obj THEN CASE WHEN summary_t = 'BOOLEAN' THEN CAST(summary_j AS BOOLEAN) ELSE TRUE END END AS summary,
  CASE WHEN obj THEN coalesce(TRY_CAST(start_s AS BIGINT), 1) END AS start_line,
  CASE WHEN obj THEN coalesce(TRY_CAST(end_s AS BIGINT), TRY_CAST(start_s AS BIGINT), 1) END AS end_line,
  CASE WHEN obj THEN coalesce(kind, 'custom') END AS kind,
  CASE WHEN obj THEN coalesce(kind, 'custom') IN ('style', 'bugfix', 'performance', 'readability',
                                                  'cleanup', 'custom') END AS valid_kind,
  CASE WHEN obj THEN coalesce(instruction, '') END AS instruction,
  CASE WHEN obj THEN coalesce(global_instruction, '') END AS global_instruction,
  CASE WHEN obj THEN coalesce(scope, 'auto') END AS scope,
  CASE WHEN obj THEN src_lang END AS src_lang,
  CASE WHEN obj THEN tgt_lang END AS tgt_lang,
  CASE WHEN obj THEN coalesce(CASE WHEN tsd <> '' THEN tsd END,
                              'An idiomatic ' || tgt_lang || ' project using its standard library.') END
    AS target_stack_desc,
  CASE WHEN NOT obj THEN 'not a JSON object'
       WHEN tool IS NULL OR tool NOT IN ('analyze', 'refactor_dead_code', 'refactor_simplify',
                                         'refactor_partial', 'convert_language', 'deps_analyze') THEN 'unknown tool'
       WHEN summary_t IS NOT NULL AND summary_t <> 'NULL' AND summary_t <> 'BOOLEAN' THEN 'summary must be a boolean'
       WHEN start_s IS NOT NULL AND TRY_CAST(start_s AS BIGINT) IS NULL THEN 'start_line is not an integer'
       WHEN end_s IS NOT NULL AND TRY_CAST(end_s AS BIGINT) IS NULL THEN 'end_line is not an integer'
       WHEN tool = 'convert_language' AND (coalesce(src_lang, '') = '' OR coalesce(tgt_lang, '') = '')
         THEN 'src_lang and tgt_lang are required' END AS error
FROM g
"""

ANSWERS = """
SELECT event_id AS key, CASE event_id % 6
  WHEN 0 THEN '{"files": [{"path": "src/e' || event_id || '.ts", "content": "v' || user_id
       || '"}, {"path": ' || user_id || ', "content": "x"}, {"path": "p' || event_id
       || '", "content": null}], "notes": "' || event_type || '"}'
  WHEN 1 THEN '{"files": [], "notes": ' || user_id || '}'
  WHEN 2 THEN '[1, 2, 3]'
  WHEN 3 THEN '{"files": ' || props || ', "notes": "n"}'
  WHEN 4 THEN '{"files": [' || props || ', "oops", {"path": "q.go", "content": "' || event_type || '"}]}'
  ELSE 'not json ' || event_type END AS answer
FROM events
"""

ORACLE["parse_answers"] = f"""
WITH a AS (SELECT key, answer, CASE WHEN NOT json_valid(answer) THEN 'invalid'
                                    WHEN json_type(answer) = 'OBJECT' THEN 'object'
                                    WHEN json_type(answer) = 'ARRAY' THEN 'array' ELSE 'scalar' END AS kind
           FROM ({ANSWERS}) x)
SELECT key, kind,
       CASE WHEN kind = 'invalid' THEN 'invalid JSON' WHEN kind <> 'object' THEN 'not a JSON object' END AS error,
       CASE WHEN kind = 'object' THEN coalesce(json_extract_string(answer, '$.notes'), '') END AS notes
FROM a
"""

ORACLE["converted_files"] = f"""
WITH a AS (SELECT key, json_extract(answer, '$.files') AS files FROM ({ANSWERS}) x
           WHERE CASE WHEN json_valid(answer) THEN json_type(answer) = 'OBJECT' ELSE FALSE END),
e AS (SELECT key, i - 1 AS pos, json_extract(files, '$[' || (i - 1) || ']') AS e
      FROM a, LATERAL generate_series(1, CAST(json_array_length(files) AS BIGINT)) AS g(i)
      WHERE json_type(files) = 'ARRAY')
SELECT key, CAST(pos AS BIGINT) AS pos, json_extract_string(e, '$.path') AS path,
       md5(json_extract_string(e, '$.content')) AS content_md5
FROM e WHERE json_type(e, '$.path') = 'VARCHAR' AND json_type(e, '$.content') = 'VARCHAR'
"""

ISSUE_TYPE = "['missing', 'unused', 'conflict', 'outdated', 'other', 'bogus'][l_linenumber % 6 + 1]"
ISSUE_FILE = """CASE l_linenumber % 4 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'package.json'
                WHEN 2 THEN 'docs/' || l_partkey || '.md' ELSE '' END"""

ANALYSIS = f"""
SELECT l_orderkey AS key, json_object(
  'summary', 'order ' || l_orderkey,
  'issues', CAST('[' || string_agg(CAST(json_object(
     'type', {ISSUE_TYPE}, 'file', {ISSUE_FILE},
     'detail', 'part ' || l_partkey, 'suggestion', 'supplier ' || l_suppkey) AS VARCHAR), ','
     ORDER BY l_linenumber, {ISSUE_TYPE}, {ISSUE_FILE}, 'part ' || l_partkey, 'supplier ' || l_suppkey)
     || ']' AS JSON)
) AS answer
FROM lineitem GROUP BY l_orderkey
"""

ISSUES = f"""
WITH a AS (SELECT key, json_extract(answer, '$.issues') AS arr FROM ({ANALYSIS}) x),
e AS (SELECT key, i - 1 AS pos, json_extract(arr, '$[' || (i - 1) || ']') AS e
      FROM a, LATERAL generate_series(1, CAST(json_array_length(arr) AS BIGINT)) AS g(i)
      WHERE json_type(arr) = 'ARRAY')
SELECT key, CAST(pos AS BIGINT) AS pos, json_extract_string(e, '$.type') AS type,
       json_extract_string(e, '$.file') AS file, json_extract_string(e, '$.detail') AS detail,
       json_extract_string(e, '$.suggestion') AS suggestion,
       coalesce(json_extract_string(e, '$.type') IN ('missing', 'unused', 'conflict', 'outdated', 'other'),
                FALSE) AS type_ok
FROM e
"""

ORACLE["issues_table"] = ISSUES

ORACLE["issue_report"] = f"""
WITH it AS ({ISSUES}),
n AS (SELECT *, row_number() OVER (PARTITION BY key, file ORDER BY pos) AS n FROM it
      WHERE file IS NOT NULL AND file <> ''),
r AS (SELECT key, file, CAST(count(*) AS BIGINT) AS n_issues,
             string_agg('#' || n || ' ' || coalesce(type, 'unknown') || chr(10) || '  what: '
                        || coalesce(detail, '-') || chr(10) || '  fix: '
                        || coalesce(suggestion, '-') || chr(10), chr(10) ORDER BY n) AS report
      FROM n GROUP BY key, file),
f AS (SELECT o_orderkey AS key, 'requirements.txt' AS path FROM orders
      UNION ALL SELECT o_orderkey, 'package.json' FROM orders WHERE o_orderstatus = 'O')
SELECT key, file, n_issues,
       CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.key = r.key AND f.path = r.file) THEN 'ok' ELSE 'skipped' END
         AS status,
       md5(report) AS report_md5
FROM r
"""

ORACLE["issue_counts"] = f"SELECT type, CAST(count(*) AS BIGINT) AS n FROM ({ISSUES}) i GROUP BY type"

# ---------------------------------------------------------------- dependencies, hygiene

MANIFEST = """
SELECT 'order-' || o_orderkey AS project,
       CASE WHEN starts_with(o_orderpriority, '1') THEN 'requirements-dev.txt' ELSE 'requirements.txt' END AS path,
       l_linenumber AS line_no,
       CASE WHEN l_partkey % 17 = 0 THEN '# pinned by ops'
            WHEN l_partkey % 13 = 5 THEN chr(9) || 'part-' || l_partkey || '>=' || l_linenumber || '.0,<' || l_suppkey || '.5'
            WHEN l_partkey % 13 = 6 THEN 'part-' || l_partkey || '===' || l_linenumber || '.0'
            WHEN l_partkey % 13 = 7 THEN 'part-' || l_partkey || ' @ https://example.org/p-' || l_partkey || '.whl'
            WHEN l_partkey % 13 = 8 THEN 'part-' || l_partkey || ' >= 1 or so'
            WHEN l_partkey % 13 = 9 THEN 'part-' || l_partkey || '==' || l_linenumber || '.*'
            WHEN l_partkey % 13 = 10 THEN 'part-' || l_partkey || ' (==' || l_linenumber || '.5.0rc1)'
            WHEN l_linenumber % 6 = 0 THEN 'part_' || l_partkey || '==' || l_suppkey || '.' || l_linenumber
            WHEN l_linenumber % 6 = 1 THEN 'Part-' || l_partkey || ' >= ' || l_suppkey || '.' || l_linenumber
                                           || ' ; python_version >= "3.8"'
            WHEN l_linenumber % 6 = 2 THEN 'part.' || l_partkey || '  # no pin'
            WHEN l_linenumber % 6 = 3 THEN '-r base.txt'
            WHEN l_linenumber % 6 = 4 THEN 'part-' || l_partkey || '[extra]~=' || l_suppkey || '.' || l_linenumber
                                           || '  # compatible'
            ELSE 'PyYAML==' || l_linenumber || '.0' END AS line
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

def _norm(x):
    return f"regexp_replace(lower({x}), '[-_.]+', '-', 'g')"


# Written from the rule: split off the marker, then the name, then each clause.
REQS = f"""
WITH m AS (SELECT project, path AS file, line_no, trim(regexp_replace(line, '(^|\\s)#.*$', ''), ' ' || chr(9)) AS b
           FROM ({MANIFEST}) x WHERE regexp_matches(path, '(^|/)requirements[^/]*\\.txt$')),
h AS (SELECT *, trim(split_part(b, ';', 1)) AS head,
             CASE WHEN contains(b, ';') THEN nullif(trim(substring(b, strpos(b, ';') + 1)), '') END AS mark
      FROM m WHERE b <> ''),
n AS (SELECT *, regexp_extract(head, '^[A-Za-z0-9][A-Za-z0-9._-]*') AS name FROM h),
r AS (SELECT *, trim(regexp_replace(trim(substring(head, length(name) + 1)), '^\\[[^\\]]*\\]', '')) AS rest FROM n),
c AS (SELECT *, list_transform(list_filter(string_split(trim(rest, '()'), ','), lambda y: y <> ''), lambda x: trim(x)) AS cl FROM r),
k AS (SELECT *, CASE WHEN starts_with(b, '-') THEN 'directive' WHEN name = '' THEN 'invalid'
                     WHEN starts_with(rest, '@') THEN 'url'
                     WHEN len(list_filter(cl, lambda x: NOT regexp_full_match(x, '[=~!<>]+\\s*[^\\s]+')
                                                        OR regexp_extract(x, '^[=~!<>]+') NOT IN
                                                           ('===', '==', '~=', '!=', '<=', '>=', '<', '>'))) > 0 THEN 'invalid'
                     ELSE 'requirement' END AS kind FROM c),
u AS (SELECT *, unnest(CASE WHEN kind = 'requirement' AND len(cl) > 0 THEN range(len(cl)) ELSE [0] END) AS i FROM k)
SELECT project, file, CAST(line_no AS BIGINT) AS line_no, CAST(i AS BIGINT) AS clause,
  CASE WHEN kind IN ('requirement', 'url') THEN {_norm('name')} END AS pkg,
  CASE WHEN kind = 'requirement' AND len(cl) > 0 THEN regexp_extract(cl[i + 1], '^[=~!<>]+') END AS op,
  CASE WHEN kind = 'requirement' AND len(cl) > 0 THEN trim(regexp_replace(cl[i + 1], '^[=~!<>]+', '')) END AS version,
  CASE WHEN kind IN ('requirement', 'url') THEN mark END AS marker, kind
FROM u
"""

ORACLE["parse_manifests"] = REQS

# The items that package.json files are rendered from, read without JSON.
ORACLE["package_json"] = """
WITH i AS (
  SELECT l_orderkey, lower('@p/Part-' || l_partkey || '-' || l_linenumber) AS pkg, l_linenumber AS n, min(l_suppkey) AS s
  FROM lineitem WHERE l_orderkey % 50 <> 0 GROUP BY l_orderkey, l_partkey, l_linenumber)
SELECT 'order-' || l_orderkey AS project, 'web/package.json' AS file, pkg,
  CASE n WHEN 1 THEN '^' WHEN 3 THEN '=' WHEN 5 THEN '>=' END AS op,
  CASE n WHEN 1 THEN s || '.0.0' WHEN 3 THEN s || '.1.0-beta' WHEN 5 THEN s || '.2' END AS version,
  CASE n WHEN 3 THEN 'dev' END AS marker, CASE n WHEN 4 THEN 'url' ELSE 'requirement' END AS kind
FROM i
UNION ALL
SELECT DISTINCT 'order-' || l_orderkey, 'web/package.json', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
  CAST(NULL AS VARCHAR), 'invalid' FROM lineitem WHERE l_orderkey % 50 = 0
"""

CODE = """
SELECT 'order-' || o_orderkey AS project, 'main.py' AS path, l_linenumber AS line_no,
       'import part_' || l_partkey AS line
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N'
UNION ALL SELECT 'order-' || (o_orderkey - 1), 'lib/helpers.py', l_linenumber,
       'from part_' || l_partkey || '.sub import thing'
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1
UNION ALL SELECT 'order-' || o_orderkey, 'main.py', l_linenumber, 'import os, sys as system  # read, write'
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 2
UNION ALL SELECT 'order-' || o_orderkey, 'main.py', l_linenumber, 'from . import sibling'
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 3
UNION ALL SELECT 'order-' || o_orderkey, 'main.py', l_linenumber, 'from util import helper'
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 4
UNION ALL SELECT 'order-' || o_orderkey, 'web/index.js', l_linenumber,
       'const x = require(''@scope/part-' || l_partkey || '/sub'')'
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 5
UNION ALL SELECT 'order-' || o_orderkey, 'web/index.js', l_linenumber, 'import y from ''lodash'''
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 6
UNION ALL SELECT 'order-' || o_orderkey, 'main.py', l_linenumber, 'import yaml; import re'
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 7
"""

IMPORTS = f"""
WITH c AS ({CODE}),
st AS (SELECT project, path, line_no, unnest(string_split(split_part(line, '#', 1), ';')) AS x FROM c WHERE ends_with(path, '.py')),
py_imp AS (SELECT project, path, line_no, regexp_extract(trim(y), '^([A-Za-z_]\\w*)', 1) AS module
           FROM (SELECT *, unnest(string_split(substring(trim(x), 8), ',')) AS y FROM st WHERE starts_with(trim(x), 'import ')) a),
py_from AS (SELECT project, path, line_no, regexp_extract(trim(x), '^from\\s+([A-Za-z_]\\w*)[\\w.]*\\s+import\\b', 1) AS module
            FROM st WHERE starts_with(trim(x), 'from ')),
js AS (SELECT project, path, line_no, regexp_extract(m, '^(@[^/]+/[^/]+|[^/]+)', 1) AS module
       FROM (SELECT *, unnest(list_concat(
                 regexp_extract_all(line, 'require\\(\\s*[''"]([^''"]+)[''"]\\s*\\)', 1),
                 regexp_extract_all(line, '\\bfrom\\s+[''"]([^''"]+)[''"]', 1))) AS m
             FROM c WHERE regexp_matches(path, '\\.(js|jsx|ts|tsx|mjs|cjs)$')) b)
SELECT project, path, CAST(line_no AS BIGINT) AS line_no, module
FROM (SELECT * FROM py_imp UNION ALL SELECT * FROM py_from UNION ALL SELECT * FROM js) u
WHERE module <> '' AND NOT starts_with(module, '.')
"""

ORACLE["extract_imports"] = IMPORTS

ALIAS = "(VALUES ('yaml', 'PyYAML'), ('dotenv', 'python-dotenv'), ('sklearn', 'scikit-learn')) AS al(module, pkg)"

IMPORTED = f"""
SELECT DISTINCT i.project, i.module, coalesce({_norm('al.pkg')}, {_norm('i.module')}) AS pkg
FROM ({IMPORTS}) i LEFT JOIN {ALIAS} ON al.module = i.module
"""

ORACLE["unused_deps"] = f"""
SELECT r.project, r.file, r.line_no, r.pkg FROM ({REQS}) r
WHERE r.kind IN ('requirement', 'url') AND r.clause = 0
  AND NOT EXISTS (SELECT 1 FROM ({IMPORTED}) u WHERE u.project = r.project AND u.pkg = r.pkg)
"""

ORACLE["missing_deps"] = f"""
WITH files AS (SELECT DISTINCT project, path FROM ({CODE}) c
               UNION SELECT 'order-' || o_orderkey, 'util.py' FROM orders WHERE o_orderstatus = 'F'),
mods AS (SELECT DISTINCT project, module FROM (
           SELECT project, regexp_extract(path, '([A-Za-z_]\\w*)\\.py$', 1) AS module FROM files
           UNION ALL SELECT project, CASE WHEN contains(path, '/')
                                     THEN regexp_extract(path, '^([A-Za-z_]\\w*)/', 1) END FROM files) x
         WHERE module IS NOT NULL AND module <> '')
SELECT i.project, i.module, i.pkg FROM ({IMPORTED}) i
WHERE NOT EXISTS (SELECT 1 FROM ({REQS}) r WHERE r.kind IN ('requirement', 'url') AND r.project = i.project
                  AND r.pkg = i.pkg)
  AND i.module NOT IN ('os', 'sys', 'json', 're', 'typing', 'pathlib', 'collections')
  AND NOT EXISTS (SELECT 1 FROM mods WHERE mods.project = i.project AND mods.module = i.module)
"""

ORACLE["version_conflicts"] = f"""
WITH r AS (SELECT * FROM ({REQS}) x WHERE kind = 'requirement'),
g AS (SELECT project, pkg,
             list_sort(list_distinct(list(CASE WHEN op IN ('==', '===') AND NOT contains(version, '*') THEN version END))) AS pins,
             max(CASE WHEN op IN ('==', '===', '~=', '<', '<=') THEN 1 ELSE 0 END) AS bound
      FROM r GROUP BY project, pkg)
SELECT project, pkg, CAST(len(pins) AS BIGINT) AS n_pins, array_to_string(pins, ', ') AS pins,
       CASE WHEN len(pins) > 1 THEN 'multiple pins' ELSE 'open range' END AS reason
FROM g WHERE len(pins) > 1 OR bound = 0
"""


# Versions of the rendered files: release numbers and maybe rc1, padded to four numbers.
def _vkey(x):
    numbers = ", ".join(f"coalesce(TRY_CAST(split_part(regexp_replace({x}, 'rc1$', ''), '.', {i}) AS BIGINT), 0)" for i in range(1, 5))
    return f"[{numbers}, CASE WHEN ends_with({x}, 'rc1') THEN 0 ELSE 1 END]"


ORACLE["outdated_deps"] = f"""
WITH r AS (SELECT * FROM ({REQS}) x WHERE kind = 'requirement' AND op IN ('==', '===') AND NOT contains(version, '*')),
lt AS (SELECT 'part-' || p_partkey AS pkg, p_size || '.5' AS latest FROM part)
SELECT r.project, r.file, r.line_no, r.pkg, r.version, lt.latest
FROM r JOIN lt ON lt.pkg = r.pkg
WHERE {_vkey('r.version')} < {_vkey('lt.latest')}
"""

ORACLE["deps_issues"] = f"""
SELECT project, 'unused' AS type, file, pkg || ' is never imported' AS detail, 'remove ' || pkg AS suggestion
FROM ({ORACLE['unused_deps']}) a
UNION ALL SELECT project, 'missing', '', module || ' is imported but not declared', 'add ' || pkg FROM ({ORACLE['missing_deps']}) b
UNION ALL SELECT project, 'conflict', '', pkg || ': ' || reason,
  CASE WHEN n_pins > 1 THEN 'keep one of ' || pins ELSE 'set an upper bound' END FROM ({ORACLE['version_conflicts']}) c
UNION ALL SELECT project, 'outdated', file, pkg || ' ' || version, 'raise to ' || latest FROM ({ORACLE['outdated_deps']}) d
"""

ORACLE["answer_summary"] = f"""
WITH a AS (SELECT 'o' || key AS key, CAST(answer AS VARCHAR) AS answer FROM ({ANALYSIS}) x
           UNION ALL SELECT 'e' || key, answer FROM ({ANSWERS}) y),
k AS (SELECT key, answer, CASE WHEN NOT json_valid(answer) THEN 'invalid JSON'
                               WHEN json_type(answer) <> 'OBJECT' THEN 'not a JSON object' END AS error FROM a)
SELECT key, CASE WHEN error IS NULL THEN coalesce(json_extract_string(answer, '$.summary'), '') END AS summary,
  CAST(CASE WHEN error IS NULL AND json_type(answer, '$.issues') = 'ARRAY' THEN json_array_length(answer, '$.issues') ELSE 0 END AS BIGINT)
    AS n_issues, error
FROM k
"""

ORACLE["resolve_scope"] = f"""
WITH f AS ({FILES}),
q AS (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN './' || split_part(path, '/', 1) || '/' WHEN 2 THEN '.' WHEN 3 THEN 'gone/' || path
                     ELSE path END AS path, ['auto', 'file', 'project'][doc_id % 3 + 1] AS scope, path AS orig,
             CASE doc_id % 5 WHEN 1 THEN 'folder' WHEN 2 THEN 'all' WHEN 3 THEN 'none' ELSE 'file' END AS what FROM f),
n AS (SELECT split_part(path, '/', 1) AS folder, count(*) AS n FROM f GROUP BY 1),
t AS (SELECT q.*, CASE WHEN what = 'none' THEN NULL WHEN scope = 'file' THEN CASE WHEN what = 'file' THEN 'file' END
                       WHEN scope = 'project' THEN 'project' WHEN what = 'file' THEN 'file' ELSE 'project' END AS target FROM q)
SELECT doc_id, path, scope, target,
  CAST(CASE WHEN target = 'file' THEN 1 WHEN target IS NULL THEN 0 WHEN what = 'all' THEN (SELECT count(*) FROM f)
            ELSE (SELECT n FROM n WHERE folder = split_part(orig, '/', 1)) END AS BIGINT) AS n_files,
  CASE WHEN target IS NULL THEN CASE WHEN what = 'none' THEN 'no such path' ELSE 'not a ' || scope END END AS scope_error
FROM t
"""

PART_CODE = """
SELECT 'brand' || regexp_extract(p_brand, '(\\d+)', 1) || '.py' AS path, p_partkey AS line_no,
  CASE p_size % 6
    WHEN 0 THEN 'import m' || p_size
    WHEN 1 THEN 'def f' || p_partkey || '(x):'
    WHEN 2 THEN '    return f' || (p_partkey - 1) || '(x) + v' || (p_partkey - 2)
    WHEN 3 THEN 'v' || p_partkey || ' = ' || p_size
    WHEN 4 THEN 'class C' || p_partkey || ':'
    ELSE 'from pkg' || p_size || ' import name' || p_partkey || ' as alias' || p_partkey END AS line
FROM part
"""

DEF_RULES = [
    ("import", "^\\s*import\\s+[A-Za-z_][\\w.]*\\s+as\\s+([A-Za-z_]\\w*)\\s*$"),
    ("import", "^\\s*import\\s+([A-Za-z_]\\w*)\\s*$"),
    ("import", "^\\s*from\\s+[\\w.]+\\s+import\\s+[A-Za-z_]\\w*\\s+as\\s+([A-Za-z_]\\w*)\\s*$"),
    ("import", "^\\s*from\\s+[\\w.]+\\s+import\\s+([A-Za-z_]\\w*)\\s*$"),
    ("function", "^\\s*def\\s+([A-Za-z_]\\w*)"),
    ("class", "^\\s*class\\s+([A-Za-z_]\\w*)"),
    ("variable", "^([A-Za-z_]\\w*)\\s*=([^=]|$)"),
]
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in DEF_RULES) + " END"
_NAME = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN regexp_extract(line, '{p}', 1)"
                           for k, p in DEF_RULES) + " END"

ORACLE["unused_definitions"] = f"""
WITH l AS ({PART_CODE}),
d AS (SELECT path, line_no, {_KIND} AS kind, {_NAME} AS name FROM l),
t AS (SELECT path, unnest(regexp_extract_all(line, '[A-Za-z_]\\w*')) AS name FROM l),
c AS (SELECT path, name, count(*) AS n FROM t GROUP BY path, name)
SELECT d.path, CAST(d.line_no AS BIGINT) AS line_no, d.kind, d.name
FROM d JOIN c ON c.path = d.path AND c.name = d.name
WHERE d.name IS NOT NULL AND NOT starts_with(d.name, '__') AND c.n = 1
"""

# ---------------------------------------------------------------- prompts, inference, rewrites

import string as _string  # noqa: E402

from ..operators.prompts import TEMPLATES  # noqa: E402


def sql_render(template: str, fields: dict[str, str]) -> str:
    """A template as a SQL concatenation (fields given as SQL expressions)."""
    parts = []
    for literal, name, _s, _c in _string.Formatter().parse(template):
        if literal:
            pieces = literal.replace("'", "''").split("\n")
            parts.append(" || chr(10) || ".join(f"'{p}'" for p in pieces))
        if name is not None:
            parts.append(f"({fields[name]})")
    return " || ".join(parts)


DOC_FILES = "SELECT source AS project, 'doc/' || doc_id || '.txt' AS path, text AS code, doc_id FROM documents"
DEAD_SYS, DEAD_USER = TEMPLATES["dead_code"]
PY_STRIP = STRIP

ORACLE["render_prompts"] = f"""
SELECT path, md5({sql_render(DEAD_SYS, {})}) AS system_md5,
       md5({sql_render(DEAD_USER, {'path': 'path', 'code': 'code'})}) AS user_md5,
       CAST(length({sql_render(DEAD_USER, {'path': 'path', 'code': 'code'})}) AS BIGINT) AS user_chars
FROM ({DOC_FILES}) f
"""

ORACLE["batch_infer"] = f"""
SELECT path, md5({STRIP.format(x="replace(code, 'the', 'THE')")}) AS answer_md5, CAST(NULL AS VARCHAR) AS error
FROM ({DOC_FILES}) f
"""

ORACLE["answer_store"] = ORACLE["batch_infer"]

ORACLE["rewrite_corpus"] = f"""
WITH v AS (SELECT project, path, doc_id, code AS old, {STRIP.format(x="replace(code, 'the', 'THE')")} AS new
           FROM ({DOC_FILES}) f)
SELECT project, path,
       CASE WHEN old = new THEN 'unchanged' WHEN coalesce(l.quality = 1, FALSE) THEN 'would write'
            ELSE 'rejected' END AS status,
       md5(new) AS new_md5
FROM v LEFT JOIN labels l ON l.doc_id = v.doc_id
"""

ORACLE["write_approved"] = f"""
WITH v AS ({VERSIONS})
SELECT v.path, CASE WHEN old IS NOT DISTINCT FROM new THEN 'unchanged'
                    WHEN coalesce(l.quality = 1, FALSE) THEN 'would write' ELSE 'rejected' END AS status
FROM v LEFT JOIN labels l ON 'doc/' || l.doc_id || '.txt' = v.path
"""

ORACLE["write_rounds"] = f"""
WITH v AS ({VERSIONS}),
c AS (SELECT v.*, l.quality, l.toxic FROM v JOIN labels l ON 'doc/' || l.doc_id || '.txt' = v.path
      WHERE old IS DISTINCT FROM new)
SELECT path, CASE WHEN toxic = 1 THEN '2' ELSE '1' END AS version, md5(new) AS content_md5
FROM c WHERE quality = 1 OR toxic = 1
"""

ORACLE["partial_rewrite_apply"] = f"""
WITH l AS ({LINES_P}), s AS ({SELECTIONS}),
v AS (SELECT * FROM s WHERE end_line >= start_line AND path IN (SELECT path FROM l)),
sn AS (SELECT v.sel_id, v.path, v.start_line, string_agg(l.line, chr(10) ORDER BY l.line_no) AS t
       FROM v LEFT JOIN l ON l.path = v.path AND l.line_no BETWEEN v.start_line AND v.end_line GROUP BY ALL),
r AS (SELECT sel_id, path, start_line, {STRIP.format(x="replace(coalesce(t, ''), 'the', 'THE')")} AS t FROM sn),
nw AS (SELECT path, start_line AS anchor, i AS seq, arr[i] AS line
       FROM (SELECT r.*, string_split(t, chr(10)) AS arr FROM r) q, LATERAL generate_series(1, len(arr)) AS g(i)
       WHERE NOT (i = len(arr) AND arr[i] = '')),
kept AS (SELECT l.path, l.line_no AS anchor, 0 AS seq, l.line FROM l
         WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.path = l.path AND l.line_no BETWEEN v.start_line AND v.end_line)),
a AS (SELECT * FROM kept UNION ALL SELECT * FROM nw)
SELECT path, CAST(count(*) AS BIGINT) AS n_lines, md5(string_agg(line, chr(10) ORDER BY anchor, seq) || chr(10)) AS text_md5
FROM a GROUP BY path
"""

ORACLE["partial_rewrite"] = f"""
WITH x AS ({ORACLE['extract_ranges'].replace('md5(coalesce(x.snippet,', 'md5(coalesce(x.snippet,')}),
l AS ({LINES_P}), s AS ({SELECTIONS}),
n AS (SELECT path, max(line_no) AS nl FROM l GROUP BY path),
e AS (SELECT s.*, n.nl,
        CASE WHEN n.nl IS NULL THEN 'file not found'
             WHEN start_line < 1 OR end_line < start_line THEN 'invalid range' END AS error
      FROM s LEFT JOIN n ON n.path = s.path),
sn AS (SELECT e.sel_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no), '') AS snippet
       FROM e LEFT JOIN l ON l.path = e.path AND l.line_no BETWEEN e.start_line AND e.end_line
       WHERE e.error IS NULL GROUP BY e.sel_id)
SELECT e.sel_id, e.path, e.start_line, e.end_line,
       CASE WHEN e.error IS NULL THEN md5(sn.snippet) END AS original_md5,
       CASE WHEN e.error IS NULL THEN md5({STRIP.format(x="replace(sn.snippet, 'the', 'THE')")}) END
         AS refactored_md5,
       FALSE AS applied, e.error
FROM e LEFT JOIN sn ON sn.sel_id = e.sel_id
"""

ORACLE["place_outputs"] = f"""
WITH cf AS ({ORACLE['converted_files'].replace("md5(json_extract_string(e, '$.content')) AS content_md5",
                                                "json_extract_string(e, '$.content') AS content")}),
o AS (SELECT event_id AS key, 'src/e' || event_id || '.py' AS orig_path, 'proj' || user_id AS root,
             event_id % 2 = 0 AS single FROM events),
c AS (SELECT cf.*, o.orig_path, o.root, o.single,
             row_number() OVER (PARTITION BY cf.key ORDER BY cf.pos) AS rn,
             regexp_extract(regexp_extract(cf.path, '[^/]*$', 0), '^.+(\\.[^.]+)$', 1) AS sfx
      FROM cf JOIN o ON o.key = cf.key),
t AS (SELECT *, CASE WHEN sfx = '' THEN orig_path
                     ELSE CASE WHEN regexp_extract(regexp_extract(orig_path, '[^/]*$', 0), '^.+(\\.[^.]+)$', 1) = ''
                               THEN orig_path
                               ELSE left(orig_path, length(orig_path) - length(regexp_extract(
                                    regexp_extract(orig_path, '[^/]*$', 0), '^.+(\\.[^.]+)$', 1))) END || sfx
                END AS tgt
      FROM c)
SELECT key, pos, tgt AS target_path, CASE WHEN tgt <> orig_path THEN 'rename' ELSE 'replace' END AS action,
       CAST(NULL AS VARCHAR) AS error
FROM t WHERE single AND rn = 1
UNION ALL
SELECT key, pos,
       CASE WHEN NOT (starts_with(path, '/') OR list_contains(string_split(path, '/'), '..'))
            THEN root || '_converted_to_Type_Script/' || path END,
       'write',
       CASE WHEN starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') THEN 'unsafe path' END
FROM c WHERE NOT single
"""

ORACLE["request_stream"] = ORACLE["session_requests"]

ORACLE["request_stream_dead"] = f"""
WITH r AS ({REQUESTS}),
f AS (SELECT *, max(CASE WHEN lower({STRIP.format(x='text')}) IN ('exit', 'quit') THEN 1 ELSE 0 END)
               OVER (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING) AS closed FROM r)
SELECT session, turn, CASE WHEN closed = 1 THEN 'after exit' ELSE 'blank' END AS status
FROM f WHERE closed = 1 OR {STRIP.format(x='text')} = ''
"""

# Line chunks with carried lines (500 characters, overlap 200 -> 20 lines):
# at a break, the lines carried are those of the closing chunk, among the last
# 20, whose sum together with the next line fits; sums grow with the count, so
# the count of fitting suffixes is the longest one.
ORACLE["chunk_lines_overlap"] = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, line_no, line, length(line) AS len,
         sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) AS cum0
  FROM ({DOC_LINES_KEEPENDS}) x),
r(doc_id, line_no, chunk_no, cur_start, cur_len) AS (
  SELECT doc_id, line_no, 0, 1, len FROM l WHERE line_no = 1
  UNION ALL
  SELECT r.doc_id, n.line_no,
         CASE WHEN r.cur_len + n.len <= 500 THEN r.chunk_no ELSE r.chunk_no + 1 END,
         CASE WHEN r.cur_len + n.len <= 500 THEN r.cur_start
              ELSE n.line_no - (SELECT count(*) FROM l l2
                                WHERE l2.doc_id = r.doc_id
                                  AND l2.line_no BETWEEN greatest(n.line_no - 20, r.cur_start) AND n.line_no - 1
                                  AND n.cum0 - l2.cum0 + n.len <= 500) END,
         CASE WHEN r.cur_len + n.len <= 500 THEN r.cur_len + n.len
              ELSE n.len + coalesce((SELECT n.cum0 - min(l2.cum0) FROM l l2
                                     WHERE l2.doc_id = r.doc_id
                                       AND l2.line_no BETWEEN greatest(n.line_no - 20, r.cur_start) AND n.line_no - 1
                                       AND n.cum0 - l2.cum0 + n.len <= 500), 0) END
  FROM r JOIN l n ON n.doc_id = r.doc_id AND n.line_no = r.line_no + 1
),
c AS (SELECT doc_id, chunk_no, min(cur_start) AS s, max(line_no) AS e FROM r GROUP BY doc_id, chunk_no)
SELECT c.doc_id, CAST(c.chunk_no AS BIGINT) AS chunk_no, CAST(c.s AS BIGINT) AS start_line,
       CAST(sum(length(l.line)) AS BIGINT) AS chunk_chars,
       md5(string_agg(l.line, '' ORDER BY l.line_no)) AS chunk_md5
FROM c JOIN l ON l.doc_id = c.doc_id AND l.line_no BETWEEN c.s AND c.e
GROUP BY c.doc_id, c.chunk_no, c.s
"""

ORACLE["convert_projects"] = f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY project, pack ORDER BY path) AS rn
           FROM (SELECT *, CAST({PACK} AS BIGINT) AS pack FROM ({FILES}) x WHERE {CORPUS}) t),
s AS (SELECT project, pack, path, content, rn,
             regexp_extract(regexp_extract(path, '[^/]*$', 0), '^.+(\\.[^.]+)$', 1) AS sfx FROM f),
c AS (SELECT project, pack, rn, content,
             CASE WHEN sfx = '' THEN path ELSE left(path, length(path) - length(sfx)) END || '.go' AS newpath
      FROM s)
SELECT project, pack, CAST(rn - 1 AS BIGINT) AS pos, newpath AS path,
       project || '_converted_to_go/' || newpath AS target_path, 'write' AS action,
       md5(replace(content, 'the', 'THE')) AS content_md5, CAST(NULL AS VARCHAR) AS error
FROM c
"""

