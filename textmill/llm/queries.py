"""Registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import language_id, lexical_search, license_scan, merkle, quality, sharding, whitening
from textmill.llm.byte_bpe import bpe_digests
from textmill.llm.common import fold, materialize, table
from textmill.llm.exact_dedup import exact_groups
from textmill.llm.jaccard_join import jaccard_components
from textmill.llm.mixing import mix_totals
from textmill.llm.token_counts import token_counts
from textmill.llm.weighted_sampling import edit_report


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs, language_id.learn(docs))
    held = (fold(F.col("doc_id")) == 0).alias("held_out")
    rejected = (F.col("lang").isNull() & (F.col("lang_best") != language_id.UNKNOWN)).alias("rejected")
    return out.select("doc_id", held, F.col("lang_best").alias("lang_pred"), "score", "margin", rejected)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_totals(table(spark, sf_dir, "documents"))


def damaged(payload: Column) -> tuple[Column, Column]:
    """A record in a second replica of rendered archives, and how often it is there:
    by rule of the page id, a byte is flipped, the record's end is lost, or the
    record is missing or doubled."""
    n = F.col("page_id") % 211
    flip = F.concat(F.expr("substring(payload, 1, 40)"), F.lit("#").cast("binary"), F.expr("substring(payload, 42)"))
    other = F.when(n == 17, flip).when(n == 40, F.expr("substring(payload, 1, octet_length(payload) - 2)")).otherwise(payload)
    return other, F.when(n == 60, 2).when(n == 83, 0).otherwise(1)


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages against a damaged replica: one row an archive with
    both roots, its leaves that differ and its damaged records."""
    other, copies = damaged(F.col("payload"))
    # payloads stay where they are rendered: windows and trees see lengths and digests
    records = merkle.rendered(table(spark, sf_dir, "pages")).select(
        "page_id", "archive", "length", "digest", F.octet_length(other).cast("long").alias("o_length"), F.sha2(other, 256).alias("o_digest"), copies.alias("copies"))
    records = materialize(merkle.with_offsets(records), "merkle-records")
    first = records.select("archive", "offset", "length", "digest").distinct()
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    second = records.where("copies > 0").select("archive", "offset", F.col("o_length").alias("length"), F.col("o_digest").alias("digest"), copy)
    second = second.withColumn("offset", F.col("offset") + F.col("copy")).drop("copy").distinct()
    roots, leaves, bad = merkle.audit_digests(first, second, leaf_bytes=1 << 16, fanout=16)
    n_leaves = leaves.groupBy("archive").agg(F.count("*").alias("n_leaves"))
    kinds = [F.sum((F.col("status") == s).cast("long")).alias(f"n_{s}") for s in ("changed", "missing", "extra")]
    found = bad.groupBy("archive").agg(*kinds, F.min("offset").alias("first_bad"), F.max("offset").alias("last_bad"))
    out = roots.join(n_leaves, "archive", "left").join(found, "archive", "left")
    out = out.fillna(0, ["n_leaves", "n_changed", "n_missing", "n_extra"])
    return out.withColumn("intact", F.col("root_a").eqNullSafe(F.col("root_b")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, machine)


def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(table(spark, sf_dir, "documents"))


def grid(vector: Column) -> Column:
    """Whole 64ths, moved by a million."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 64) + F.lit(1_000_000))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & finite).select("vec_id", grid(F.col("embedding")).alias("x"))
    learnt = whitening.learn(rows, "x", components=16)
    shares = F.array(*[F.lit(float(e)) for e in learnt.explained]) if learnt else F.array().cast("array<double>")
    out = whitening.whiten(rows, learnt, "vec_id", "x").select(
        "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(learnt.n if learnt else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(learnt.identity_error if learnt else 0.0).alias("identity_error"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest is taken from the rows that the shuffle has written."""
    docs = sharding.shuffle_shards(table(spark, sf_dir, "documents"), n_shards=16, bucket_bytes=16 << 20)
    size = sharding.text_size(F.col("text"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_source_mix": op5_source_mix,
    "op6_merkle_fixity": op6_merkle_fixity,
    "op7_license_scan": op7_license_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_fm": op9_quality_fm,
    "op10_weighted_sampling": op10_weighted_sampling,
    "op11_whitening": op11_whitening,
    "op12_lexical_search": op12_lexical_search,
    "op13_shuffle_shards": op13_shuffle_shards,
}

_OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rnk FROM per),
w2 AS (
  SELECT *, CASE rnk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM weighted),
lev AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(source_size) OVER f_before, 0) AS BIGINT) AS filled,
         CAST(sum(weight) OVER f_on AS BIGINT) AS open_w,
         row_number() OVER (ORDER BY source_size / weight, rnk) AS pos
  FROM w2
  WINDOW f_before AS (ORDER BY source_size / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         f_on AS (ORDER BY source_size / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cap AS (
  SELECT *, 3 * total - 4 * filled AS a, 2 * open_w AS b,
         2 * source_size * (2 * open_w) <= weight * (3 * total - 4 * filled) AS capped FROM lev),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(weight * (SELECT arg_min(a, pos) FROM cap WHERE NOT capped) AS DOUBLE)
                   / CAST((SELECT arg_min(b, pos) FROM cap WHERE NOT capped) AS DOUBLE) END AS target
  FROM cap),
placed AS (
  SELECT doc_id, source, size,
         CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start_w
  FROM sized)
SELECT p.doc_id, p.size, t.source_size, t.target,
       CAST(greatest(0, least(p.start_w + p.size, CAST(floor(t.target) AS BIGINT)) - p.start_w)
          + greatest(0, least(p.start_w + t.source_size + p.size, CAST(floor(t.target) AS BIGINT))
                        - p.start_w - t.source_size) AS BIGINT) AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""

_OP8 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: The same trees, node by node, without descending: leaves and two levels above them.
_OP6 = r"""
WITH r AS (
  SELECT page_id, page_id // 500 AS archive, encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
    || chr(13) || chr(10) || chr(13) || chr(10)) AS payload FROM pages),
o AS (
  SELECT *, CAST(coalesce(sum(octet_length(payload)) OVER (PARTITION BY archive ORDER BY page_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offs FROM r),
x AS (
  SELECT 'a' AS rep, archive, offs, sha256(payload) AS digest FROM o
  UNION ALL
  SELECT 'b', archive, offs + c.c, sha256(CASE page_id % 211
      WHEN 17 THEN array_slice(payload, 1, 40) || encode('#') || array_slice(payload, 42, octet_length(payload))
      WHEN 40 THEN array_slice(payload, 1, octet_length(payload) - 2) ELSE payload END)
  FROM o, (VALUES (0), (1)) c(c) WHERE page_id % 211 <> 83 AND (c.c = 0 OR page_id % 211 = 60)),
l0 AS (
  SELECT rep, archive, offs // 65536 AS node, count(*) AS n,
    sha256(string_agg(offs || ':' || digest, chr(10) ORDER BY offs, digest)) AS digest FROM x GROUP BY ALL),
l1 AS (SELECT rep, archive, node // 16 AS node, sum(n) AS n, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY l0.node)) AS digest
       FROM l0 GROUP BY rep, archive, l0.node // 16),
l2 AS (SELECT rep, archive, node // 16 AS node, sum(n) AS n, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY l1.node)) AS digest
       FROM l1 GROUP BY rep, archive, l1.node // 16),
l3 AS (SELECT rep, archive, node // 16 AS node, sum(n) AS n, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY l2.node)) AS digest
       FROM l2 GROUP BY rep, archive, l2.node // 16),
depth AS (SELECT CASE WHEN max(node) = 0 THEN 0 WHEN max(node) < 16 THEN 1 WHEN max(node) < 256 THEN 2 ELSE 3 END AS d FROM l0),
root AS (
  SELECT * FROM l0 WHERE (SELECT d FROM depth) = 0 UNION ALL SELECT * FROM l1 WHERE (SELECT d FROM depth) = 1
  UNION ALL SELECT * FROM l2 WHERE (SELECT d FROM depth) = 2 UNION ALL SELECT * FROM l3 WHERE (SELECT d FROM depth) = 3),
leaf AS (
  SELECT coalesce(p.archive, q.archive) AS archive, count(*) AS n_leaves
  FROM (SELECT * FROM l0 WHERE rep = 'a') p FULL JOIN (SELECT * FROM l0 WHERE rep = 'b') q USING (archive, node)
  WHERE p.digest IS DISTINCT FROM q.digest GROUP BY 1),
bad AS (
  SELECT coalesce(p.archive, q.archive) AS archive, coalesce(p.offs, q.offs) AS offs,
    CASE WHEN q.digest IS NULL THEN 'missing' WHEN p.digest IS NULL THEN 'extra' ELSE 'changed' END AS status
  FROM (SELECT * FROM x WHERE rep = 'a') p FULL JOIN (SELECT * FROM x WHERE rep = 'b') q USING (archive, offs)
  WHERE p.digest IS DISTINCT FROM q.digest),
found AS (
  SELECT archive, count(*) FILTER (status = 'changed') AS n_changed, count(*) FILTER (status = 'missing') AS n_missing,
    count(*) FILTER (status = 'extra') AS n_extra, min(offs) AS first_bad, max(offs) AS last_bad FROM bad GROUP BY archive)
SELECT archive, a.digest AS root_a, CAST(a.n AS BIGINT) AS n_a, b.digest AS root_b, CAST(b.n AS BIGINT) AS n_b,
  coalesce(n_leaves, 0) AS n_leaves, coalesce(n_changed, 0) AS n_changed, coalesce(n_missing, 0) AS n_missing,
  coalesce(n_extra, 0) AS n_extra, first_bad, last_bad, a.digest IS NOT DISTINCT FROM b.digest AS intact
FROM (SELECT * FROM root WHERE rep = 'a') a FULL JOIN (SELECT * FROM root WHERE rep = 'b') b USING (archive)
LEFT JOIN leaf USING (archive) LEFT JOIN found USING (archive)
"""

_OP12 = r"""
WITH words AS (
  SELECT doc_id, term
  FROM (SELECT doc_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents)),
tfs AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM words GROUP BY doc_id, term),
lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lens),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tfs, corpus GROUP BY term),
items AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS q
  FROM (SELECT item_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN tfs USING (term) JOIN lens USING (doc_id), corpus
  GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 20
"""

ORACLE = {"op5_source_mix": _OP5, "op6_merkle_fixity": _OP6, "op7_license_scan": license_scan.ORACLE, "op8_exact_dedup": _OP8,
          "op12_lexical_search": _OP12}
