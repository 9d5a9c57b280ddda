"""License scan: an exact set-similarity join of text blocks with templates.

A block of a text is a window of twice a template's length that starts at one of
the template's words. (Any window that matches still does when it starts at its
first word of the template, so whether a passage is found does not depend on what
stands before it.) A block matches when it holds at least 4/5 of the template's
words (containment) and the phrases that tell the licence from others, each in a
row. The template's words are ordered by how often they occur in the whole corpus,
rarest first:

* prefix filter: a matching block holds one of the first |T| - need + 1 words, so
  only blocks around such a word are looked at;
* length filter: the text has at least ``need`` words;
* positional filter: if the rarest word a block shares stands at place p of the
  order, it shares at most |T| - p words.

Only blocks that pass are compared. Everything stays inside the document's row,
so nothing is shuffled but the word counts of the templates' vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import lower_ascii

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values of the contract: phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Own templates: label, wording (words only; their order is not used) and the
#: phrases that a block must hold in a row.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache", "version 2 0")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("by nc", "4 0")),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike international license", ("sharealike",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
)


@dataclass(frozen=True)
class Template:
    label: str
    length: int  # words
    tokens: tuple[str, ...]  # distinct, rarest first
    need: int
    must: tuple[str, ...]  # phrases

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.tokens[: len(self.tokens) - self.need + 1]


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN)
    return F.filter(parts, lambda w: w != "")


def ordered_templates(
    docs: DataFrame, text_col: str, templates: tuple[tuple[str, str, tuple[str, ...]], ...], threshold: tuple[int, int]
) -> list[Template]:
    """Templates with their words in ascending order of corpus frequency. What
    reaches the driver is one count for each word of the templates."""
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    parts = F.split(lower_ascii(F.col(f"`{text_col}`")), BETWEEN)
    counts = docs.select(F.explode(parts).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count()
    freq = {r["w"]: r["count"] for r in counts.collect()}
    num, den = threshold
    out = []
    for label, text, must in templates:
        tokens = sorted(set(text.split()), key=lambda w: (freq.get(w, 0), w))
        out.append(Template(label, len(text.split()), tuple(tokens), -(-num * len(tokens) // den), must))
    return out


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def template_blocks(words: Column, hits: Column, n: Column, t: Template) -> Column:
    """The blocks that match ``t``: (first word, words of ``t`` that it holds).
    ``hits``: (place in the text, word) of all prefix words in the text."""
    prefix, tokens = _strings(t.prefix), _strings(t.tokens)
    size = 2 * t.length
    own = F.filter(hits, lambda h: F.array_contains(prefix, h["w"]))
    around = F.transform(own, lambda h: F.sequence(F.greatest(h["i"] - (size - 1), F.lit(0)), h["i"]))
    starts = F.filter(F.array_distinct(F.flatten(around)), lambda i: F.array_contains(tokens, F.get(words, i)))

    def held(i):
        block = F.slice(words, i + 1, F.lit(size))
        # rarest shared word first: its place bounds what the block can share
        first = F.array_position(F.transform(prefix, lambda w: F.array_contains(block, w)), True)
        bound = F.least(F.lit(len(t.tokens) + 1) - first, F.size(block))
        line = F.concat(F.lit(" "), F.array_join(block, " "), F.lit(" "))
        told = F.lit(True)
        for phrase in t.must:
            told = told & F.contains(line, F.lit(f" {phrase} "))
        shared = F.array_intersect(block, tokens)
        return F.when((first > 0) & (bound >= t.need) & told, shared).otherwise(F.array().cast("array<string>"))

    found = F.transform(starts, lambda i: F.struct(i.alias("start"), held(i).alias("shared")))
    found = F.filter(found, lambda m: F.size(m["shared"]) >= t.need)
    passes = F.arrays_overlap(words, prefix) & (n >= t.need)
    for w in sorted({w for phrase in t.must for w in phrase.split()}):
        passes = passes & F.array_contains(words, w)
    return F.when(passes, found)


def template_hits(words: Column, hits: Column, n: Column, t: Template) -> Column:
    """The most words of ``t`` that a block holds, if that is enough; else null."""
    return F.array_max(F.transform(template_blocks(words, hits, n, t), lambda m: F.size(m["shared"])))


def phrase_places(words: Column, n: Column, phrase: list[str]) -> Column:
    """Word numbers from 0 at which the phrase stands."""
    here = n >= len(phrase)
    for w in phrase:
        here = here & F.array_contains(words, w)

    def stands(i):
        ok = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            ok = ok & (F.get(words, i + k) == w)
        return ok

    every = F.sequence(F.lit(0), n - len(phrase))
    return F.when(here, F.filter(every, stands)).otherwise(F.array().cast("array<int>"))


def texts_with_hits(docs: DataFrame, id_col: str, text_col: str, plans: list[Template]) -> DataFrame:
    """``id, words, n, hits``: the words of each text, and place and word of those
    that are in the prefix of a template (null if there are none)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), words_of(F.col(f"`{text_col}`")).alias("words"))
    heads = _strings(sorted({w for t in plans for w in t.prefix}))
    numbered = F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    hits = F.when(F.arrays_overlap("words", heads), F.filter(numbered, lambda h: F.array_contains(heads, h["w"])))
    return rows.withColumns({"n": F.size("words"), "hits": hits})


def license_blocks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str, tuple[str, ...]], ...] = TEMPLATES,
    threshold: tuple[int, int] = (4, 5),
) -> DataFrame:
    """One row per matched block of each input row: ``id, label, start, shared``,
    the number of its first word from 0 and the template's words that it holds.
    Blocks that overlap are all returned. A null text has none; repeated rows have
    theirs each; other columns are not read; an empty table gives no rows."""
    plans = ordered_templates(docs, text_col, templates, threshold)
    rows = texts_with_hits(docs, id_col, text_col, plans)

    def found(t: Template) -> Column:
        blocks = F.coalesce(template_blocks(F.col("words"), F.col("hits"), F.col("n"), t), F.array())
        return F.transform(blocks, lambda m: F.struct(F.lit(t.label).alias("label"), m["start"].cast("long").alias("start"), F.array_sort(m["shared"]).alias("shared")))

    rows = rows.select("id", F.explode(F.concat(*[found(t) for t in plans])).alias("m"))
    return rows.select(F.col("id").alias(id_col), "m.label", "m.start", "m.shared")


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str, tuple[str, ...]], ...] = TEMPLATES,
    threshold: tuple[int, int] = (4, 5),
) -> DataFrame:
    """One row per input row: ``id, n_words, n_base, first_word, last_word,
    base_labels, labels, score``.

    ``n_base`` counts the places where a phrase's words stand in a row, and the
    first and last of them are word numbers from 0 (null without any). Labels
    are distinct, sorted and joined by commas, empty if there are none. The
    score is 1 with a phrase, else the largest share of a template's words that
    a matching block holds, else 0. A null text has no words. Rows may repeat;
    other columns are not read."""
    plans = ordered_templates(docs, text_col, templates, threshold)
    rows = texts_with_hits(docs, id_col, text_col, plans)
    words, n = F.col("words"), F.col("n")
    places = []
    for phrase, _ in PHRASES:
        places.append(phrase_places(words, n, phrase.split()))
    rows = rows.select("id", "words", "n", "hits", *[p.alias(f"p{i}") for i, p in enumerate(places)])
    found = [template_hits(F.col("words"), F.col("hits"), F.col("n"), t).alias(f"t{i}") for i, t in enumerate(plans)]
    rows = rows.select("id", "n", *[f"p{i}" for i in range(len(PHRASES))], *found)
    starts = F.concat(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    base = [F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]
    more = [F.when(F.col(f"t{i}").isNotNull(), F.lit(t.label)) for i, t in enumerate(plans)]
    share = [F.coalesce(F.col(f"t{i}").cast("double") / float(len(t.tokens)), F.lit(0.0)) for i, t in enumerate(plans)]
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(base + more).alias("labels"),
        F.greatest(F.when(F.size(starts) > 0, 1.0).otherwise(0.0), *share).alias("score"),
    )


def _template_rows() -> str:
    rows = []
    for label, text, must in TEMPLATES:
        tokens = sorted(set(text.split()))
        need = -(-4 * len(tokens) // 5)
        rows.append(f"('{label}', {len(text.split())}, {need}, {tokens!r}, {[f' {m} ' for m in must]!r})")
    return ",\n    ".join(rows)


#: Every block of every text against every template, without filters.
ORACLE = rf"""
WITH t(label, len, need, tokens, must) AS (VALUES
    {_template_rows()}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT r, doc_id, len(w) AS n, w,
    list_filter(range(len(w)), lambda i: w[i+1] = 'cc' AND w[i+2] = 'by') AS p0,
    list_filter(range(len(w)), lambda i: w[i+1] = 'general' AND w[i+2] = 'public' AND w[i+3] = 'license') AS p1,
    list_filter(range(len(w)), lambda i: w[i+1] = 'all' AND w[i+2] = 'rights' AND w[i+3] = 'reserved') AS p2 FROM d),
m AS (
  SELECT r, label, need, len(tokens) AS size,
    list_max(list_transform(list_filter(range(n), lambda i: list_contains(tokens, w[i + 1])), lambda i:
      CASE WHEN len(list_filter(must, lambda p: NOT contains(' ' || array_to_string(w[i + 1 : i + 2 * t.len], ' ') || ' ', p))) = 0
           THEN len(list_intersect(w[i + 1 : i + 2 * t.len], tokens)) ELSE 0 END)) AS best
  FROM b, t),
g AS (
  SELECT r, list(label) AS found, max(best::DOUBLE / size) AS share FROM m WHERE best >= need GROUP BY r),
l AS (
  SELECT b.*, p0 || p1 || p2 AS p, g.share, coalesce(g.found, []) AS found,
    list_filter([CASE WHEN len(p0) > 0 THEN 'cc-by' END, CASE WHEN len(p1) > 0 THEN 'gpl' END,
                 CASE WHEN len(p2) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS base
  FROM b LEFT JOIN g USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) AS BIGINT) AS first_word,
  CAST(list_max(p) AS BIGINT) AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || found)), ',') AS labels,
  greatest(CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(share, 0.0::DOUBLE)) AS score
FROM l
"""
