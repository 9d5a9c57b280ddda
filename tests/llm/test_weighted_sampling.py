import hashlib
from collections import Counter

from textmill.llm.weighted_sampling import edit_report, fingerprints


def general_jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 1.0


def test_edits_and_likeness(sf_docs):
    texts = sorted(((r[0], r[1] or "") for r in sf_docs.select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: r for r in edit_report(sf_docs).collect()}
    off = []
    for i, (d, t) in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        off.append(r["near_edited"] - general_jaccard(t, edited))
        assert abs(r["near_next"] - general_jaccard(t, nxt)) < 0.4
    assert abs(sum(off) / len(off)) < 0.03
    assert (sum(x * x for x in off) / len(off)) ** 0.5 < 0.13  # 32 samples: 0.088 at a half


def test_weights_count(spark):
    """Counts matter: the collision rate follows sum(min) / sum(max)."""
    a, b = "x " * 6 + "y " * 2, "x " * 2 + "y " * 6
    prints = {r[0]: r[1] for r in fingerprints(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), k=1024).collect()}
    same = sum(prints[1][i : i + 8] == prints[2][i : i + 8] for i in range(0, 8192, 8)) / 1024
    assert abs(same - 4 / 12) < 0.06


def test_odd_rows(odd_docs, odd_rows, no_docs, spark):
    got = edit_report(odd_docs).collect()
    assert len(got) == len(odd_rows)
    by_text = {}
    for r in got:
        text = dict((i, t or "") for i, t in odd_rows)[r["doc_id"]]
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert (r["fingerprint"] == "") == (not text.split())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert edit_report(no_docs).collect() == [] and fingerprints(no_docs).collect() == []
    lone = edit_report(spark.createDataFrame([(1, "abcdef gh")], "doc_id long, text string")).collect()
    assert lone[0]["edited_sha256"] == hashlib.sha256(b"abcdefabc").hexdigest() and lone[0]["near_next"] == 1.0
