import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from textmill.llm import jaccard_join
from textmill.llm.jaccard_join import Threshold, jaccard_components, region_keys, smallest_reachable

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    """Every pair that shares a shingle, and components by repeated minima."""
    sets = [shingles(t, size) for _, t in rows]
    posts = defaultdict(list)
    for i, s in enumerate(sets):
        for z in s:
            posts[z].append(i)
    links = []
    for i, s in enumerate(sets):
        c = Counter(j for z in s for j in posts[z])
        links.append([j for j, m in c.items() if j != i and 100 * m >= percent * (len(s) + len(sets[j]) - m)])
    label = list(range(len(rows)))
    while True:
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    ids = defaultdict(list)
    for i, c in enumerate(label):
        ids[c].append(rows[i][0])
    small = {c: min((x for x in v if x is not None), default=None) for c, v in ids.items()}
    return sorted(((r[0], len(sets[i]), small[label[i]], len(links[i])) for i, r in enumerate(rows)), key=repr)


def edited(rng, words, share):
    t = list(words)
    for _ in range(rng.randint(0, max(1, int(len(t) * share)))):
        t[rng.randrange(len(t))] = f"w{rng.randrange(60)}"
    return t[: rng.randint(max(1, int(len(t) * 0.85)), len(t))] if rng.random() < 0.3 else t


@pytest.fixture(scope="module")
def groups():
    rng, rows = random.Random(4), []
    for _ in range(14):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 3, 5, 8, 12, 20, 40, 90, 200]))]
        rows += [" ".join(edited(rng, base, 0.08)) for _ in range(rng.randint(1, 25))]
    return list(enumerate(rows))


def test_groups_equal_brute_force(spark, groups):
    df = spark.createDataFrame(groups, "doc_id long, text string")
    for size, percent in ((4, 85), (5, 80)):
        got = sorted(map(tuple, jaccard_components(df, words=size, percent=percent).collect()), key=repr)
        assert got == brute(groups, size, percent)


@pytest.mark.parametrize("how", [dict(leaf_points=12, pivots=3, levels=2), dict(leaf_points=8, levels=0)])
def test_large_regions_are_cut_by_pivots_and_blocks(spark, groups, how):
    df = spark.createDataFrame(groups, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df, **how).collect()), key=repr) == brute(groups, 4, 85)


def test_a_tight_group_is_not_copied_by_every_cut(spark, monkeypatch):
    """Near copies, all with different texts, at default levels: pivots cannot cut
    them, so they go to blocks and no level has more than SPREAD rows a point."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(300):
        t = list(base)
        t[rng.randrange(len(t))] = f"x{i}"
        rows.append((i, " ".join(t)))
    levels, written = [], jaccard_join.materialize

    def counted(df, name):
        out = written(df, name)
        if name == "jaccard-members":
            levels.append(out.count())
            assert levels[-1] <= 4 * len(rows), levels
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_components(df, leaf_points=40).collect()), key=repr)
    assert got == brute(rows, 4, 85)
    assert len(levels) >= 2, levels
    # by shingles alone: few points to a region, blocks by weight
    got = sorted(map(tuple, jaccard_components(df, leaf_shingles=9_000).collect()), key=repr)
    assert got == brute(rows, 4, 85)


def test_groups_with_a_common_passage_are_no_component(spark, monkeypatch):
    """Near copies of twelve texts, a third of each being one passage: regions that lie in
    the passage tie no groups, so no set is copied to meet other groups."""
    rng, rows = random.Random(5), []
    passage = [f"p{i}" for i in range(70)]
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(130)] + passage
        for i in range(3):
            t = list(base)
            t[rng.randrange(130)] = f"x{g}y{i}"
            rows.append((3 * g + i, " ".join(t)))
    sizes, written = [], jaccard_join.materialize

    def counted(df, name):
        out = written(df, name)
        if name == "jaccard-members":
            sizes.append(sorted(r["count"] for r in out.groupBy("region").count().collect()))
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_components(df, words=5, percent=80, leaf_points=8).collect()), key=repr)
    assert got == brute(rows, 5, 80)
    assert sizes == [[3] * 12]


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = sorted(map(tuple, jaccard_components(odd_docs).collect()), key=repr)
    assert got == brute(odd_rows, 4, 85)
    assert jaccard_components(no_docs).collect() == []


def test_texts_of_one_id_meet_only_their_own_carrier(spark, groups, monkeypatch):
    """All ids null or one: each text of a set is made a set again once, not once
    for each carrier of the id."""
    made, written = [], jaccard_join.materialize

    def counted(df, name):
        if name == "jaccard-kept":
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            made.extend(line for line in plan.splitlines() if "Join Inner" in line)
        return written(df, name)

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    for ident in (None, 7):
        rows = [(ident, t) for _, t in groups]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, jaccard_components(df).collect()), key=repr) == brute(rows, 4, 85)
    assert made and all("<=>" in line and "h#" in line and "c_h#" in line for line in made), made


def test_corpus(sf_docs):
    rows = [tuple(r) for r in sf_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard_components(sf_docs).collect()), key=repr) == brute(rows, 4, 85)


def test_linked_sets_share_a_root_region():
    rng = np.random.default_rng(2)
    for percent in (80, 85):
        th = Threshold(percent)
        for n in [*range(1, 60), 100, 333, 1000]:
            for _ in range(6):
                union = rng.integers(0, 2**63, n, dtype=np.uint64)
                drop = int(n * (100 - percent) / 100)
                cut = rng.integers(0, drop + 1)
                a, b = np.unique(union[cut:]), np.unique(union[: n - (drop - cut)])
                common = np.intersect1d(a, b).size
                assert th.linked(common, len(a), len(b))
                if common < n:
                    for known in (0, 0.2, 0.5, 1):
                        often = np.unique(union[rng.random(n) < known])
                        assert np.intersect1d(region_keys(a, th, often), region_keys(b, th, often)).size, (n, percent)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 300)], "a long, b long")
    got = {r["node"]: r["root"] for r in smallest_reachable(edges, "t").collect()}
    assert got == {**{i: 0 for i in range(71)}, 200: 200, 300: 200}


def test_links_of_a_large_tight_leaf():
    """Near copies by the matrix product, others by postings: the same as sets say."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 80, dtype=np.uint64)
    sets = []
    for i in range(400):
        s = base.copy() if i % 5 else rng.integers(0, 2**63, 40, dtype=np.uint64)
        k = rng.integers(0, 12)
        s[rng.choice(len(s), k, replace=False)] = rng.integers(0, 2**63, k, dtype=np.uint64)
        sets.append(np.unique(s))
    sets += [s.copy() for s in sets[:3]]
    th, copies = Threshold(85), rng.integers(1, 4, len(sets))
    edges, links = jaccard_join.leaf_links(th, np.arange(len(sets)), np.ones(len(sets), bool), sets, copies)
    python = [set(s.tolist()) for s in sets]
    near = [[j for j, t in enumerate(python) if j != i and 100 * len(s & t) >= 85 * len(s | t)] for i, s in enumerate(python)]
    assert links.tolist() == [int(copies[x].sum()) for x in near]
    label = list(range(len(sets)))
    for _ in range(9):
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(sets))]
    parent = dict(zip(edges[:, 1].tolist(), edges[:, 0].tolist()))
    assert [parent.get(i, i) for i in range(len(sets))] == label
