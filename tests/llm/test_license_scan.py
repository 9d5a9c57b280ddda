import re

from textmill.llm.license_scan import TEMPLATES, license_blocks, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def told(block, must):
    return all(any(block[i : i + len(p)] == p for i in range(len(block))) for p in map(str.split, must))


def brute(text):
    """Windows at every word: that only those at a word of the template need be looked at is part of the test."""
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts, base, found, score = [], set(), set(), 0.0
    for label, phrase in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    for label, wording, must in TEMPLATES:
        t, size = set(wording.split()), len(wording.split())
        best = max((len(t & set(w[i : i + 2 * size])) for i in range(len(w)) if told(w[i : i + 2 * size], must)), default=0)
        if 5 * best >= 4 * len(t):
            found.add(label)
            score = max(score, best / len(t))
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if starts else score)


def test_rows_equal_brute_force(spark, sf_docs, odd_docs, odd_rows, no_docs):
    rows = [
        (1, "Licensed under CC BY-NC 4.0. cc by cc by"),
        (2, "all rights. reserved; ALL RIGHTS RESERVED"),
        (3, "x " * 500 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software" + " y" * 40),
        (4, "redistribution and use in source and binary forms, permitted with modification"),
        (5, "the mit license"),
        (6, "general public\x00license ünder é1"),
        (7, None),
        (8, ""),
        (9, "released under the terms of the mit license"),
        (9, "released under the terms of the mit license"),
        (None, "cc by"),
    ]
    got = sorted(map(tuple, license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    texts = [tuple(r) for r in sf_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, license_scan(sf_docs).collect())) == sorted((i, *brute(t)) for i, t in texts)
    assert sorted(map(tuple, license_scan(odd_docs).collect()), key=repr) == sorted(((i, *brute(t)) for i, t in odd_rows), key=repr)
    assert license_scan(no_docs).collect() == []


def test_blocks_are_those_of_brute_force(spark, sf_docs, no_docs):
    rows = [
        (1, "x " * 30 + "Licensed under the Apache License, Version 2.0" + " y" * 30),
        (2, "released under the MIT license; " * 5),
        (3, "the mit license"),
        (4, None),
        (None, "released under the mit license"),
    ]
    rows += [tuple(r) for r in sf_docs.select("doc_id", "text").collect()]
    want = []
    for ident, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        for label, wording, must in TEMPLATES:
            t, size = set(wording.split()), len(wording.split())
            for i in range(len(w)):
                shared = t & set(w[i : i + 2 * size])
                if w[i] in t and 5 * len(shared) >= 4 * len(t) and told(w[i : i + 2 * size], must):
                    want.append((ident, label, i, sorted(shared)))
    got = map(tuple, license_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 6
    assert license_blocks(no_docs).collect() == []


def test_notices_get_their_labels_wherever_they_stand(spark):
    notices = {
        "licensed to you under the terms and conditions of the Apache Software License, Version 2.0": "apache-2.0",
        "licensed under CC BY 4.0": "cc-by",
        "licensed under CC BY-SA 4.0": "cc-by",
        "licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        "released under the Apache license": "",
        "released under the MIT license": "mit",
        "This work is licensed under the GNU General Public License, version 2": "gpl",
        "This work is licensed under the GNU General Public License, version 3": "gpl,gpl-3.0",
    }
    rows = [(offset, t, " ".join(["x"] * offset + [t] + ["y"] * 9)) for offset in range(12) for t in notices]
    docs = spark.createDataFrame(rows, "doc_id long, notice string, text string")
    wrong = [(r["doc_id"], r["labels"]) for r in license_scan(docs).collect()]
    got = sorted(wrong)
    assert got == sorted((offset, notices[t]) for offset, t, _ in rows)
