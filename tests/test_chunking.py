"""Chunking by characters and by lines, with the two corrected defects."""

import random

import pytest

from textmill.operators.chunking import chunk_chars, chunk_lines


def chars(spark, text, m, o):
    df = spark.createDataFrame([(1, text)], "key long, text string")
    return [(r.chunk_no, r.start, r.chunk) for r in chunk_chars(df, "text", m, o).orderBy("chunk_no").collect()]


def lines_(spark, text, m, o):
    df = spark.createDataFrame([(1, text)], "key long, text string")
    return [(r.start_line, r.chunk) for r in chunk_lines(df, "text", m, o).orderBy("chunk_no").collect()]


def check_lines(text, got, limit, overlap):
    """What line chunks must satisfy, without building them again."""
    lines = text.splitlines(keepends=True)
    assert [] == got if not lines else got
    end = 0  # lines covered so far
    for i, (start, chunk) in enumerate(got):
        n = len(chunk.splitlines(keepends=True))
        assert "".join(lines[start - 1:start - 1 + n]) == chunk  # true start lines
        assert len(chunk) <= limit or n == 1
        carried = end - (start - 1)
        assert 0 <= carried <= overlap // 10 and (i > 0 or carried == 0)
        assert start - 1 + n > end  # at least one new line
        if i:
            # the first new line did not fit the chunk before
            assert len(got[i - 1][1]) + len(lines[end]) > limit
            # one line more would not have been carried: too many, all of the chunk, or no room
            before = len(got[i - 1][1].splitlines(keepends=True))
            if carried < min(overlap // 10, before):
                kept = sum(map(len, lines[end - carried - 1:end]))
                assert kept + len(lines[end]) > limit
        end = start - 1 + n
    assert end == len(lines)


def test_short_text_is_one_chunk(spark):
    assert chars(spark, "hello", 100, 10) == [(0, 0, "hello")]


def test_empty_text_is_one_empty_chunk(spark):
    assert chars(spark, "", 100, 10) == [(0, 0, "")]


def test_exactly_max_chars(spark):
    assert [c for _, _, c in chars(spark, "x" * 100, 100, 10)] == ["x" * 100]


def test_250_at_100_0(spark):
    assert [len(c) for _, _, c in chars(spark, "a" * 250, 100, 0)] == [100, 100, 50]


def test_overlap_of_5(spark):
    text = "".join(chr(97 + i % 26) for i in range(30))
    got = [c for _, _, c in chars(spark, text, 15, 5)]
    assert got == [text[0:15], text[10:25], text[20:30]]
    assert got[0][-5:] == got[1][:5]


def test_rebuild_500_at_120_20(spark):
    text = "".join(chr(65 + i % 50) for i in range(500))
    got = chars(spark, text, 120, 20)
    rebuilt = got[0][2] + "".join(c[20:] for _, _, c in got[1:])
    assert rebuilt == text and [len(c) for _, _, c in got] == [120] * 4 + [100]


@pytest.mark.parametrize("m,o", [(0, 0), (10, -1), (10, 10)])
def test_bad_arguments_raise(spark, m, o):
    df = spark.createDataFrame([(1, "x")], "key long, text string")
    with pytest.raises(ValueError):
        chunk_chars(df, "text", m, o)


def test_null_text_gives_no_rows(spark):
    df = spark.createDataFrame([(1, None)], "key long, text string")
    assert chunk_chars(df, "text", 10, 1).count() == 0
    assert chunk_lines(df, "text", 10, 1).count() == 0


def test_lines_short_starts_at_line_1(spark):
    assert lines_(spark, "a\nb\n", 100, 0) == [(1, "a\nb\n")]


def test_lines_empty_gives_none(spark):
    assert lines_(spark, "", 100, 0) == []


def test_lines_10_by_10_at_50(spark):
    text = "".join(f"{i:09d}\n" for i in range(10))
    got = lines_(spark, text, 50, 0)
    assert [s for s, _ in got] == [1, 6] and "".join(c for _, c in got) == text


def test_lines_20_at_40_rebuild(spark):
    text = "".join(f"line{i:02d}\n" for i in range(20))
    got = lines_(spark, text, 40, 0)
    assert "".join(c for _, c in got) == text


def test_lines_overlap_true_start_lines(spark):
    # overlap 20 -> two lines carried; the reference would report line 1 for every chunk
    text = "".join(f"l{i:03d}\n" for i in range(30))  # 5 chars each
    got = lines_(spark, text, 25, 20)
    check_lines(text, got, 25, 20)
    assert [s for s, _ in got][:3] == [1, 4, 7]


def test_lines_longer_than_limit_stands_alone(spark):
    text = "short\n" + "x" * 50 + "\nend\n"
    assert lines_(spark, text, 20, 0) == [(1, "short\n"), (2, "x" * 50 + "\n"), (3, "end\n")]


def test_lines_kept_lines_that_leave_no_room_end(spark):
    # the reference loops for ever here: carried lines plus the long line never fit
    text = "aaaa\nbbbb\n" + "c" * 30 + "\n"
    got = lines_(spark, text, 12, 200)
    check_lines(text, got, 12, 200)
    assert got[-1] == (3, "c" * 30 + "\n")


def test_lines_random_against_python(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("ab \n") for _ in range(rnd.randint(0, 300))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    for m, o in [(30, 0), (30, 50), (10, 200), (64, 90)]:
        got = {}
        for r in chunk_lines(df, "text", m, o).orderBy("key", "chunk_no").collect():
            got.setdefault(r.key, []).append((r.start_line, r.chunk))
        for k, t in enumerate(texts):
            check_lines(t, got.get(k, []), m, o)
