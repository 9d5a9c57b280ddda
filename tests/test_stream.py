"""Request stream: state carries across micro-batches; late requests after exit go to dead letters."""

import pandas as pd

from textmill.streaming.requests import read_sink, request_stream


def test_stream_two_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    pd.DataFrame({"session": [1, 1, 2], "turn": [0, 1, 0], "text": ["a", "exit", "b"]}).to_parquet(src / "p1.parquet")
    schema = "session long, turn long, text string"
    out = request_stream(spark, str(src), schema, lambda df: df, out_dir=str(tmp_path / "out"),
                         checkpoint=str(tmp_path / "ckpt"))
    # a second file arrives later: session 1 is closed, session 2 goes on
    pd.DataFrame({"session": [1, 2, 2], "turn": [2, 1, 2], "text": ["late", "  ", "c"]}).to_parquet(src / "p2.parquet")
    request_stream(spark, str(src), schema, lambda df: df, out_dir=out, checkpoint=str(tmp_path / "ckpt"))
    good = sorted((r.session, r.turn, r.text) for r in read_sink(spark, out, "good").collect())
    dead = sorted((r.session, r.turn, r.status) for r in read_sink(spark, out, "dead").collect())
    assert good == [(1, 0, "a"), (2, 0, "b"), (2, 2, "c")]
    assert dead == [(1, 1, "after exit"), (1, 2, "after exit"), (2, 1, "blank")]


def test_any_split_and_order_of_files(spark, tmp_path):
    import random

    from textmill.operators.requests import session_requests

    rng = random.Random(6)
    rows = [(s, t, rng.choice(["do", "  ", "go on", "Exit", " quit "]) if t > 2 else f"ask {t}") for s in range(12) for t in range(9)]
    rows.append((None, 1, "no session"))
    schema = "session long, turn long, text string"
    want = sorted(((r.session, r.turn, r.text) for r in session_requests(spark.createDataFrame(rows, schema)).collect()), key=repr)
    for trial, (n_files, per_batch) in enumerate([(1, 1), (5, 1), (7, 3)]):
        rng.shuffle(rows)
        src = tmp_path / f"in{trial}"
        src.mkdir()
        for i in range(n_files):
            part = pd.DataFrame(rows[i::n_files], columns=["session", "turn", "text"]).astype({"session": "Int64"})
            part.to_parquet(src / f"p{i}.parquet")
        out = request_stream(spark, str(src), schema, lambda df: df, out_dir=str(tmp_path / f"out{trial}"),
                             checkpoint=str(tmp_path / f"ckpt{trial}"), max_files_per_trigger=per_batch)
        got = sorted(((r.session, r.turn, r.text) for r in read_sink(spark, out, "good").collect()), key=repr)
        assert got == want
        assert read_sink(spark, out, "good").count() + read_sink(spark, out, "dead").count() == len(rows)


def test_a_table_may_be_a_file_or_a_folder(spark, tmp_path):
    from textmill.plans.queries import QUERIES

    rows = pd.DataFrame({"conv_id": [1, 1, 2], "turn": [1, 2, 0], "text": ["a", "exit", " "]}).astype({"text": "string"})
    for kind in ("file", "folder", "none"):
        at = tmp_path / kind
        at.mkdir()
        path = at / "conversations.parquet"
        if kind == "file":
            rows.to_parquet(path)
        else:
            path.mkdir()
            for i in range(2):
                rows[i::2][:0 if kind == "none" else None].to_parquet(path / f"{i}.parquet")
        good = sorted((r.session, r.turn) for r in QUERIES["request_stream"](spark, str(at)).collect())
        dead = sorted((r.session, r.turn, r.status) for r in QUERIES["request_stream_dead"](spark, str(at)).collect())
        assert good == ([] if kind == "none" else [(1, 1)]), kind
        assert dead == ([] if kind == "none" else [(1, 2, "after exit"), (2, 0, "blank")]), kind


def test_nothing_arrives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = request_stream(spark, str(tmp_path / "in"), "session long, turn long, text string", lambda df: df, out_dir=str(tmp_path / "out"))
    assert read_sink(spark, out, "good").collect() == [] and read_sink(spark, out, "dead").collect() == []
