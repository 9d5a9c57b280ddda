"""The mechanisms that keep groups bounded and broadcasts proven small."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmill.operators import corpus
from textmill.operators.chunking import chunk_chars
from textmill.plans.tables import spread
from textmill.session import bounded_broadcast


def test_large_project_is_split_into_packs_in_path_order(spark):
    files = spark.createDataFrame([("big", f"f{i:03d}.py", "x" * 100, "python") for i in range(60)]
                                  + [("small", "a.py", "y", "python"), ("small", "b.py", None, "python")],
                                  "project string, path string, content string, language string")
    blocks = {(b.project, b.pack): b for b in corpus.files_block(files, pack_bytes=1000).collect()}
    assert {k[1] for k in blocks if k[0] == "big"} == set(range(6))
    assert all(blocks["big", p].n_files == 10 for p in range(6))
    assert "f012.py" in blocks["big", 1].block and "f009.py" in blocks["big", 0].block
    assert blocks["small", 0].n_files == 2 and "b.py" in blocks["small", 0].block  # no content, still listed
    snap = corpus.build_snapshot(files, "python", "go", pack_bytes=1000)
    assert snap.select(F.sum(F.size("files"))).first()[0] == 62


def test_no_caps_unless_asked_for(spark):
    files = spark.createDataFrame([("p", f"src/f{i:03d}.py", 10**9, "x") for i in range(100)] + [("p", "dist/a.py", 1, "x")],
                                  "project string, path string, length long, content string")
    assert corpus.collect_corpus(files).count() == 100
    status = corpus.corpus_status(files, max_files=3).groupBy("status").count().collect()
    assert {r[0]: r[1] for r in status} == {"kept": 3, "over the cap": 97, "excluded": 1}


def test_a_model_stage_has_as_many_tasks_as_its_input(spark):
    from textmill.operators.infer import batch_infer
    from textmill.plans.stubs import replace_stub

    df = spark.range(0, 640, numPartitions=64).selectExpr("'s' system_prompt", "cast(id as string) user_prompt")
    assert batch_infer(df, replace_stub(), dedupe=False).rdd.getNumPartitions() == 64


def test_a_missing_shared_folder_is_an_error_on_a_cluster():
    from textmill.session import checkpoint_root

    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    try:
        checkpoint_root(Session())
        raise AssertionError("no error")
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)


def test_bounded_broadcast_falls_back_beyond_the_bound(spark):
    small = spark.range(10)
    big = spark.range(1000)
    assert "ResolvedHint" in bounded_broadcast(small, 100)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in bounded_broadcast(big, 100)._jdf.queryExecution().analyzed().toString()
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert "ResolvedHint" not in bounded_broadcast(wide, 100, max_bytes=5000)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in bounded_broadcast(wide, 100)._jdf.queryExecution().analyzed().toString()


def test_spread_only_when_needed(spark):
    one = spark.range(0, 1000, numPartitions=1)
    many = spark.range(0, 1000, numPartitions=64)
    assert spread(one, 8).rdd.getNumPartitions() == 8
    assert spread(many, 8) is many
    assert sorted(r.id for r in spread(one, 8).collect()) == list(range(1000))


@settings(max_examples=25, deadline=None)
@given(text=st.text(alphabet="ab\n é", max_size=300), m=st.integers(1, 40), o=st.integers(0, 39))
def test_chunk_chars_rebuilds_the_text(spark, text, m, o):
    if o >= m:
        return
    rows = chunk_chars(spark.createDataFrame([(1, text)], "k long, text string"), "text", m, o) \
        .orderBy("chunk_no").collect()
    chunks = [r.chunk for r in rows]
    rebuilt = chunks[0] + "".join(c[o:] for c in chunks[1:])
    assert rebuilt == text
    assert all(len(c) <= m for c in chunks)
    assert [r.start for r in rows] == [i * (m - o) for i in range(len(rows))]
