import math
import zlib

import zstandard
from pyspark.sql import functions as F

from textmill.llm.language_id import UNKNOWN, identify, learn


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(docs, learn(docs)).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]]
    assert (held["lang_best"] == held["truth"]).mean() > 0.93
    assert out["score"].between(0, 1).all()
    assert (out["lang"].dropna() == out["lang_best"][out["lang"].notna()]).all()


def test_labels_and_scores_equal_plain_compression(spark):
    """Each text against each dictionary, with the library alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learnt = learn(docs)
    params = zstandard.ZstdCompressionParameters.from_level(9, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(text, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
        data = text.lower().encode()
        return sum(len(c.compress(data[i : i + 2048])) for i in range(0, len(data), 2048))

    got = {r["doc_id"]: r for r in identify(docs, learnt).collect()}
    seen = 0
    for i, text in [tuple(r) for r in docs.select("doc_id", "text").collect()][:60]:
        if not text or not any(ch.isalpha() for ch in text):
            assert got[i]["lang_best"] == UNKNOWN
            continue
        sizes = {lang: size(text, content) for lang, content in learnt.items()}
        least = min(sizes.values())
        rest = sorted(sizes.values())[1]
        assert got[i]["lang_best"] == next(lang for lang in learnt if sizes[lang] == least)
        assert abs(got[i]["score"] - 1 / sum(math.exp(-60 * (v - least) / least) for v in sizes.values())) < 1e-9
        assert abs(got[i]["margin"] - (rest - least) / rest) < 1e-9
        assert (got[i]["lang"] is None) == ((rest - least) / rest < 0.005)
        seen += 1
    assert seen > 40


def test_columns_with_any_names(spark):
    rows = [(i, f"word{i} some text", "aa" if i % 2 else "bb", 1, "x", 2, 3) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, s_id int, s_lang string, key int, id int")
    plain = learn(docs.select("doc_id", "text", "lang"))
    assert learn(docs) == plain and set(plain) == {"aa", "bb"}


def test_odd_texts(odd_docs, spark):
    got = {(r["doc_id"], r["lang_best"]) for r in identify(odd_docs, {"en": b"one two three four", "xx": b"qqq zzz"}).collect()}
    assert {(2, UNKNOWN), (3, UNKNOWN), (4, UNKNOWN)} <= got
    assert (1, "en") in got and (6, "en") in got
    digits = spark.createDataFrame([(1, "12 34 _"), (2, "a")], "doc_id long, text string")
    assert [r["lang_best"] for r in identify(digits, {"en": b"a b"}).orderBy("doc_id").collect()] == [UNKNOWN, "en"]


def test_nothing_learned_and_empty_table(no_docs, odd_docs):
    assert learn(no_docs) == {}
    assert {r["lang_best"] for r in identify(odd_docs, {}).collect()} == {UNKNOWN}
    assert identify(no_docs, {"en": b"x"}).collect() == []


def test_held_out_rows_and_null_labels_do_not_teach(spark):
    out = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 0)
    kept = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 != 0)
    rows = [(out, "held out words", "aa"), (kept, "taught words", "bb"), (kept, "unlabelled", None), (None, "no id", "cc")]
    assert set(learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == {"bb"}
