import pytest

from textmill.llm.token_counts import Model, default_model, token_counts

spm = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=default_model())


def check(df, library, texts, **how):
    got = token_counts(df, **how).collect()
    assert sorted((r[0] or -1, r["n_tokens"], r["n_bytes"]) for r in got) == sorted(
        (i or -1, len(library.encode(t or "")), len((t or "").encode())) for i, t in texts
    )
    return got


def test_counts_equal_the_library(odd_docs, odd_rows, library):
    got = check(odd_docs, library, odd_rows)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert got[0].__fields__ == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


@pytest.mark.parametrize("step,overlap", [(1000, 8), (700, 200)])
def test_huge_texts_without_word_breaks_are_spliced(spark, library, step, overlap):
    texts = [(1, "a" * 9000), (2, "ab ba" * 2000), (3, " " * 8000), (4, "日本語🎉" * 1500), (5, "the cat sat. " * 900)]
    check(spark.createDataFrame(texts, "doc_id long, text string"), library, texts, step=step, overlap=overlap)


def test_whole_corpus(sf_docs, library):
    texts = [tuple(r) for r in sf_docs.select("doc_id", "text").collect()]
    check(sf_docs, library, texts, step=3000, overlap=64)


def test_empty_table(no_docs):
    assert token_counts(no_docs).collect() == []


def test_segments_and_marks(library):
    m = Model(default_model())
    for t in ["▁", " ▁ a", "a ", "  a", "\x00", "<s> x </s>", "a b"]:
        assert m.count(t) == len(library.encode(t)), t
