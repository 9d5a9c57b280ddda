import base64
import hashlib
import random

import numpy as np
import pytest

from textmill.llm.byte_bpe import Codec, Merges, RankQueue, bpe_digests, default_ranks, encode_texts, merge_all

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def library():
    path, pattern = default_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec(*default_ranks())


def test_queue_gives_ranks_in_order():
    rng = random.Random(1)
    q, want = RankQueue(), {}
    for p in range(500):
        r = rng.choice([0, 1, 63, 64, 4095, 4096, rng.randrange(1 << 18)])
        q.push(r, [p])
        want.setdefault(r, []).append(p)
    got = []
    while (x := q.pop()) is not None:
        got.append(x)
    assert got == sorted(want.items())


def test_random_texts_equal_the_library(codec, library):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "日", "🎉", "\x1c", "\x85", " ", "'s", "1", "²", "!", "th", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += ["a" * 3000, "aab" * 700, " " * 500, "日本" * 900, "<|endoftext|>"]
    for t, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t), t
        assert codec.decode(ids) == t.encode()


def test_any_ranks_merge_like_the_plain_loop():
    """Vocabularies in which a merge can make a pair of a lower rank."""
    rng = random.Random(5)
    for _ in range(60):
        tokens = [bytes([c]) for c in range(256)]
        longer = {bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 5))) for _ in range(12)}
        order = sorted(longer, key=lambda t: rng.random())
        ranks = {t: i for i, t in enumerate(tokens + order)}
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(40)]
        ids, ends = merge_all(pieces, np.arange(256), Merges(ranks))
        start = 0
        for piece, end in zip(pieces, ends):
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while True:
                can = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not can:
                    break
                i = min(can)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert ids[start:end].tolist() == [ranks[p] for p in parts]
            start = end


def test_digests(odd_docs, odd_rows, library):
    got = sorted(map(tuple, bpe_digests(odd_docs).collect()), key=repr)
    want = []
    for i, t in odd_rows:
        ids = library.encode_ordinary(t or "")
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i, len(ids), sha, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_ids_and_round_trip(odd_docs, odd_rows, library, no_docs):
    got = encode_texts(odd_docs).collect()
    assert all(r["lossless"] for r in got)
    assert sorted(r["ids"] for r in got) == sorted(library.encode_ordinary(t or "") for _, t in odd_rows)
    assert bpe_digests(no_docs).count() == 0 and encode_texts(no_docs).count() == 0


def test_work_on_long_pre_tokens_grows_with_their_length(codec, library, monkeypatch):
    """Entries that leave the queue, not seconds: a few for each byte, at any length."""
    rng = random.Random(8)
    popped = [0]
    pop = RankQueue.pop

    def counted(self):
        got = pop(self)
        popped[0] += len(got[1]) if got else 0
        return got

    monkeypatch.setattr(RankQueue, "pop", counted)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for make in (lambda n: "thein" * (n // 5), lambda n: "".join(rng.choice(letters) for _ in range(n)), lambda n: "a" * n,
                 lambda n: "".join(rng.choice(["the", "in", "er", "ing", "x"]) for _ in range(n // 3))):
        for n in (2_000, 30_000):
            piece = make(n).encode()
            popped[0] = 0
            ids, _ = merge_all([piece], codec.byte_ids, codec.merges)
            assert popped[0] <= 3 * n
            assert ids.tolist() == library._core_bpe.encode_single_piece(piece)
    # long pre-tokens beside short ones in one queue
    pieces = [("thein" * 300 + w).encode() for w in ("", "x", "the")] + [b"their", b"in", b""] * 5
    ids, ends = merge_all(pieces, codec.byte_ids, codec.merges)
    for piece, a, b in zip(pieces, [0, *ends], ends):
        assert ids[a:b].tolist() == (library._core_bpe.encode_single_piece(piece) if piece else [])
