import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulara.llm import tokens as T

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def known():
    t = tokenizers.Tokenizer.from_file(f"{T.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    with open(f"{T.TOKENIZER_DIR}/{T.VOCABULARY}", "rb") as f:
        return t, T.Pieces(T.read_ranks(f.read()))


TEXTS = ["", " ", "\n\n  x", "<|endoftext|> hi", "Éé ½ ١٢ 中文 👩‍👩‍👧", "a\x1c\x85b", "don't  stop", "=" * 3000, "ab" * 40_000, "x" * 50_000 + " " * 50_000, "word " * 30_000]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_known_texts(known, text):
    t, pieces = known
    assert T.encode_text(text, pieces) == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(known, text):
    t, pieces = known
    assert T.encode_text(text, pieces) == t.encode(text, add_special_tokens=False).ids


def naive(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_tree_against_naive_merges(known):
    rnd = random.Random(1)
    for _ in range(500):
        piece = bytes(rnd.choice(b"aabeinst \xc3\xa9") for _ in range(rnd.randint(1, 40)))
        assert T.encode_piece(piece, known[1].ranks) == naive(piece, known[1].ranks)


def test_frame(spark, known):
    data = [(i, t, "clash", 0) for i, t in enumerate([*TEXTS, None, "same", "same"])] + [(3, "again", "", 0)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string, x int")
    ids = sorted((r.doc_id, list(r.ids)) for r in T.token_ids(df).collect())
    assert ids == sorted((i, known[0].encode(t or "", add_special_tokens=False).ids) for i, t, *_ in data)
    counts = sorted((r.doc_id, r.n_tokens) for r in T.token_counts(df).collect())
    assert counts == sorted((i, len(x)) for i, x in ids)
    empty = spark.createDataFrame([], df.schema)
    assert T.token_ids(empty).collect() == [] and T.token_ids(empty).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_cache_forgets(known, monkeypatch):
    monkeypatch.setattr(T, "CACHE_PIECES", 3)
    pieces = T.Pieces(known[1].ranks)
    text = "one two three four five six one two"
    assert T.encode_text(text, pieces) == known[0].encode(text, add_special_tokens=False).ids and len(pieces) <= 3
