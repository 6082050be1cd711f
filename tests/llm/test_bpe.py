"""Byte-pair encoding against the tokenizers library and against merging one pair at a time."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keelstone.llm import bpe

from .test_operators import SF, docs, empty, sample  # noqa: F401

FILE = open(bpe.vocabulary_path(), encoding="utf-8").read()


@pytest.fixture(scope="module")
def coder():
    return bpe.WordBPE(FILE)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_str(FILE)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_low_character_and_a_sample_of_the_others(coder, library):
    points = [*range(0x400), *range(0x400, 0x110000, 61)]
    texts = [f"a{chr(c)}b1{chr(c)}.{chr(c)}{chr(c)} {chr(c)}'s" for c in points if not 0xD800 <= c < 0xE000]
    assert coder.encode(texts) == ids_of(library, texts)


def test_mixed_texts(coder, library):
    r = random.Random(3)
    parts = ["a", "aa", "<|endoftext|>", "<|startoftext|>", "<|", "É", "É", "ﬁ", "ΑΣ", "Σ", "'S", "'", "12", "½", " ", "\n", " ", "\x1c", "日本", "🙂", "\x00", "İ", "the", "ing", "#$%"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(5000)] + ["a" * 60_000, "ab" * 40_000, "", "<|endoftext|>" * 3]
    ids = coder.encode(texts)
    assert ids == ids_of(library, texts)
    assert [coder.decode(i) for i in ids] == [library.decode(i, skip_special_tokens=False) for i in ids]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=6), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=8, unique=True))
def test_pair_index_equals_one_merge_at_a_time(words, pairs):
    """Also where a later merge's result stands in an earlier pair."""
    merges = [(a, b, 4 + k % 4) for k, (a, b) in enumerate(pairs)]
    rank = {(a, b): (k, j) for k, (a, b, j) in enumerate(merges)}

    def plain(w):
        while found := [(rank[p][0], i) for i, p in enumerate(zip(w, w[1:])) if p in rank]:
            k, i = min(found)
            w = [*w[:i], merges[k][2], *w[i + 2 :]]
        return w

    assert bpe.PairIndex(merges, 8).encode(words) == [plain(w) for w in words]


def test_forgetting_words_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBER", 50)
    coder, texts = bpe.WordBPE(FILE), [t for _, t, _ in sample() if t][:60]
    for a, b in bpe.blocks(texts, 5000):
        assert coder.encode(texts[a:b]) == ids_of(library, texts[a:b])
    assert [x for a, b in bpe.blocks(texts, 5000) for x in range(a, b)] == list(range(60))


def test_query_over_all_documents(spark, docs, empty, library):  # noqa: F811
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
        assert sorted(map(tuple, bpe.digests(df).collect()), key=key) == sorted(want, key=key)
    assert bpe.digests(empty).count() == 0
    one = bpe.encoded(docs.filter("doc_id = 9")).first()
    assert library.decode(one.ids, skip_special_tokens=False) == one.decoded
