import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwell.llm import token_files as T


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50256), st.integers(0, 2**64 - 1), st.just(0), st.just(1)), max_size=300), st.sampled_from([1, 7, 64, 1024]))
def test_pack_round_trip(ids, block):
    words, offsets = T.pack(np.array(ids, np.uint64), block)
    assert T.unpack(words, offsets, len(ids), block).tolist() == ids
    assert offsets[-1] == len(words)
    for b in range(len(offsets) - 1):  # each block is decoded alone
        part = ids[b * block : (b + 1) * block]
        assert T.unpack(words[offsets[b] : offsets[b + 1]], np.array([0, offsets[b + 1] - offsets[b]]), len(part), block).tolist() == part


def test_pack_is_dense():
    words, _ = T.pack(np.ones(6000, np.uint64), 6000)
    assert len(words) == 100
    words, _ = T.pack(np.arange(30000, 30400, dtype=np.uint64), 400)
    assert len(words) == 100


def test_words_encode_as_the_whole(tokenizer, monkeypatch):
    rng = random.Random(3)
    parts = [" ", " ", " ", "  ", "\n", "\t", "a", "the", "It's", "12", "é", "ß.", "\xa0", "\x1c", "\u3000", "\u2019", "\u2009", "'s", "!?", "日本", "<|endoftext|>", "\r\n", "😀", "\0", "x" * 200]
    for weird in (len(parts), 3 + 4):
        texts = ["".join(rng.choice(parts[: weird + 12]) + rng.choice(["", " "]) for _ in range(rng.randrange(40))).strip(" " * rng.randrange(2)) for _ in range(600)]
        texts += [" ".join(rng.choice(["a", "the\nx", "It's", "é"]) for _ in range(30)) for _ in range(200)]
        monkeypatch.setattr(T, "REMEMBERED", 60)
        enc = T.Encoder(tokenizer)
        want = [[*e.ids, 2] for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        for a in range(0, len(texts), 50):
            lengths, ids = enc.batch(texts[a : a + 50], 2)
            ends = np.cumsum(lengths)
            assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths)] == want[a : a + 50]


def encoded_otherwise(tokenizer, texts, group):
    """Texts whose ids are not those that the plain library gives."""
    from tokenizers import Tokenizer

    enc, plain, bad = T.Encoder(tokenizer), Tokenizer.from_file(tokenizer), []
    for a in range(0, len(texts), group):
        lengths, ids = enc.batch(texts[a : a + group], 2)
        ends = np.cumsum(lengths)
        bad += [t for t, e, n in zip(texts[a : a + group], ends, lengths) if ids[e - n : e].tolist() != [*plain.encode(t, add_special_tokens=False).ids, 2]]
    return bad


def test_added_tokens_have_their_own_id(tokenizer):
    texts = ["<|endoftext|>", "a b", "a <|endoftext|> b", "a<|endoftext|>b c\nd", "é<|endoftext|><|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|> a"]
    assert encoded_otherwise(tokenizer, texts, 3) == []


def test_forgetting_keeps_the_words_of_the_group(tokenizer, monkeypatch):
    # words of a group that were seen once before stay known while the group's new words are learned
    rng = random.Random(4)
    texts = [" ".join(str(int(rng.paretovariate(0.35)))[:9] for _ in range(rng.randrange(1, 30))) for _ in range(600)]
    for remembered in (8, 300, 1000):
        monkeypatch.setattr(T, "REMEMBERED", remembered)
        assert encoded_otherwise(tokenizer, texts, 50) == [], remembered


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_files(spark, tokenizer):
    from tokenizers import Tokenizer

    rows = [(5, "five five", "x"), (1, None, "y"), (3, "", "z"), (9, "word " * 3000, "x"), (9, "word " * 3000, "x"), (2, "two\n\n two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = T.token_files(docs, tokenizer, shards=3).orderBy("start").collect()
    t = Tokenizer.from_file(tokenizer)
    want, at = [], 0
    for i, text, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, at, len(ids), zlib.crc32(raw), raw))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got] == want


def test_empty(spark, tokenizer):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_files(docs, tokenizer).count() == 0
