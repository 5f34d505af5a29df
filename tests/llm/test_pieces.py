import os
import random

import numpy as np
import pytest

from maskwell.llm import pieces as P


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model(path):
    return P._model(path)


def brute(model, symbols):
    """Least weight over all segmentations, by plain dynamic programming over all substrings."""
    weight = {p: -s for p, s, k in model.pieces if k in (1, 4)}
    best = [0.0]
    for j in range(1, len(symbols) + 1):
        options = [best[i] + weight[symbols[i:j]] for i in range(max(0, j - 16), j) if symbols[i:j] in weight]
        if symbols[j - 1] not in weight:
            options.append(best[j - 1] + model.unknown)
        best.append(min(options))
    return best[-1]


def weight_of(model, ids):
    total, at = 0.0, 0
    while at < len(ids):
        p, s, k = model.pieces[ids[at]]
        if k == 6:
            lead = int(p[3:5], 16)
            at += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            total += model.unknown
        else:
            total -= s
            at += 1
    return total


def samples():
    rng = random.Random(5)
    parts = ["the", "ing", " ", "  ", "\n", "\t", "é", "ß", "日本", "ｆ", "😀", "x", "Zz", "12", "<s>", "ción", "́", "▁"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)] + ["", " ", "a", "\x00"]


@pytest.fixture(scope="module")
def library(path):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=path)


def changed(path, **settings):
    """(model, library) of the file with other settings: model_type, remove_extra_whitespaces, add_dummy_prefix."""
    spm = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    for k, v in settings.items():
        setattr(proto.trainer_spec if k == "model_type" else proto.normalizer_spec, k, v)
    if settings.get("model_type") == 1:
        for p in proto.pieces:  # the library adds up in single precision, which these scores would drown
            p.score = max(p.score, -40000)
    data = proto.SerializeToString()
    return P.Model(data), spm.SentencePieceProcessor(model_proto=data)


def test_same_ids_as_the_library(model, library):
    for text in samples():
        ids = model.encode(text)
        assert ids == library.encode(text), text
        assert model.decode(ids) == text.replace("▁", " ")
        assert ids == model.path(model.normaliser.apply(text))  # word by word is the same as in one go


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_same_ids_as_the_library_on_documents(model, library):
    import pyarrow.parquet as pq

    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist():
        assert model.encode(text or "") == library.encode(text or "")


def test_normaliser_flags(path):
    for settings in ({"remove_extra_whitespaces": True}, {"add_dummy_prefix": False}, {"remove_extra_whitespaces": True, "add_dummy_prefix": False}):
        model, library = changed(path, **settings)
        for text in samples():
            assert model.encode(text) == library.encode(text), (settings, text)


def test_filter_leaves_one_path(model):
    """All segmentations of short words, composed with the filter as its definition says."""
    m = model.merges
    rng = random.Random(4)
    for _ in range(150):
        word = "▁" * rng.randrange(3) + "".join(rng.choice("thinersaloé12") for _ in range(rng.randrange(1, 8)))
        paths = [[]]
        for i in range(len(word)):
            paths += [p + [word[i:j]] for p in paths if sum(map(len, p)) == i for j in range(i + 1, len(word) + 1) if word[i:j] in m.pieces]
        whole = [p for p in paths if sum(map(len, p)) == len(word)]
        fine = [p for p in whole if all(m.merged(a + b) == [a, b] for a, b in zip(p, p[1:])) and all(m.merged(x) == [x] for x in p)]
        assert fine == [m.merged(word)] and [model.pieces[i][0] for i in model.path(word)] == fine[0]


def test_shortest_path_of_a_unigram_model(path):
    model, library = changed(path, model_type=1)
    for text in samples():
        ids = model.encode(text)
        assert weight_of(model, ids) == pytest.approx(brute(model, model.normaliser.apply(text)), rel=1e-12)
        assert model.decode(ids) == text.replace("▁", " ")
        assert ids == model.path(model.normaliser.apply(text))
    rng = random.Random(6)
    syllables = ["the", "ing", "on", "re", "ät", "ción", "que", "ß", "er", "wh", "12", ".", ","]
    for _ in range(500):
        text = " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 8)))
        assert model.encode(text) == library.encode(text)


def test_operator(spark, path, model):
    rows = [(1, "one  two", "a"), (2, None, None), (3, "", "x"), (4, "word " * 20000, "y"), (1, "one  two", "a"), (5, "日\x01ｆ😀\n", "z"), (6, "a▁b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = P.encode(docs, path, with_ids=True)
    out = {r.doc_id: r for r in got.collect()}
    assert {i for i, r in out.items() if not r.decoded_ok} == {6} and out[2].n_pieces == out[3].n_pieces == 0 and out[5].n_bytes > 0
    assert np.frombuffer(out[1].ids, "<u4").tolist() == model.encode("one  two")
    back = sorted((r.doc_id, r.text) for r in P.decode(got, path).collect())
    assert back == sorted((i, (t or "").replace("▁", " ")) for i, t, _ in rows)
    assert P.encode(docs.limit(0), path).count() == 0
