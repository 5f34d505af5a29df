import math
import random
import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from maskwell.llm import langid, toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    vowels = {"aa": "the of and", "bb": "der die und", "cc": "que los por"}
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(vowels))
        words = [rng.choice(vowels[lang].split()) if rng.random() < 0.4 else "".join(rng.choice({"aa": "thwing", "bb": "schüßk", "cc": "ñazocl"}[lang]) for _ in range(5)) for _ in range(rng.randrange(10, 120))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbel" + x for x in ("a", "o", "ur", "ix")] + ["vlak"]))
        rows.append((i, " ".join(words), lang, "s"))
        labels.append((i, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus(700)
    docs, marks = frames(spark, rows, labels)
    model = toxicity.train(docs, marks, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    truth = dict(labels)
    held = [i for i in got if i % 3 == 0]
    assert np.mean([(got[i] >= 0.5) == (truth[i] == 1) for i in held]) > 0.95
    kept = {r.doc_id for r in toxicity.accepted(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}


def test_toxicity_edges(spark):
    rows, labels = corpus(200)
    docs, marks = frames(spark, rows, labels + [(None, 1), (5, None)])
    model = toxicity.train(docs, marks, F.lit(True))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "the of"), (3, "vlak " * 50000), (3, "vlak " * 50000)], "doc_id long, text string")
    got = toxicity.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got if r.doc_id == 1] == [r.score for r in got if r.doc_id == 2]
    assert toxicity.train(docs, marks.limit(0), F.lit(True)) is None
    assert all(r.score < 0.5 for r in toxicity.score(odd, None).collect())
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_score_is_that_of_a_plain_convolution():
    rng = np.random.default_rng(1)
    n = 30
    E = rng.standard_normal((n + 1, toxicity.EMBEDDING)).astype(np.float32)
    E[0] = 0
    C = [rng.standard_normal((w, toxicity.EMBEDDING, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    bias = [rng.standard_normal(toxicity.FILTERS).astype(np.float32) for _ in C]
    weight = rng.standard_normal(len(C) * toxicity.FILTERS).astype(np.float32)
    model = toxicity.Model(np.arange(1, n + 1, dtype=np.uint32), [np.stack([E @ x for x in c]) for c in C], bias, weight, 0.25)
    pad = max(toxicity.WIDTHS) - 1
    for length in (0, 1, 2, 40):
        ids = rng.integers(0, n + 1, length)
        words = [0] * pad + ids.tolist() + [0] * pad
        pooled = []
        for c, b in zip(C, bias):
            for f in range(toxicity.FILTERS):
                best = max(sum(float(E[words[i + j]] @ c[j, :, f]) for j in range(len(c))) for i in range(len(words) - len(c) + 1))
                pooled.append(max(0.0, best + float(b[f])))
        z = sum(p * float(w) for p, w in zip(pooled, weight)) + 0.25
        assert abs(model.score(ids.astype(np.int32)) - 1 / (1 + np.exp(-z))) < 1e-4


def test_labels_that_repeat_or_contradict(spark):
    rows, labels = corpus(200)
    docs, marks = frames(spark, rows, labels)
    want = toxicity.train(docs, marks, F.col("doc_id") != 7)
    again, _ = frames(spark, rows + rows[:50], labels)
    _, more = frames(spark, rows, labels + labels[:80] + [(7, 0), (7, 1)])
    got = toxicity.train(again, more, F.lit(True))
    assert got.known.tolist() == want.known.tolist() and np.allclose(got.weight, want.weight) and np.allclose(got.shift, want.shift)


def test_one_id_on_many_rows(spark):
    """The samples that come to the driver are bounded by texts and ids, not by rows."""
    rows, labels = corpus(150)
    many = spark.createDataFrame(rows + [(1000, f"{rows[0][1]} {i}", "aa", "s") for i in range(5000)], "doc_id long, text string, lang string, score string")
    model = toxicity.train(many, spark.createDataFrame(labels + [(1000, 1)], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(many, model).count() == 5150
    model = langid.train(many, F.lit(True), max_train=100)
    assert len(model.langs) == 3 and len(model.centroids) <= 12


def test_scores_in_blocks_are_those_of_the_whole():
    rng = np.random.default_rng(0)
    model = toxicity.fit([rng.integers(1, 60, (50, 1)).astype(np.uint32).repeat(4, axis=1) for _ in range(40)], np.arange(40) % 2, epochs=1)
    ids = rng.integers(0, len(model.known), 5000).astype(np.int32)
    whole = model.pooled(ids)
    model.BLOCK = 64
    assert np.allclose(model.pooled(ids), whole)


def test_language_on_held_out_rows(spark):
    rows, _ = corpus(400, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(docs, F.col("doc_id") % 4 != 2)
    got = langid.identify(docs, model).collect()
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.doc_id % 4 == 2]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, "the of thing"), (4, "the " * 100000), (5, "日本語")], "doc_id long, text string")
    out = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[4].lang_pred == "aa" and out[None].lang_pred == "aa"
    assert out[5].rejected and out[5].lang_pred in ("aa", "bb", "cc")
    nothing = langid.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_language_is_that_of_plain_loops(spark):
    """TF-IDF, spherical centroids of one text each, cosine and the first language of a tie, by loops."""
    rows = [(0, "Thé thing, of 12 the wing", "bb"), (1, "der schuß und der kübel", "cc"), (2, "que los por azul", "dd"), (3, "que los por azul", "aa"), (4, "the  fling", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True), k=1)

    def grams(text):
        kept = "".join(" " if c.isspace() else c for c in text.lower() if c.isspace() or not (unicodedata.category(c)[0] in "NPSC"))
        kept = re.sub(" +", " ", " " + kept)
        cp = [ord(c) for c in kept]
        out, low = {}, 0xFFFFFFFF
        for i in range(2, len(cp)):
            one, two = cp[i], (cp[i - 1] << 16 ^ cp[i]) & low
            three = (cp[i - 2] * 0x9E3779B1 & low) ^ (cp[i - 1] * 0x85EBCA77 & low) ^ (cp[i] * 0xC2B2AE3D & low)
            for salt, g in enumerate((one, two, three)):
                h = (g + salt * 0x27D4EB2F & low) * 0x9E3779B1 & low
                h = (h ^ h >> 15) * 0x85EBCA77 & low
                b = h >> 32 - langid.DIMS.bit_length() + 1
                out[b] = out.get(b, 0) + 1
        return out

    known = [(grams(t), lang) for _, t, lang in rows if lang]
    idf = lambda b: math.log((1 + len(known)) / (1 + sum(b in g for g, _ in known))) + 1

    def vector(g):
        v = {b: (1 + math.log(n)) * idf(b) for b, n in g.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {b: x / norm for b, x in v.items()}

    queries = [t for _, t, _ in rows] + ["Azul que", "kübel of things", "ein los"]
    got = langid.identify(spark.createDataFrame(list(enumerate(queries)), "doc_id long, text string"), model).collect()
    for r, t in zip(sorted(got, key=lambda r: r.doc_id), queries):
        q = vector(grams(t))
        cosines = sorted((-round(sum(x * vector(g).get(b, 0) for b, x in q.items()), 5), lang) for g, lang in known)
        assert abs(r.score + cosines[0][0]) < 2e-3
        if cosines[1][0] - cosines[0][0] > 0.01 or cosines[0][0] == cosines[1][0]:
            assert r.lang_pred == cosines[0][1]
    assert {r.lang_pred for r in got if r.doc_id in (2, 3)} == {"aa"}


def test_vector_in_blocks_is_that_of_the_whole(monkeypatch):
    text = "Ab  c\n\nDe é 12 fg. " * 300
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "BLOCK", 37)
    parts = langid.counts(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
