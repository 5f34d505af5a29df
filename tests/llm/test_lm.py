import math
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwell.llm import lm as M
from maskwell.llm.common import words_of


def corpus(n=260):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        words = ["alpha beta gamma delta", "eins zwei drei vier", "uno dos tres cuatro"][i % 3].split()
        rows.append((i, " ".join(rng.choice(words) if rng.random() < 0.8 else f"r{rng.randrange(500)}" for _ in range(rng.randrange(1, 80))), "x"))
    return rows + [(900, None, "x"), (901, "", "x"), (902, "Alpha\tBETA\n", "x"), (902, "Alpha\tBETA\n", "x"), (903, "alpha " * 9000, "x")]


def test_base_counts_and_gain(spark, monkeypatch):
    monkeypatch.setattr(M, "HEAD", 100)  # most words are rare
    monkeypatch.setattr(M, "LEAST", 1)
    monkeypatch.setattr(M, "TRAIN_SLOTS", 4)  # more steps from few texts
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    usable = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 2
    got = M.score(docs, usable).collect()
    assert len(got) == len(rows)
    train = [t for i, t, _ in rows if i % 5 != 2]
    c = Counter(w for t in train for w in words_of(t or ""))
    n, v = sum(c.values()) + len(train), len(c) + 1
    by_id = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        w, r = words_of(t or ""), by_id[i]
        base = sum(math.log10((x + 1) / (n + v + 1)) for x in [*(c[x] for x in w), len(train)])
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
    held = [r for r in got if r.doc_id % 5 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small_model():
    v = M.Vocabulary([b"w%d" % i for i in range(60)], np.arange(120, 60, -1), np.arange(60) % 2, np.random.default_rng(8).integers(0, 60, (60, 3)).astype(np.float32), 9000, 200, 50)
    p = M.initial(v, 4)
    rng = np.random.default_rng(1)
    for k in p:
        p[k] = p[k] + rng.standard_normal(p[k].shape).astype(np.float32) * 0.3
    return v, p


def test_probabilities_add_up():
    v, p = small_model()
    h = np.random.default_rng(2).standard_normal((1, M.HIDDEN)).astype(np.float32)
    targets = np.arange(len(v.words) + 2)
    lp = M.log_prob(p, v, np.repeat(h, len(targets), axis=0), targets)
    assert np.exp(lp).sum() == pytest.approx(1, abs=1e-5)


def test_state_is_carried_across_windows():
    v, p = small_model()
    rng = np.random.default_rng(3)
    texts = [np.append(rng.integers(0, 61, n), v.end).astype(np.int32) for n in (0, 5, 31, 32, 200, 90, 1)]

    def alone(ids):
        h, total = np.zeros((1, M.HIDDEN), np.float32), 0.0
        for k, y in enumerate(ids):
            row = v.start if k == 0 else v.row[ids[k - 1]]
            s, _ = M.forward(p, v, h, np.array([[row]]), np.ones((1, 1), np.float32))
            h = s[-1]
            total += M.log_prob(p, v, h, np.array([y]))[0]
        return total

    slots, h, sums = M.Slots(v, 3), np.zeros((3, M.HIDDEN), np.float32), np.zeros(len(texts))
    for i, x in enumerate(texts):
        slots.add(i, x)
    while slots.waiting.any():
        used, rows, keep, target, owner = slots.window()
        states, _ = M.forward(p, v, h[used], rows, keep)
        h[used], on = states[-1], owner.ravel() >= 0
        np.add.at(sums, owner.ravel()[on], M.log_prob(p, v, states.reshape(-1, M.HIDDEN)[on], target.ravel()[on]))
    assert sums == pytest.approx([alone(x) for x in texts], rel=1e-4)


def test_gradients_by_finite_differences():
    v, p = small_model()
    p = {k: x.astype(np.float64) for k, x in p.items()}
    rng = np.random.default_rng(5)
    rows, target = rng.integers(0, v.rows, (6, 3)), rng.integers(0, 62, (6, 3))
    keep, live, h = (rng.random((6, 3)) > 0.2).astype(float), rng.random((6, 3)) > 0.1, rng.standard_normal((3, M.HIDDEN))
    g, _, _ = M.gradients(p, v, h, rows, keep, target, live, 18)
    for k in ("U", "T", "t", "C", "c", "A", "a"):
        at = tuple(rng.integers(0, n) for n in p[k].shape)
        old, e = p[k][at], 1e-3
        p[k][at] = old + e
        up = M.gradients(p, v, h, rows, keep, target, live, 18)[2]
        p[k][at] = old - e
        down = M.gradients(p, v, h, rows, keep, target, live, 18)[2]
        p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * e), rel=0.03, abs=2e-4)


def test_every_training_text_reaches_a_gradient(monkeypatch):
    """The tokens of the windows that a task learns from are those of all its texts."""
    texts = [t or "" for _, t, _ in corpus(120)]
    words = sorted({w for t in texts for w in words_of(t)})
    v = M.Vocabulary(words, np.ones(len(words), np.int64), np.zeros(len(words), np.int32), np.ones((len(words), 2), np.float32), 9000, 200, 50)
    seen, plain = Counter(), M.gradients

    def noted(p, v, h, rows, keep, target, live, full):
        seen.update(target[live].tolist())
        return plain(p, v, h, rows, keep, target, live, full)

    monkeypatch.setattr(M, "gradients", noted)
    p = M.initial(v)
    n, got = M.learn_from(iter(texts), v, p, 8, 0.01)
    assert seen == Counter(x for t in texts for x in M.numbers(v, M.Ids(v), t)[0].tolist()) and n == sum(seen.values())
    assert not np.allclose(got["U"], p["U"]) and not np.allclose(got["C"], p["C"])


def test_state_changes_the_word_within_its_class():
    v, p = small_model()
    h = np.random.default_rng(2).standard_normal((2, M.HIDDEN)).astype(np.float32)
    same = np.flatnonzero(v.cls == v.cls[3])
    x, y = (M.log_prob(p, v, np.repeat(s[None], len(same), axis=0), same) for s in h)
    assert len(same) > 5 and np.ptp(x - y) > 0.01


def test_one_id_on_many_rows(spark):
    docs = spark.createDataFrame([(7, f"alpha r{i} beta") for i in range(5000)], "doc_id long, text string")
    got = M.score(docs, F.lit(True))
    assert got.agg(F.count("*"), F.min("n_known"), F.max("n_known")).first()[:] == (5000, 4, 4)


def test_without_training_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = M.score(docs, F.lit(False)).collect()
    assert len(got) == 2 and all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert M.score(docs.limit(0), F.lit(True)).count() == 0


def test_weights_are_learned_from_all_training_texts(spark, monkeypatch):
    n, seen = 12_000, []
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    monkeypatch.setattr(M, "learn", lambda part, v, p, *more: seen.extend(r.doc_id for r in part.select("doc_id").collect()) or p)
    assert M.score(docs, F.col("doc_id") % 10 != 0).count() == n
    assert sorted(seen) == [i for i in range(n) if i % 10]


def test_groups_come_from_all_training_texts(spark, monkeypatch):
    # 4000 different texts and one long one of other words: its words are the commonest, and each text moves a centre
    rows = [(i, f"alpha beta t{i}") for i in range(4000)] + [(9000, "zeta eta " * 6000), (9001, ""), (9002, None)]
    seen, encoded, counted = [], M.encoded, M.group_counts
    monkeypatch.setattr(M, "encoded", lambda rows, words: seen.append(words) or encoded(rows, words))
    monkeypatch.setattr(M, "group_counts", lambda *args: seen.append(counted(*args)) or seen[-1])
    assert M.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).count() == len(rows)
    words, counts = seen
    assert words[:2] == [b"eta", b"zeta"]
    by_word = dict(zip(words, counts.sum(axis=1).tolist()))
    assert by_word[b"eta"] == 6000 and by_word[b"alpha"] == 4000 and by_word[b"t17"] == 1
    apart = dict(zip(words, counts.argmax(axis=1).tolist()))
    assert apart[b"eta"] == apart[b"zeta"] != apart[b"alpha"]


def test_packed_numbers_come_back():
    x = np.array([0, 1, 255, 256, 65535, 65536, M.HEAD, M.HEAD + 1], np.int32)
    assert M.unpacked(M.packed(x)).tolist() == x.tolist() and M.unpacked(M.packed(x)).dtype == np.int32
    assert len(M.packed(x[:0])) == 0 == len(M.unpacked(b""))


def test_words_by_arrow_are_those_of_words_of():
    odd = ["", " ", "  A\x1cB\x85c\xa0d \t\x0b\x0ce ", "ÀÉ Ab\r\nC", "z z q z", "x"]
    for rows in (pa.array(odd), pa.array(["left out", *odd, "left out"]).slice(1, len(odd)), pa.array(odd, pa.large_string()), pa.array(odd[:1]), pa.array(odd[:0], pa.string())):
        sizes, words = M.words_in(rows)
        assert sizes.tolist() == [len(words_of(t)) for t in rows.to_pylist()]
        assert [w.encode() for w in words.to_pylist()] == [w for t in rows.to_pylist() for w in words_of(t)]


def test_encoded_texts_are_those_of_numbers(spark, monkeypatch):
    monkeypatch.setattr(M, "JOIN", 1)  # a batch of its own for each that comes
    rows, words = corpus(), [b"alpha", b"eins", b"uno", b"r7"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string").select(F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    ids = dict(zip(words, range(len(words))))
    got = M.encoded(docs, words).collect()
    expected = [(i, *M.numbers(len(words), ids, t or "")) for i, t, _ in rows]
    assert sorted((r.doc_id, bytes(r.ids), sorted(zip(map(bytes, r.rare), r.times))) for r in got) == sorted((i, M.packed(x), sorted(Counter(rare).items())) for i, x, rare in expected)


def test_learning_takes_few_new_pages_for_a_window():
    code = """
import resource, numpy as np
from maskwell.llm import lm as M
rng = np.random.default_rng(4)
v = M.Vocabulary([b"w%d" % i for i in range(60)], np.arange(120, 60, -1), np.arange(60) % 2, rng.integers(0, 60, (60, 3)).astype(np.float32), 9000, 200, 50)
texts = [M.packed(np.append(rng.integers(0, 61, 319), v.end).astype(np.int32)) for _ in range(M.WIDE)]
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
def learn():
    M.keep_memory()
    M.learn_numbers(map(M.unpacked, texts), v, M.initial(v), M.WIDE, 0.01)
learn()
before = faults()
learn()
print((faults() - before) / 10)
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120, cwd=Path(__file__).parents[2])
    assert float(run.stdout) < 600  # over 4,000 where each array takes its pages anew
