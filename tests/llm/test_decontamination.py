import random

import numpy as np

from maskwell.llm import decontamination as D
from maskwell.llm.common import plain_words


def sets(text):
    w = plain_words(text or "")
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(docs, items, threshold=0.8):
    found = {}
    for d, t, *_ in docs:
        for i, x in items:
            w, own = plain_words(x or ""), plain_words(t or "")
            s, there = sets(x), sets(t)
            if 1 < len(w) < 5:
                there = {tuple(own[k : k + len(w)]) for k in range(len(own) - len(w) + 1)}
            if s and len(s & there) / len(s) >= threshold:
                found[d, i] = max(found.get((d, i), (0, 0, 0)), (len(s & there) / len(s), len(s & there), len(s)))
    return {k: (n, c) for k, (_, c, n) in found.items()}


def fixture():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ré", "tun"]) for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([5, 6, 9, 12, 13, 20, 36, 68, 70, 140])] + [(10, "two words"), (11, ""), (12, None), (13, "Ka lo mi's"), (14, "lone")]
    items += [(3, text(30)), (3, items[3][1]), (15, text(30))]
    docs = [(i, text(rng.randrange(1, 400)), "x") for i in range(40)]
    for k in range(60):
        item = items[k % 10][1].split()
        if k % 3 == 1:
            item[len(item) // 2] = "edit"
        if k % 3 == 2:
            item = item[: len(item) * 2 // 3]
        body = text(rng.randrange(0, 3000)).split()
        at = rng.randrange(len(body) + 1)
        docs.append((100 + k, " ".join(body[:at] + [w.upper() + rng.choice([".", ",", ""]) for w in item] + body[at:]), "y"))
    docs += [(904, text(30) + " ka, lo mi s " + text(9), "n"), (905, "so two words here", "n"), (906, "a lone one", "n"), (907, "LONE", "n"), (908, items[-3][1] + text(80), "n"), (908, items[-1][1], "n")]
    docs += [(900, None, "n"), (901, "", "n"), (902, "two words", "n"), (903, items[5][1] + " " + items[6][1], "n"), (903, items[5][1], "n"), (None, items[4][1], "n")]
    return docs, items


def test_same_as_brute_force(spark):
    docs, items = fixture()
    frame = spark.createDataFrame(docs, "doc_id long, text string, key string")
    got = D.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): (r.n_item, r.n_common) for r in got} == want
    assert len(got) == len(want)


def test_one_id_on_many_rows(spark):
    """Verification takes candidate pairs only: a shingle of many items and many rows makes no pairs by itself."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line = text(8)
    items = [(1, f"{text(12)} {line} {text(12)}") for _ in range(300)]
    docs = [(7, f"{text(20)} {line}") for _ in range(5000)] + [(7, items[4][1])]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.containment) for r in got] == [(7, 1, 1.0)]


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminated(docs, items).count() == 0
    assert D.contaminated(items.toDF("doc_id", "text"), items.limit(0)).count() == 0


def test_window_minima():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 8, 9, 40, 200])
    s = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64)
    ends = np.cumsum(sizes)
    for j, c, got, owner in D.window_minima(s, sizes, 3):
        if j:
            break
        want = []
        for e, n in zip(ends, sizes):
            x, u = s[e - n : e] * D._ODD[0], D.SMALLEST << c
            blocks = [x[a : a + u].min() for a in range(0, n, u)]
            want += [min(blocks[i : i + 2]) for i in range(len(blocks))]
        assert got.tolist() == want and len(owner) == len(want)
