import random
import re

import xxhash
from pyspark.sql import functions as F

from maskwell.llm import spotsigs as S


def spark_hash(parts):
    h = 42
    for x in parts:
        h = xxhash.xxh64_intdigest(x.encode(), seed=h)
    return h - (h >> 63 << 64)


def signatures(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if x]
    common = set(S.ANCHORS)
    content = [(i, x) for i, x in enumerate(w) if x not in common]
    join = lambda words: " " + "  ".join(words) if words else ""
    spots = [("^", join([x for _, x in content][: S.CHAIN]))]
    stretch = 0
    for i, x in enumerate(w):
        if x in common:
            stretch = 0
            after = [y for j, y in content if j > i][: S.CHAIN]
            if not (i + 1 < len(w) and w[i + 1] in common) and len(after) == S.CHAIN:
                spots.append((x, join(after)))
        else:
            stretch += 1
            after = w[i : i + S.CHAIN + 1]
            if stretch > S.LONG and len(after) == S.CHAIN + 1 and not common.intersection(after):
                spots.append(("", *after))
    return sorted({spark_hash(x) for x in spots})


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def fixture():
    rng = random.Random(2)
    words = ["the", "of", "la", "und", "és", "kata", "Lomi", "tun,", "réx", "9", "it's", "\n", "—", "x.y"]
    rows = [(rng.randrange(10**6), " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for _ in range(60)]
    return rows + [(7, None), (8, ""), (9, "table | of | " * 2 + "cell | " * 50), (-5, "the"), (10**9, "the big house"), (7, "again the same id")]


def test_same_as_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, signatures string")
    got = S.fingerprints(docs).withColumns({"e": S.likeness("signatures", "edited_signatures"), "n": S.likeness("signatures", "next_signatures")}).collect()
    order = sorted((i, t or "") for i, t in rows)
    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        s, e, n = signatures(t), signatures(edited), signatures(after)
        want[i, t] = (len(t), edited, s, e, jaccard(s, e), jaccard(s, n))
    assert {(r.doc_id, r.text): (r.n_chars, r.edited, r.signatures, r.edited_signatures, r.e, r.n) for r in got} == want
    assert len(got) == len(rows)


def test_repeats_single_null_ids_and_empty(spark):
    one = spark.createDataFrame([(1, "the big house of cards")], "doc_id long, text string")
    r = S.fingerprints(one).first()
    assert r.next_signatures == r.signatures
    assert S.fingerprints(one.limit(0)).count() == 0
    two = spark.createDataFrame([(None, "abc the d"), (1, "x"), (1, "x"), (None, None)], "doc_id long, text string")
    assert S.fingerprints(two).count() == 4
    long = spark.createDataFrame([(1, "the of " * 100_000 + "big house"), (2, "kata " * 100_000)], "doc_id long, text string")
    assert [len(r.signatures) for r in S.fingerprints(long).orderBy("doc_id").collect()] == [2, 2]


def test_search_same_as_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice(["the", "of", "und"]) if rng.random() < 0.3 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))] for _ in range(25)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        for k in range(3):
            v = list(w)
            for _ in range(k + 1):
                v[rng.randrange(len(v))] = "new"
            rows.append((100 + 3 * i + k, " ".join(v)))
    rows += [(1000 + i, base[0] and " ".join(base[0])) for i in range(15)] + [(2000 + i, t) for i, t in enumerate([None, "", "the of"] * 3)]
    line = " ".join(base[1][:20])
    rows += [(3000 + i, f"{line} own{i} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(12))) for i in range(40)]
    rows += [(4000, rows[0][1]), (4000, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, query_id string")
    got = {(r.query_id, r.doc_id): r.similarity for r in S.search(docs.where(F.col("doc_id") % 5 == 0), docs).collect()}
    sig = {i: signatures(t or "") for i, t in rows}
    want = {(i, j): jaccard(sig[i], sig[j]) for i in sig if i % 5 == 0 for j in sig if jaccard(sig[i], sig[j]) >= 0.8}
    assert got == want and len(got) > len([i for i in sig if i % 5 == 0])


def test_an_edit_changes_the_spots_around_it():
    """No text that keeps three quarters loses all its signatures."""
    rng = random.Random(3)
    for share in (0, 0.02, 0.1, 0.11, 0.12, 0.3):
        for _ in range(20):
            w = [rng.choice(S.ANCHORS) if rng.random() < share else f"w{rng.randrange(10**6)}" for _ in range(60)]
            v = w[:45] + [rng.choice(S.ANCHORS) if rng.random() < 0.3 else f"w{rng.randrange(10**6)}" for _ in range(15)]
            assert jaccard(signatures(" ".join(w)), signatures(" ".join(v))) > 0.2


def test_ranges(spark):
    rng = random.Random(7)
    for n in (0, 1, 2, 5, 9, 37):
        bounds = sorted(rng.sample(range(100), n))
        got = [r[0] for r in spark.range(100).select(F.expr(S.range_of(bounds, "id"))).collect()]
        assert got == [sum(b < i for b in bounds) for i in range(100)]
