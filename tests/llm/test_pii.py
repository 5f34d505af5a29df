import hashlib
import math
import random
import re

from maskwell.llm import pii as P


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        odd = sum(int(c) for c in d[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])
        if 12 <= len(d) <= 19 and odd % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


def test_base_same_as_the_patterns():
    rng = random.Random(1)
    parts = ["a.b", "@", "x-1.com", ".", "..", "1", "255.", "256", "10.0.0.1", "4111 1111 1111 1111", "4111-1111", " ", "  ", "-", "+1", "(555) ", "555-1234", "é", "+", "%", "0", "007", "12345678", "\n", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert P.base_spans(text) == brute_base(text), text
    long = "a" * 200_000 + " " + "1" * 200_000 + " " + "a@" * 50_000 + "+1" + " " * 100_000
    assert P.base_spans(long) == []


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    common = [word() for _ in range(30)]
    rows = []
    for i in range(150):
        w = [rng.choice(common) if rng.random() < 0.7 else word() for _ in range(40)]
        if i % 10 == 0:  # a word that goes along with one person only
            w[20:20] = ["Zorbital", "jane@host.example.org", rng.choice(common), word()]
        if i % 15 == 0:
            w[5:5] = ["quimble", "10.0.0.7"]
        if i % 7 == 0:
            w.append("quimble")
        rows.append((i, " ".join(w)))
    return rows + [(200, None), (201, ""), (5, rows[5][1])]


def brute_disclosures(rows, alpha=P.ALPHA, least=P.MIN_CONTEXTS):
    texts = [t or "" for _, t in rows]
    near, docs, has = {}, {}, {}
    for d, t in enumerate(texts):
        for term in set(re.findall(r"[^\W\d_]{4,}", t.lower())):
            docs.setdefault(term, set()).add(d)
        base = P.base_spans(t)
        for span in base:
            key, terms = P.entity_key(t, span), P.near_terms(t, span, base)
            has.setdefault(key, set()).add(d)
            context = " ".join(x for x, _, _ in terms)
            for x, _, _ in terms:
                n = near.setdefault((key, x), (set(), set()))
                n[0].add(d)
                n[1].add(context)
    out = {}
    for (c, t), (d, contexts) in near.items():
        pmi = math.log2(len(texts) * len(d) / (len(docs[t]) * len(has[c])))
        ic = math.log2(len(texts) / len(has[c]))
        if len(contexts) >= least and ic > 0 and pmi >= alpha * ic:
            out[c, t] = pmi >= ic - 1e-9
    return out


def test_disclosures_same_as_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_disclosures(rows)
    assert {(r.entity, r.term): r.removed for r in P.disclosures(docs).collect()} == want
    assert ("email:jane@host.example.org", "zorbital") in want and not any(t == "quimble" for _, t in want)


def test_find_and_redact_by_both_ways(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    table = {}
    for (c, t), r in brute_disclosures(rows).items():
        table.setdefault(c, {})[t] = r
    for limit in (P.BROADCAST_TERMS, -1):
        monkeypatch.setattr(P, "BROADCAST_TERMS", limit)
        got = sorted(P.find(docs).collect(), key=lambda r: (r.doc_id, r.spans))
        assert len(got) == len(rows)
        for r, (i, t) in zip(got, sorted(((i, t) for i, t in rows), key=lambda x: x[0])):
            base, terms = P.all_spans(t or "", table)
            assert r.doc_id == i and r.n_email == sum(k == "email" for k, _, _ in base)
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
            assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in P.in_order(base + [("term", s, e) for s, e, _ in terms]))
        clean = {r.doc_id: r for r in P.redact(docs).collect()}
        assert clean[200].text is None and clean[201].text == "" and clean[0].spans == "x"
        assert "jane@" not in clean[10].text and "Zorbital" not in clean[10].text and "[EMAIL]" in clean[10].text and "[IP]" in clean[15].text
    assert P.find(docs.limit(0)).count() == 0


def test_terms_of_entities_that_occur_once_and_far_away(spark):
    far = "Zyxwalda " + "kata lomi suno " * 60 + "ann@one.example.org " + "kata lomi " * 60 + "Quorbin"
    rows = [(0, far)] + [(i, "kata lomi suno tire") for i in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.term, r.removed) for r in P.disclosures(docs).collect()} == {("zyxwalda", True), ("quorbin", True)}
    clean = P.redact(docs).where("doc_id = 0").first().text
    assert "Zyxwalda" not in clean and "Quorbin" not in clean and "[EMAIL]" in clean and "kata lomi suno" in clean


def test_columns_of_the_input_stay(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "Zorb wrote bob@example.org AGAIN zeta", "k", 1, True)] + [(i, f"word{'abcdefgh'[i % 8]} plain text", "k", i, False) for i in range(1, 60)], "doc_id long, text string, _key string, _terms int, _has boolean")
    for most in (100_000, 0):  # terms by broadcast, and by join
        monkeypatch.setattr(P, "BROADCAST_TERMS", most)
        got = P.redact(docs)
        assert got.columns == docs.columns
        rows = {r.doc_id: r for r in got.collect()}
        assert len(rows) == 60 and rows[0]._terms == 1 and rows[0]._key == "k" and "[EMAIL]" in rows[0].text and "bob@" not in rows[0].text


def test_terms_are_generalised_by_shape():
    text = "Anna saw NATO plain a@b.c"
    base = P.base_spans(text)
    assert P.masked(text, base, [(0, 4, False), (9, 13, False), (14, 19, False)]) == "[NAME] saw [ACRONYM] [WORD] [EMAIL]"
    assert P.masked(text, base, [(0, 4, True)]) == " saw NATO plain [EMAIL]"
