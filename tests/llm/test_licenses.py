import random
import re

from maskwell.llm import licenses as L


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = words(text)
    starts, labels = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force():
    rng = random.Random(1)
    parts = ["MIT", "License", "apache", "general", "Public", "license", " ", ", ", "\n", "x", "é", "İ", "ſ", "K", "_", "-", "\x7f"]
    for _ in range(500):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(30)))
        assert L.scan(text)[:5] == brute(text), text
    assert L.scan("")[:6] == (0, 0, None, None, "", "")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_edited_notices_are_found():
    rng = random.Random(2)
    for n, (notice, label) in enumerate(L.NOTICES):
        k = max(1, len(notice) // L.CHARS_PER_EDIT)
        for _ in range(30):
            s = list(notice)
            for _ in range(rng.randrange(k + 1)):
                at = rng.randrange(1, len(s) - 1)
                what = rng.randrange(3)
                if what == 0:
                    s[at] = "q"
                elif what == 1:
                    del s[at]
                else:
                    s.insert(at, "q")
            edited = "".join(s)
            if distance(notice, " ".join(words(edited))) > k:
                continue  # a separator went along with its only word
            text = "some words before. " + edited.title() + " and after"
            n_words, *_, labels, score, spans = L.scan(text)
            assert spans, (notice, edited)
            best = min(spans, key=lambda x: x["edits"])
            assert best["edits"] <= distance(notice, " ".join(words(edited)))
            if best["label"] == label:
                assert label in labels and text[best["start"] : best["end"]].lower() in text.lower()
            assert 0 <= score <= 1


def test_operator(spark):
    rows = [(1, "Released under the MIT License.", "a"), (2, None, None), (3, "", "b"), (4, "x " * 50000 + "GNU General Public License", "a"), (1, "Released under the MIT License.", "a"), (None, "apache license", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = sorted(L.license_scan(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.base_labels for r in got] == ["mit", "mit", "", "", "gpl", "apache"]
    assert got[4].first_word == 50001 and got[4].n_words == 50004
    assert got[0].score == 1.0 and got[2].score == 0.0 and got[0].spans[0].start == 0
    assert L.license_scan(docs.limit(0)).count() == 0
