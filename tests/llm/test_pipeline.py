import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontamination import brute as contaminated
from test_near_dedup import classes
from test_pii import brute_disclosures

import corpus_pipeline as C
from maskwell.llm import pieces, pii, toxicity
from maskwell.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tun", "x", "the", "ré"]) for _ in range(3))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(20))) for i in range(4)]
    docs, labels = [], []
    for i in range(240):
        w = text(rng.randrange(20, 90))
        toxic = i % 6 == 5
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "grumbel" + rng.choice(["a", "o", "ur"]))
        if i % 24 == 1:
            w[5:5] = items[i % 4][1].split()
        if i % 24 == 2:
            w[5:5] = ["Zorbital", "jane@host.example.org", word(), "10.0.0.7"]
        if i % 12 == 3 and i > 20:
            w = docs[i - 20][1].split()
            w[rng.randrange(len(w))] = "new"
            toxic = False
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 0, int(toxic)))
    docs += [(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, docs[0][1].upper(), "en", "s", 0), (903, "one two", "en", None, 0)]
    docs = [(i, t, a, s, len(t or "")) for i, t, a, s, _ in docs]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, labels, items


def test_run_same_as_brute_force(spark, tables):
    path, docs, labels, items = tables
    frame = spark.read.parquet(f"{path}/documents.parquet")
    score = {r.doc_id: r.score for r in toxicity.score(frame, toxicity.train(frame, spark.read.parquet(f"{path}/labels.parquet"), F.lit(True))).collect()}
    truth = {i for i, _, y in labels if y}
    assert {i for i in score if score[i] >= 0.5} >= truth and len([i for i in score if score[i] >= 0.5 and i not in truth]) <= 3
    rows = [(i, t) for i, t, *_ in docs if score[i] < 0.5]
    of = classes(rows)
    rows = [(i, t) for i, t in rows if of[i] == i]
    hit = {d for d, _ in contaminated(rows, items)}
    rows = [(i, t) for i, t in rows if i not in hit]
    table = {}
    for (c, t), r in brute_disclosures(rows).items():
        table.setdefault(c, {})[t] = r
    want = {i: pii.masked(t or "", *pii.all_spans(t or "", table)) for i, t in rows}
    got = C.run(spark, path).collect()
    model = pieces._model(tokenizer_file("piece_bpe_32k.model"))
    assert {r.doc_id: model.decode(np.frombuffer(r.ids, "<u4").tolist()) for r in got} == want
    assert len(got) == len(want) and all(r.decoded_ok for r in got)
    assert not any(re.search("jane@|Zorbital|10[.]0[.]0[.]7", t) for t in want.values()) and hit and len(of) > len(set(of.values()))


def test_stages_keep_the_columns(spark, tables):
    path, *_ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
    assert C.STAGES[-1][1](spark, docs.limit(0), path).count() == 0
