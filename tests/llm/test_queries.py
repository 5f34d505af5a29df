"""Each query over a small table: the columns and types of its contract, whole tables, and what can be told without the operator."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from maskwell.llm import queries as Q
from maskwell.llm.common import plain_words, words_of

BOOL, LONG, DOUBLE, TEXT, INT = "boolean", "bigint", "double", "string", "int"
CONTRACTS = {
    "op1_near_dedup": [("doc_id", LONG), ("class_id", LONG)],
    "op2_lm_scoring": [("doc_id", LONG), ("held_out", BOOL), ("n_tokens", LONG), ("n_known", LONG), ("train_tokens", LONG), ("base_score", DOUBLE), ("score", DOUBLE)],
    "op3_language_id": [("doc_id", LONG), ("held_out", BOOL), ("lang_pred", TEXT), ("score", DOUBLE)],
    "op4_token_files": [("doc_id", LONG), ("start", LONG), ("n_tokens", LONG), ("ids_crc32", LONG)],
    "op5_license_scan": [("doc_id", LONG), ("n_words", LONG), ("n_base", LONG), ("first_word", LONG), ("last_word", LONG), ("base_labels", TEXT), ("labels", TEXT), ("score", DOUBLE)],
    "op6_decontamination": [("doc_id", LONG), ("item_id", LONG)],
    "op7_toxicity": [("doc_id", LONG), ("held_out", BOOL), ("score", DOUBLE), ("predicted", INT)],
    "op8_sentence_pieces": [("doc_id", LONG), ("n_pieces", LONG), ("n_bytes", LONG), ("ids_crc32", LONG), ("decoded_ok", BOOL)],
    "op9_spotsigs": [("doc_id", LONG), ("n_chars", LONG), ("edited_sha256", TEXT), ("fingerprint", TEXT), ("edited_fingerprint", TEXT), ("near_edited", DOUBLE), ("near_next", DOUBLE)],
    "op10_pii": [("doc_id", LONG), ("n_email", LONG), ("n_ip", LONG), ("n_card", LONG), ("n_phone", LONG), ("base_sha256", TEXT), ("spans", TEXT)],
}


def rows():
    out = []
    for i in range(60):
        words = [f"{'the of and to' if i % 2 else 'der die und das'}".split()[k % 4] if k % 3 else f"w{(i * 37 + k * 11) % 97}{'grumbel' if i % 5 == 3 and k == 4 else ''}" for k in range(10 + i % 23)]
        out.append((i, " ".join(words), "en" if i % 2 else "de"))
    out[7] = (7, "Mail bob@example.org or 10.1.2.3, under the MIT License. " + out[7][1], "en")
    return out + [(100, None, "en"), (101, "", None), (102, out[3][1], "en"), (103, "!?", "de")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int("grumbel" in (t or ""))) for i, t, _ in rows()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, rows()[9][1]), (2, "nothing of this stands in any text at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_every_query_has_its_contract():
    assert set(Q.queries()) == set(CONTRACTS)


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract(spark, sf_dir, name):
    if name.startswith(("op4", "op8")):
        pytest.importorskip("public_tokenizers")
    df = Q.queries()[name](spark, sf_dir)
    assert df.dtypes[: len(CONTRACTS[name])] == CONTRACTS[name]
    got = {r.doc_id: r for r in df.collect()}
    texts = {i: t or "" for i, t, _ in rows()}
    crc = lambda i, n: zlib.crc32(str(i).encode()) % n
    if name.startswith("op6"):
        assert {(r.doc_id, r.item_id) for r in got.values()} == {(9, 1)}
        return
    assert sorted(got) == sorted(texts)
    fold = {"op2_lm_scoring": (7, 2), "op3_language_id": (4, 2), "op7_toxicity": (5, 0)}.get(name)
    if fold:
        assert all(r.held_out == (crc(i, fold[0]) == fold[1]) for i, r in got.items())
    for i, r in got.items():
        t = texts[i]
        if name.startswith("op1_"):
            assert r.class_id == (3 if i == 102 else i)
        elif name.startswith("op2_"):
            assert r.n_tokens == len(words_of(t)) + 1 and r.score < 0
        elif name.startswith("op3_"):
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, t))) and 0 <= r.score <= 1
        elif name.startswith("op4_"):
            assert r.n_tokens >= 1
        elif name.startswith("op5_"):
            assert r.n_words == len(plain_words(t)) and r.base_labels == ("mit" if i == 7 else "") and (r.first_word is None) == (i != 7)
        elif name.startswith("op7_"):
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        elif name.startswith("op8_"):
            assert r.decoded_ok and (r.n_pieces == 0) == (t == "")
        elif name.startswith("op9_"):
            order = sorted(texts)
            after = texts[order[(order.index(i) + 1) % len(order)]]
            q = len(t) // 4
            edited = t[: len(t) - q] + after[:q]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and 0 <= r.near_next <= 1 and r.near_edited > 0
            assert (r.fingerprint == got[3].fingerprint) == (i in (3, 102))
        elif name.startswith("op10_"):
            base = f"email:5:20,ip:24:32" if i == 7 else ""
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == ((1, 1, 0, 0) if i == 7 else (0, 0, 0, 0))
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r.spans.split(","))
    if name.startswith("op4_"):
        start = 0
        for i in sorted(got):
            assert got[i].start == start
            start += got[i].n_tokens
    if name.startswith("op2_"):
        assert {r.train_tokens for r in got.values()} == {sum(len(words_of(t)) + 1 for i, t in texts.items() if crc(i, 7) != 2)}


def test_queries_read_no_other_columns(spark, sf_dir):
    """A prediction doesn't depend on lang, source or ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from maskwell.llm import langid

    model = langid.train(docs, F.lit(True))
    plain = {r.score for r in langid.identify(docs.where("doc_id = 5"), model).collect()}
    other = docs.where("doc_id = 5").withColumns({"lang": F.lit("zz"), "doc_id": F.lit(999).cast("long"), "source": F.lit("q")})
    assert {r.score for r in langid.identify(other, model).collect()} == plain
