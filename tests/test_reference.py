import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwell.functions import geometry as G
from maskwell.functions import policy as P
from maskwell.functions import text as T
from maskwell.operators import detect as D
from maskwell.operators import evaluate as E
from maskwell.operators import regions as R
from maskwell.operators import review as V
from maskwell.operators.align import align_geometry, align_page, places_of, unplaced
from maskwell.operators.redact import paint, redact_images
from maskwell.sources import codec, files, images, sinks
from maskwell.streaming import jobs


def test_policy():
    m = P.label_map()
    assert len(P.POLICY) == len(set(P.POLICY)) == 57 and len(m) == 54 and len(set(m.values())) == 53
    assert set(P.POLICY) - set(m.values()) == set(P.NOT_PROMPTED)


def test_prompt_groups(spark):
    sizes = {r.grp: r["count"] for r in P.prompt_groups(spark).groupBy("grp").count().collect()}
    assert sizes == {0: 24, 1: 24, 2: 6}


def test_words_have_code_point_offsets(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["ab", "é-x", "_", "😀", " ", "\n", "12", "-", ".", " ", "日本"]) for _ in range(30))) for i in range(50)] + [(99, None), (98, ""), (97, "  ")]
    got = {}
    for r in T.words(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.ord, r.token, r.start, r.end))
    for i, text in rows:
        want = [(k, m[0], *m.span()) for k, m in enumerate(re.finditer(r"\w+(?:[-_]\w+)*|[^\s\w]", text or ""))]
        assert sorted(got.get(i, [])) == want


@pytest.mark.parametrize("n,starts", [(1, [0]), (72, [0]), (73, [0, 54]), (126, [0, 54]), (127, [0, 54, 108]), (0, [])])
def test_windows(spark, n, starts):
    rows = T.windows(spark.createDataFrame([(1, "w " * n)], "doc_id long, text string")).orderBy("win").collect()
    assert [r.first_word for r in rows] == starts and (not rows or rows[-1].last_word == n)


def test_identical_spans(spark):
    rows = [(1, 0, 5, "email", 0.5), (1, 0, 5, "url", 0.9), (1, 7, 9, "b", 0.4), (1, 7, 9, "a", 0.4), (1, 0, 3, "pin", 0.1), (2, 0, 5, "x", 0.2)]
    got = D.resolve_identical(spark.createDataFrame(rows, "doc_id long, start int, end int, label string, score double")).collect()
    assert sorted((r.doc_id, r.start, r.end, r.label) for r in got) == [(1, 0, 3, "pin"), (1, 0, 5, "url"), (1, 7, 9, "a"), (2, 0, 5, "x")]


def test_spans_on_words(spark):
    words = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 3, 5)], "doc_id long, line int, w_start int, w_end int")
    found = spark.createDataFrame([(1, 1, 4, "email", 0.9), (1, 2, 3, "url", 0.9)], "doc_id long, start int, end int, label string, score double")
    assert sorted((r.label, r.line, r.start, r.end) for r in D.spans_on_words(found, words).collect()) == [("email", 0, 1, 2), ("email", 1, 0, 1)]


@pytest.mark.parametrize("score,ok", [(0.3, True), (0.2999, False), (math.nan, False), (1.0001, False), (1.0, True)])
def test_entity_checks(spark, score, ok):
    df = spark.createDataFrame([(0, 2, "email", score)], "start int, end int, label string, score double")
    assert df.select(D.valid_entity(F.lit(5))).first()[0] is ok
    assert not df.select(D.valid_entity(F.lit(1))).first()[0]


def test_caps(spark):
    rows = spark.range(128).select(F.lit(1).alias("doc_id")).unionByName(spark.range(129).select(F.lit(2).alias("doc_id")))
    assert [r.doc_id for r in D.over_cap(rows).collect()] == [2]


def test_boxes(spark):
    df = spark.createDataFrame([([2, 10], [2, 12]), ([90, 99], [90, 99])], "xs array<int>, ys array<int>")
    got = [tuple(r.b) for r in df.select(G.padded_box(F.col("xs"), F.col("ys"), F.lit(100), F.lit(100)).alias("b")).collect()]
    assert got == [(0, 0, 15, 17), (86, 86, 100, 100)]
    for box, ok in (((0, 0, 64, 32), True), ((0, 0, 65, 32), False), ((5, 0, 5, 9), False), ((-1, 0, 4, 4), False)):
        b = F.struct(*[F.lit(v).alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1"))])
        assert spark.range(1).select(G.valid_box(b, F.lit(64), F.lit(64))).first()[0] is ok
    assert tuple(spark.range(1).select(G.from_drag(F.lit(9), F.lit(2), F.lit(1), F.lit(8)).alias("b")).first().b) == (1, 2, 9, 8)


def masks(seed, n=12, size=60):
    rng = random.Random(seed)
    return [(k, x, y, x + rng.randrange(0, 20), y + rng.randrange(0, 12)) for k in (1, 2) for x, y in ((rng.randrange(size), rng.randrange(size)) for _ in range(n))]


def pixels(boxes, key):
    m = np.zeros((100, 100), bool)
    for k, x0, y0, x1, y1 in boxes:
        if k == key:
            m[y0:y1, x0:x1] = True
    return m


BOXES = "doc_id long, x0 int, y0 int, x1 int, y1 int"


def test_region_algebra_as_on_pixels(spark):
    a, b = masks(1), masks(2)
    ra, rb = (R.union(R.runs_of_boxes(spark.createDataFrame(x, BOXES), ["doc_id"]), ["doc_id"]) for x in (a, b))
    area = lambda df: {r.doc_id: r.area for r in R.area(df, ["doc_id"]).collect()}
    assert area(ra) == {k: pixels(a, k).sum() for k in (1, 2)}
    assert area(R.intersect(ra, rb, ["doc_id"])) == {k: (pixels(a, k) & pixels(b, k)).sum() for k in (1, 2)}
    lost = {r.doc_id: r.lost for r in R.difference_is_empty(ra, rb, ["doc_id"]).collect()}
    assert lost == {k: (pixels(a, k) & ~pixels(b, k)).sum() for k in (1, 2)}


def test_bands_and_segments_as_on_pixels(spark):
    page = np.full((120, 260, 3), 255, np.uint8)
    for x, y, w, h in ((5, 10, 30, 20), (43, 10, 10, 20), (64, 10, 9, 20), (90, 12, 40, 18), (5, 60, 50, 12), (70, 62, 5, 9)):
        page[y : y + h, x : x + w] = 0
    df = spark.createDataFrame([(1, bytearray(codec.encode(page)))], "doc_id long, content binary")
    got = images.layouts(df).first()
    want = [(5, 10, 53, 30), (64, 10, 73, 30), (90, 12, 130, 30), (5, 60, 55, 72), (70, 62, 75, 71)]
    assert got.error is None and [(x.x0, x.y0, x.x1, x.y1) for x in got.boxes] == [(x0, 10 if y0 < 40 else 60, x1, 30 if y0 < 40 else 72) for x0, y0, x1, _ in want]
    # a gap of 0.45 of the height does not split


def test_layout_limits(spark):
    blank = np.full((50, 50, 3), 255, np.uint8)
    dark, low, fine = blank.copy(), blank.copy(), blank.copy()
    dark[:14] = 0
    low[5:14, 5:9] = 0
    fine[5:15, 5:9] = 0
    many = np.full((30, 600 * 8, 3), 255, np.uint8)
    for i in range(513):
        many[5:15, i * 8 : i * 8 + 1] = 0
    df = spark.createDataFrame([(i, bytearray(codec.encode(x))) for i, x in enumerate((blank, dark, low, fine, many))], "doc_id long, content binary")
    got = {r.doc_id: r for r in images.layouts(df).collect()}
    assert [got[i].error for i in range(5)] == ["layout", "layout", "layout", None, "too_many_words"]
    assert [tuple(x) for x in got[3].boxes] == [(5, 5, 15, 9)]


def test_slabs_have_the_areas_of_scanlines(spark):
    a, b = (spark.createDataFrame(masks(k), BOXES) for k in (3, 4))
    area = lambda df: {r.doc_id: r.area for r in R.area(df, ["doc_id"]).collect()}
    plain = [R.union(R.runs_of_boxes(x, ["doc_id"]), ["doc_id"]) for x in (a, b)]
    cut = [R.union(x, ["doc_id"]) for x in R.slabs("doc_id", (a, ["doc_id"]), (b, ["doc_id"]))]
    assert [area(x) for x in plain] == [area(x) for x in cut]
    assert area(R.intersect(*plain, ["doc_id"])) == area(R.intersect(*cut, ["doc_id"]))


def test_texts_that_share_a_key(spark):
    df = spark.createDataFrame([(1, "ab cd"), (1, "x 10.0.0.1 y"), (2, None)], "doc_id long, text string")
    assert sorted((r.token, r.start) for r in T.words(df).collect()) == sorted([("ab", 0), ("cd", 3), ("x", 0), ("y", 11)] + [(t, i + 2) for i, t in ((0, "10"), (2, "."), (3, "0"), (4, "."), (5, "0"), (6, "."), (7, "1"))])
    assert [(r.start, r.end) for r in D.rule_candidates(df).collect()] == [(2, 10)]


def test_detector_over_windows(spark):
    text = " ".join(f"w{i}" for i in range(100)) + " bob@x.org end"
    df = spark.createDataFrame([(1, text), (2, "boom"), (3, "")], "doc_id long, text string")

    def detect(parts):
        if any("boom" in p for p in parts):
            raise RuntimeError("holds text")
        out = []
        for p in parts:
            at = p.find("bob@x.org")
            out.append([(at, at + 9, "email", 0.9)] * (at >= 0) + [(2, 3, "email", 0.9), (0, 2, "nothing", 0.9), (0, 2, "email", 1.5), (5, 5, "email", 0.5), (0, 10**6, "email", 0.5)] * p.startswith("w0"))
        return out

    rows = D.detected(df, T.windows(df), T.words(df), detect).collect()
    at = text.index("bob@")
    assert [(r.doc_id, r.start, r.end, r.label) for r in rows if r.error is None] == [(1, at, at + 9, "email")]
    assert sorted((r.doc_id, r.error) for r in rows if r.error) == [(1, "bad_range"), (1, "bad_range"), (1, "bad_score"), (1, "no_evidence"), (1, "unknown_label"), (2, "detector_failed")]


def test_what_has_no_place_is_named(spark):
    words = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 3, 5)], "doc_id long, line int, w_start int, w_end int")
    found = spark.createDataFrame([(1, 1, 4, "email", 0.9), (1, 2, 3, "url", 0.9)], "doc_id long, start int, end int, label string, score double")
    assert [r.label for r in D.untouched(found, D.spans_on_words(found, words)).collect()] == ["url"]
    pages = spark.createDataFrame([(1, 0, [4])], "doc_id long, line int, unmapped array<int>")
    spans = spark.createDataFrame([(1, "email", 0, 0, 4), (1, "url", 0, 3, 5), (1, "pin", 1, 3, 5)], "doc_id long, label string, line int, start int, end int")
    assert [r.label for r in unplaced(spans, pages).collect()] == ["url"]


def test_entity_metrics(spark):
    ink = [(1, 0, 0, 100, 10)]
    truth = [(1, 0, "email", 0, 0, 10, 5), (1, 1, "url", 20, 0, 30, 5), (1, 2, "pin", 0, 20, 9, 29), (1, 3, "age", 50, 0, 60, 5)]
    applied = [(1, "email", 0, 0, 12, 6), (1, "pin", 18, 0, 31, 6), (1, "age", 50, 0, 55, 5), (1, "age", 80, 50, 90, 60)]
    t = R.runs_of_boxes(spark.createDataFrame(truth, "doc_id long, id int, label string, x0 int, y0 int, x1 int, y1 int"), ["doc_id", "id", "label"])
    a = spark.createDataFrame(applied, "doc_id long, label string, x0 int, y0 int, x1 int, y1 int")
    i = R.runs_of_boxes(spark.createDataFrame(ink, BOXES), ["doc_id"])
    got = {r.id: r for r in E.entity_metrics(t, R.runs_of_boxes(a, ["doc_id", "label"]), i).collect()}
    assert [(got[k].ink_pixels, got[k].covered_pixels, got[k].coverage, got[k].fully_covered, got[k].correct_label_fully_covered) for k in range(4)] == [(50, 50, 1.0, True, True), (50, 50, 1.0, True, False), (0, 0, 0.0, False, False), (50, 25, 0.5, False, False)]
    det = R.runs_of_boxes(a.withColumn("det", F.concat_ws("-", "label", "x0")), ["doc_id", "det"])
    assert [r.det for r in E.false_positives(det, t, i).collect()] == ["age-80"]
    entities = t.select("doc_id", "id", "label").distinct()
    runs = spark.createDataFrame([(1, "failed")], "doc_id long, status string")
    failed = E.with_failures(E.entity_metrics(t, R.runs_of_boxes(a, ["doc_id", "label"]), i), entities, runs).collect()
    assert len(failed) == 4 and not any(r.fully_covered for r in failed) and all(r.failed for r in failed)


IMAGE = "pos int, n_entities long, n_full long, n_correct long, fraction double, failed boolean"


def summary(spark, rows, gate=E.Gate()):
    return E.summary(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], IMAGE), gate).first()


def test_gate(spark):
    perfect = (5, 5, 5, 0.1, False)
    assert summary(spark, [perfect] * 10).gate_passed
    assert not summary(spark, [perfect] * 9).gate_passed
    assert not summary(spark, [(5, 4, 4, 0.1, False)] * 10).gate_passed  # exactly 0.80
    assert not summary(spark, [perfect] * 10 + [(5, 0, 0, 0.0, True)]).gate_passed
    none = summary(spark, [])
    assert (none.n, none.overall, none.correct_label, none.zero_missed_images, none.max_nonpii_ink_mask, none.gate_passed) == (0, 0.0, 0.0, 0.0, 1.0, False)
    real = summary(spark, [(6, 6, 6, 0.112575, False)] * 7 + [(4, 3, 2, 0.0, False)] * 3)
    assert (real.entity_count, round(real.overall, 6), round(real.correct_label, 6), real.zero_missed_images, real.gate_passed) == (54, 0.944444, 0.888889, 0.7, True)
    assert summary(spark, [(0, 0, 0, 0.0, False)]).zero_missed_images == 0


def test_last_prefix_is_the_summary(spark):
    rng = random.Random(4)
    rows = [(i, n, (f := rng.randrange(n + 1)), rng.randrange(f + 1), rng.random(), False) for i, n in enumerate(rng.randrange(6) for _ in range(20))]
    df = spark.createDataFrame(rows, IMAGE).withColumn("g", F.lit(1))
    last, whole = E.prefix_summaries(df, "pos", ["g"]).orderBy("pos").collect()[-1], E.summary(df).first()
    for c in ("n", "entity_count", "n_failed", "gate_passed"):
        assert last[c] == whole[c]
    for c in ("overall", "correct_label", "zero_missed_images", "max_nonpii_ink_mask"):
        assert last[c] == pytest.approx(whole[c])


def test_stop_on_first_failure(spark):
    df = spark.createDataFrame([(1, i, i == 3) for i in range(1, 6)], "g int, pos int, failed boolean")
    assert sorted(r.pos for r in E.until_first_failure(df, "pos", ["g"]).collect()) == [1, 2, 3]


def test_alignment(spark):
    assert align_page(["ab cd"], ["ab", "cd"]) == [([{"start": 0, "end": 2, "word": 0}, {"start": 3, "end": 5, "word": 1}], [])]
    (units, unmapped), = align_page(["abc xyz qq"], ["abc", "xyw", "qq"])
    assert [u["word"] for u in units] == [0, 2] and unmapped == [4, 5, 6]
    (units, unmapped), = align_page(["aa b aa"], ["aa", "c", "aa"])
    assert units == [] and unmapped == [0, 1, 3, 5, 6]
    # a block counts once if it stands once besides itself without overlaps
    assert align_page(["aaab"], ["xaay"])[0][0] == [] and places_of("aaab", "xaay").tolist() == [-1, 0, 1, -1]
    assert align_page([], ["a"]) == [] and align_page(["", " a"], []) == [([], []), ([], [1])]
    lines = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cd"), (2, 0, "x")], "doc_id long, line int, text string")
    words = spark.createDataFrame([(1, 0, "abc"), (1, 1, "d")], "doc_id long, word int, text string")
    got = {(r.doc_id, r.line): ([u.word for u in r.units], list(r.unmapped)) for r in align_geometry(lines, words).collect()}
    assert got == {(1, 0): ([], [0, 1]), (1, 1): ([1], [0]), (2, 0): ([], [0])}


def test_png_round_trip_and_redaction(spark, tmp_path):
    rng = np.random.default_rng(1)
    page = rng.integers(0, 256, (40, 50, 3), dtype=np.uint8)
    data = codec.encode(page)
    assert (codec.decode(data) == page).all() and codec.header(data)[4]
    out = codec.decode(paint(page, [(5, 6, 20, 30)]))
    assert not out[6:30, 5:20].any() and (out[30:] == page[30:]).all()
    (tmp_path / "a.png").write_bytes(data)
    seen = spark.read.format("image").load(str(tmp_path / "a.png")).first().image
    assert (np.frombuffer(bytes(seen.data), np.uint8).reshape(40, 50, 3)[:, :, ::-1] == page).all()
    rows = [(1, bytearray(data), [(0, 0, 9, 9)]), (2, bytearray(b"no image"), None), (3, bytearray(data), None)]
    got = {r.doc_id: r for r in redact_images(spark.createDataFrame(rows, "doc_id long, content binary, boxes array<struct<x0:int,y0:int,x1:int,y1:int>>")).collect()}
    assert [got[i].status for i in (1, 2, 3)] == ["completed_unassessed", "failed", "no_detections_unverified"]
    assert got[1].n_black == 81 and got[2].output is None


def test_png_filters():
    import zlib

    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (5, 7 * 3), dtype=np.uint8)
    raw, above = b"", np.zeros(21, int)
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        line, left = x[y].astype(int), np.concatenate((np.zeros(3, int), x[y, :-3]))
        corner = np.concatenate((np.zeros(3, int), above[:-3]))
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = (0, left, above, (left + above) // 2, paeth)[kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    data = codec.SIGNATURE + codec._chunk(b"IHDR", codec.struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + codec._chunk(b"IDAT", zlib.compress(raw)) + codec._chunk(b"IEND", b"")
    assert (codec.decode(data).reshape(5, 21) == x).all()


def test_uploads(spark):
    png = codec.encode(np.zeros((4, 4, 3), np.uint8))
    rows = [("a", bytearray(png), "image/png"), ("b", bytearray(png), "image/jpeg"), ("c", bytearray(b"GIF89a"), "image/gif"), ("d", bytearray(b"RIFF0000WEBP"), "image/webp"), ("e", bytearray(png[:40]), "image/png")]
    df = images.check_uploads(spark.createDataFrame(rows, "id string, content binary, content_type string"))
    assert {r.id: r.error for r in df.collect()} == {"a": None, "b": "TypeMismatch", "c": "UnknownFormat", "d": "NoDecoder", "e": None}
    assert {r.id: r.error for r in images.normalised(df).collect()}["e"] == "InvalidImage"


def test_recogniser(spark):
    page = images.page_pixels("ab cd  " + " " * 65 + "ef")
    df = spark.createDataFrame([(1, bytearray(codec.encode(page))), (2, bytearray(b"x"))], "doc_id long, content binary")
    got = {r.doc_id: r for r in images.recognised(df, lambda crops: [("w", 0.9)] * len(crops)).collect()}
    assert [r.text for r in got[1].lines] == ["w"] * 3 and [(r.x0, r.y0) for r in got[1].lines] == [(40, 44), (88, 44), (40, 92)]
    assert got[1].error is None and got[2].error == "bad_image" and got[2].lines is None

    def said(answer):
        return images.recognised(df.where("doc_id = 1"), answer).first().error

    def fails(crops):
        raise ValueError("secret text")

    assert said(fails) == "recogniser_failed" and said(lambda c: [("a", 0.5)]) == "count_differs"
    assert said(lambda c: [(" ", 0.5)] * len(c)) == "bad_text" and said(lambda c: [("a", math.nan)] * len(c)) == "bad_score"


def test_json_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"offset": 1, "uid": "a", "annotation_repairs": [], "input_sha256": "x"}, {"offset": 2, "uid": "b", "annotation_repairs": [], "input_sha256": "y"}]')
    assert [r.uid for r in files.read_manifest(spark, str(tmp_path / "m.json"), 1).collect()] == ["a"]
    for n in (0, 11, True):
        with pytest.raises(ValueError):
            files.read_manifest(spark, "x", n)
    (tmp_path / "t.json").write_text('{"uid": "a", "revision": "r", "entities": [{"id": 0, "label": "email", "boxes": [[1, 2, 3, 4]]}], "more": 1}')
    assert files.read_truth(spark, str(tmp_path / "t.json")).first().entities[0].boxes == [[1, 2, 3, 4]]
    assert files.unknown_keys(spark, str(tmp_path / "t.json"), files.TRUTH).first()["keys"] == ["more"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", 0.5), ("r2", 1.0)], "run string, elapsed double")
    sinks.write_runs(df, str(tmp_path / "runs"))
    assert spark.read.text(str(tmp_path / "runs")).count() == 2
    with pytest.raises(Exception):
        sinks.write_runs(df, str(tmp_path / "runs"))
    with pytest.raises(Exception):
        sinks.write_runs(spark.createDataFrame([("r1", math.nan)], "run string, elapsed double"), str(tmp_path / "nan"))
    assert sinks.config_json({"b": 1, "a": 2})[0] == '{"a": 2, "b": 1}'


def test_review(spark):
    runs = spark.createDataFrame([("a", None, "completed_unassessed", "i", "o", True), ("b", "a", "pending_human_review", "i", "o2", False), ("c", None, "failed", "i", "o", False)], "run string, parent_run string, status string, input_sha256 string, output_sha256 string, approved boolean")
    assert {r.run: r.depth for r in V.lineage(runs).collect()} == {"a": 0, "b": 1, "c": 0}
    odd = [("a", None), ("b", "a"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("m", "gone"), ("self", "self")] + [(f"n{i}", f"n{i - 1}" if i else None) for i in range(20)]
    got = V.lineage(spark.createDataFrame(odd, "run string, parent_run string")).collect()
    assert sorted((r.run, r.depth) for r in got) == sorted([("a", 0), ("b", 1)] + [(f"n{i}", i) for i in range(20)])
    hashes = lambda h: spark.createDataFrame([("a", h), ("b", h), ("c", h)], "run string, sha256 string")
    assert [r.run for r in V.openable(runs, hashes("i"), hashes("o")).collect()] == ["a"]
    saves = spark.createDataFrame([("a", "x", "n"), ("b", "y", "n"), ("b", "z", "n")], "run string, new_run string, output_sha256 string")
    new = V.revise(runs, saves).collect()
    assert [(r.run, r.parent_run, r.approved, r.status, len(r.parent_audit_sha256)) for r in new] == [("y", "b", False, "pending_human_review", 64)]
    box = F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(4).alias("x1"), F.lit(4).alias("y1"))
    many = spark.range(129).select(F.lit("a").alias("run"), box.alias("b"), F.lit(9).alias("width"), F.lit(9).alias("height"))
    assert not V.check_boxes(many).first().ok and V.check_boxes(many.limit(128)).first().ok


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 7, i == 40) for i in range(60)]
    for part in range(6):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "doc_id long, n_words long, failed boolean").coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    items = lambda: spark.readStream.schema("doc_id long, n_words long, failed boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    jobs.run_job(items(), str(tmp_path / "out"), str(tmp_path / "cp"), "one", stop_on_failure=False).awaitTermination()
    got = jobs.summaries(jobs.published(spark, str(tmp_path / "out"))).orderBy("batch").collect()
    assert len(got) == 6 and (got[-1].n, got[-1].n_failed, got[-1].n_words) == (60, 1, sum(r[1] for r in rows))
    slow = spark.readStream.format("rate").load().selectExpr("value AS doc_id", "1L AS n_words", "false AS failed")
    busy = slow.writeStream.queryName(jobs.JOB + "other").format("noop").start()
    with pytest.raises(jobs.JobBusy):
        jobs.run_job(items(), str(tmp_path / "out3"), str(tmp_path / "cp3"), "three")
    busy.stop()
    with pytest.raises(Exception):
        jobs.run_job(items(), str(tmp_path / "out2"), str(tmp_path / "cp2"), "two").awaitTermination()
    assert jobs.published(spark, str(tmp_path / "out2")).where("failed").count() == 1


def test_ink_metrics_over_masking(spark):
    from maskwell.operators import evaluate

    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, y int, x0 int, x1 int")
    ink = frame([(1, 0, 0, 10), (1, 1, 0, 10), (2, 0, 0, 8), (3, 0, 0, 4)])
    truth = frame([(1, 0, 0, 6), (1, 0, 4, 8), (3, 0, 0, 9)])
    applied = frame([(1, 0, 2, 9), (1, 1, 0, 5), (2, 0, 0, 2), (2, 0, 1, 4)])
    got = {r.doc_id: (r.sensitive_coverage, r.nonpii_ink_mask) for r in evaluate.ink_metrics(truth, applied, ink).collect()}
    assert got == {1: (6 / 8, 6 / 12), 2: (None, 4 / 8), 3: (0.0, None)}
