import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwell.functions import text as T
from maskwell.operators import detect as D
from maskwell.operators import models
from maskwell.operators import review as V
from maskwell.sources import codec, images
from maskwell.streaming import jobs


def test_windows_within_a_budget(spark):
    rows = [(1, [1] * 127), (2, [10] * 50), (3, [1, 400]), (4, []), (5, None), (6, [352, 352, 1])]
    got = {}
    for r in T.budget_windows(spark.createDataFrame(rows, "doc_id long, counts array<int>")).collect():
        got.setdefault(r.doc_id, []).append((r.first_word, r.last_word, r.error))
    assert [x[:2] for x in sorted(got[1])] == [(0, 72), (54, 126), (108, 127)]
    assert [x[:2] for x in sorted(got[2])] == [(0, 35), (17, 50)]
    assert got[3] == [(None, None, "word_over_budget")] and 4 not in got and 5 not in got
    assert [x[:2] for x in sorted(got[6])] == [(0, 1), (1, 2), (2, 3)]


def test_phases_and_caps(spark):
    steps = [(1, 0, "ocr"), (1, 1, "redact"), (1, 2, "finish"), (2, 0, "redact"), (3, 0, "ocr"), (3, 1, "drop"), (4, 3, "finish")]
    got = D.phase_errors(spark.createDataFrame(steps, "doc_id long, pos int, action string")).collect()
    assert sorted((r.doc_id, r.error) for r in got) == [(2, "wrong_phase"), (3, "unknown_action"), (4, "wrong_phase")]
    found = spark.createDataFrame([(1,)] * 100 + [(2,)] * 129 + [(3,)], "doc_id long")
    spans = spark.createDataFrame([(1,)] * 129 + [(3,)] * 128, "doc_id long")
    assert sorted(r.doc_id for r in D.failed_by_cap(found, spans).collect()) == [1, 2]


def test_models(tmp_path):
    models.ModelConfig("cuda", "fp16", 64)
    for wrong in (("tpu",), ("cpu", "fp16"), ("cpu", "fp32", 0), ("cpu", "fp32", 65), ("cpu", "fp32", True)):
        with pytest.raises(ValueError):
            models.ModelConfig(*wrong)
    (tmp_path / "m").write_bytes(b"abc")
    assert models.checked_file(str(tmp_path / "m"), hashlib.sha256(b"abc").hexdigest())
    with pytest.raises(ValueError):
        models.checked_file(str(tmp_path / "m"), "0" * 64)
    loads = []

    def load():
        loads.append(1)
        return lambda b: 1 / b

    assert models.call("m", load, 2) == models.call("m", load, 2) == 0.5 and len(loads) == 1
    with pytest.raises(ZeroDivisionError):
        models.call("m", load, 0)
    assert models.call("m", load, 1) == 1 and len(loads) == 2


def test_records(spark):
    runs = spark.createDataFrame([(["a", "b"], [1], 0.5), (None, None, 0.0005), (["c"], [4, 5], 0.001)], "detections array<string>, geometry_unmapped array<int>, elapsed_seconds double")
    assert tuple(V.totals(runs).first()) == (3, 3, 3, 0.502) and tuple(V.totals(runs.limit(0)).first()) == (0, 0, 0, 0.0)
    row = spark.range(1).select(V.error_code(F.lit("ValueError")), V.error_code(F.lit("text of a page")), V.run_id(F.lit("a"), F.lit("b"))).first()
    assert row[:2] == ("ValueError", "InferenceError") and len(row[2]) == 16


def test_save(spark):
    page = np.full((20, 30, 3), 255, np.uint8)
    page[2:4, 2:4] = 0
    data = codec.encode(page)
    sha = hashlib.sha256(data).hexdigest()
    current = spark.createDataFrame([("a", None, "completed_unassessed", sha, True), ("b", None, "completed_unassessed", "0" * 64, True), ("c", None, "completed_unassessed", sha, True)], "run string, parent_run string, status string, output_sha256 string, approved boolean")
    outputs = spark.createDataFrame([(r, bytearray(data)) for r in "abc"], "run string, content binary")
    box = "struct<x0:int,y0:int,x1:int,y1:int>"
    drawn = spark.createDataFrame([("a", "a2", (5, 5, 9, 9), 30, 20), ("a", "a2", (0, 0, 3, 3), 30, 20), ("b", "b2", (5, 5, 9, 9), 30, 20), ("c", "c2", (5, 5, 31, 9), 30, 20)], f"run string, new_run string, b {box}, width int, height int")
    rows, new = V.save(current, drawn, outputs)
    (r,), (i,) = rows.collect(), new.collect()
    assert (r.run, r.parent_run, r.status, r.approved) == ("a2", "a", "pending_human_review", False) and r.output_sha256 == i.output_sha256 == hashlib.sha256(bytes(i.content)).hexdigest()
    got = codec.decode(bytes(i.content))
    assert not got[5:9, 5:9].any() and not got[2:4, 2:4].any() and not got[:3, :3].any() and got[15, 20, 0] == 255
    assert [codec.header(bytes(x.content))[4] for x in images.clean(new.withColumnRenamed("run", "doc_id")).collect()] == [True]


def test_pictures(spark, tmp_path):
    page = np.zeros((8, 16, 3), np.uint8)
    page[:, :8] = (200, 40, 90)
    (tmp_path / "a.png").write_bytes(codec.encode(page))
    (tmp_path / "bad.png").write_bytes(b"no image")
    jvm = spark.sparkContext._jvm
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / "a.png")))
    assert jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / "b.jpg")))
    jpeg = (tmp_path / "b.jpg").read_bytes()
    tiff = b"MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"
    exif = b"Exif\0\0" + tiff
    (tmp_path / "c.jpg").write_bytes(jpeg[:2] + b"\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + jpeg[2:])
    got = {r.path.rsplit("/", 1)[1]: r for r in images.read_pictures(spark, str(tmp_path)).collect()}
    assert (codec.decode(bytes(got["a.png"].content)) == page).all() and got["bad.png"].error == "InvalidImage"
    assert np.abs(codec.decode(bytes(got["b.jpg"].content)).astype(int)[:, :6] - page[:, :6]).max() < 40
    turned = codec.decode(bytes(got["c.jpg"].content)).astype(int)
    assert turned.shape == (16, 8, 3) and np.abs(turned[:6] - (200, 40, 90)).max() < 40 and turned[10:].max() < 40  # a quarter to the right


def test_summary_after_each_batch(spark, tmp_path):
    for part in range(3):
        spark.createDataFrame([(part * 10 + i, False) for i in range(10)], "doc_id long, failed boolean").coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    items = spark.readStream.schema("doc_id long, failed boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = jobs.run_job(items, str(tmp_path / "out"), str(tmp_path / "cp"), "sums", stop_on_failure=False)
    q.awaitTermination()
    assert tuple(spark.read.json(str(tmp_path / "out-summary")).select("n", "n_failed", "batch").first()) == (30, 0, 2)
    took = jobs.performance(q)
    assert took["batches"] == 3 and took["rows"] == 30 and took["seconds"] > 0
