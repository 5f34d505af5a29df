"""Pages as runs of equal scanlines: what is written is the same image to any decoder, and no page is ever laid out in full."""

import random
import tracemalloc

import numpy as np
import pytest

from maskwell.operators.redact import paint_rows, redact_images
from maskwell.sources import codec, images

TEXTS = ["a", " ", "\n" * 100, "x" * 72, "x" * 73, "é🙂 " * 2000, " a" * 36, "b\x1c\x85 c", "ab cd  " + " " * 65 + "ef"]


def cells(text):
    """The page by its definition, cell by cell."""
    lines = max(1, -(-len(text) // images.COLUMNS))
    page = np.full((images.Y0 + 40 + images.PITCH * lines, images.X0 + images.STRIDE * 71 + images.CELL_W + 40, 3), 255, np.uint8)
    for i, c in enumerate(text):
        if not c.isspace():
            y, x = images.Y0 + images.PITCH * (i // images.COLUMNS), images.X0 + images.STRIDE * (i % images.COLUMNS)
            page[y : y + images.CELL_H, x : x + images.CELL_W] = 40 + ord(c) % 100
    return page


def test_painted_runs_are_the_painted_page():
    rng = random.Random(6)
    for text in TEXTS:
        page = cells(text)
        assert np.array_equal(images.page_pixels(text), page)
        h, w = page.shape[:2]
        corners = [sorted((rng.randrange(w), rng.randrange(w + 30))) + sorted((rng.randrange(h), rng.randrange(h + 30))) for _ in range(8)]
        for boxes in ([], [(0, 0, w, h)], [(x0, y0, x1, y1) for x0, x1, y0, y1 in corners], [(50, 40, 50, 90), (40, 44, 57, 63)]):
            out, covered = paint_rows(*images.page_rows(text), boxes)
            want, mask = page.copy(), np.zeros((h, w), bool)
            for x0, y0, x1, y1 in boxes:
                want[y0:y1, x0:x1], mask[y0:y1, x0:x1] = 0, True
            assert np.array_equal(codec.decode(out), want) and covered == mask.sum() and codec.header(out)[4]
    with pytest.raises(ValueError):
        paint_rows(*images.page_rows("a"), [(-1, 0, 5, 5)])


def test_runs_of_any_width_and_number():
    rng = np.random.default_rng(7)
    for w in (1, 2, 29, 86, 87, 1233, 8192):
        rows = rng.integers(0, 256, (4, 3 * w), np.uint8)
        rows[1] = 9
        times = np.array([1, 130, 2, 44])
        data = codec.encode_rows(rows, times)
        assert np.array_equal(codec.decode(data), np.repeat(rows, times, axis=0).reshape(177, w, 3))
        back, often = codec.decode_rows(data)
        assert np.array_equal(back, rows) and often.tolist() == times.tolist()


def test_damage_is_found():
    rows, times = images.page_rows("some text " * 20)
    data = codec.encode_rows(rows, times)
    for at in range(0, len(data), 7):
        spoilt = bytearray(data)
        spoilt[at] ^= 4
        with pytest.raises(codec.ImageError):
            codec.decode_rows(bytes(spoilt))
    parts = [codec._chunk(k, b) for k, b in codec.chunks(data)]
    for at in range(len(parts)):  # a chunk less, with all checksums of chunks right
        with pytest.raises(codec.ImageError):
            codec.decode_rows(codec.SIGNATURE + b"".join(parts[:at] + parts[at + 1 :]))
    with pytest.raises(codec.ImageError):
        codec.decode_rows(codec.encode(images.page_pixels("a")))


def test_a_page_takes_little_memory():
    text = "word and " * 666
    paint_rows(*images.page_rows(text), [(40, 40, 400, 100)])
    tracemalloc.start()
    try:
        paint_rows(*images.page_rows(text), [(40, 40, 400, 100)])
        assert tracemalloc.get_traced_memory()[1] < images.page_pixels(text).nbytes / 4
    finally:
        tracemalloc.stop()


def test_pages_in_runs_give_the_rows_of_pages_in_pixels(spark):
    boxes = [(4, 4, 50, 70), (40, 60, 900, 80)]
    rows = [(i, t, boxes[: i % 3]) for i, t in enumerate(TEXTS)] + [(99, "a", [(-1, 0, 2, 2)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, boxes array<struct<x0:int,y0:int,x1:int,y1:int>>")
    a, b = ({r.doc_id: r for r in redact_images(df, content="text", read=f).collect()} for f in (images.page_rows, images.page_pixels))
    for k in b:
        assert [a[k][c] for c in ("status", "error", "width", "height", "n_black")] == [b[k][c] for c in ("status", "error", "width", "height", "n_black")]
        assert a[k].output is None or np.array_equal(codec.decode(bytes(a[k].output)), codec.decode(bytes(b[k].output)))
