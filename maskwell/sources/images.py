"""Image tables: files, uploads and rendered virtual pages; ink runs and word boxes of pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CELL_H, CELL_W, COLUMNS, PITCH, STRIDE, X0, Y0, strip
from ..operators import regions as R
from . import codec

#: First bytes of the formats that uploads may have. WebP is known, but this runtime cannot decode it.
MAGIC = {"image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF", "image/webp": "52494646"}
INK, SCORING_INK = 180, 250


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length, sha256."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length", F.sha2("content", 256).alias("sha256"))


def check_uploads(files: DataFrame, content_type: str = "content_type") -> DataFrame:
    """Adds error: null for what may be decoded. Size and format come from the bytes, before any pixel is read."""
    start = F.hex(F.substring("content", 1, 8))
    kind = F.coalesce(*[F.when(start.startswith(m), k) for k, m in MAGIC.items()])
    error = F.when(F.length("content") > codec.MAX_BYTES, "TooLarge").when(kind.isNull(), "UnknownFormat").when(F.col(content_type) != kind, "TypeMismatch").when(kind == "image/webp", "NoDecoder")
    return files.withColumn("error", error)


def normalised(files: DataFrame) -> DataFrame:
    """Uploads without an error as plain RGB PNG: content is replaced, error tells what could not be decoded. This decoder
    reads PNG; JPEG files are read by read_pictures()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, errors = [], []
            for data, error in zip(b["content"], b["error"]):
                try:
                    out.append(codec.encode(codec.decode(bytes(data))) if error is None else None)
                    errors.append(error)
                except (ValueError, KeyError, IndexError, OSError):
                    out.append(None)
                    errors.append("InvalidImage")
            yield b.assign(content=out, error=errors)

    return files.mapInPandas(run, files.schema)


def orientation(data: bytes) -> int:
    """The EXIF orientation of a JPEG, 1 to 8; 1 if it says nothing."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and part[:6] == b"Exif\0\0" and part[6:8] in (b"II", b"MM"):
            order, tiff = ("little" if part[6:8] == b"II" else "big"), part[6:]
            number = lambda a, n: int.from_bytes(tiff[a : a + n], order)
            first = number(4, 4)
            for k in range(number(first, 2)):
                entry = first + 2 + 12 * k
                if number(entry, 2) == 0x0112 and 1 <= number(entry + 8, 2) <= 8:
                    return number(entry + 8, 2)
        at += 2 + size
    return 1


def upright(pixels: np.ndarray, turn: int) -> np.ndarray:
    """The pixels as an EXIF orientation means them."""
    if turn >= 5:
        pixels = pixels.transpose(1, 0, 2)
    if turn in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return pixels[::-1] if turn in (3, 4, 7, 8) else pixels


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """path, content (plain RGB PNG), error: PNG and JPEG files through Spark's image source, which decodes one frame,
    turned upright. Files that it cannot decode (WebP among them), or that are too large, have an error."""
    name = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    seen = spark.read.format("image").load(path).select(name("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    files = spark.read.format("binaryFile").load(path).select(name("path").alias("path"), "length", F.col("content").alias("_file"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, errors = [], []
            for h, w, n, data, raw, size in zip(b["height"], b["width"], b["nChannels"], b["data"], b["_file"], b["length"]):
                error = "TooLarge" if size > codec.MAX_BYTES or max(h, w) > codec.MAX_SIDE or h * w > codec.MAX_PIXELS else "InvalidImage" if h <= 0 or n not in (1, 3, 4) else None
                errors.append(error)
                if error:
                    out.append(None)
                    continue
                x = np.frombuffer(bytes(data), np.uint8).reshape(h, w, n)
                if n == 4:
                    alpha = x[:, :, 3:].astype(np.uint16)
                    x = ((x[:, :, :3] * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)
                rgb = np.repeat(x, 3, axis=2) if n == 1 else x[:, :, 2::-1]  # the source gives blue first
                out.append(codec.encode(np.ascontiguousarray(upright(rgb, orientation(bytes(raw)) if bytes(raw[:2]) == b"\xff\xd8" else 1))))
            yield pd.DataFrame({"path": b["path"], "content": out, "error": errors})

    return files.join(seen, "path").mapInPandas(run, "path string, content binary, error string")


def clean(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, content: what is handed out, the pixels alone, encoded anew. Images that can't be decoded are null."""
    rows = images.select(key, "content", F.lit(None).cast("string").alias("error"))
    return normalised(rows).select(key, "content")


@lru_cache(maxsize=1)
def _spaces() -> np.ndarray:
    """Whether each code point is white space."""
    return np.array([chr(i).isspace() for i in range(0x110000)])


def page_rows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows, times) of a virtual page: its scanlines as RGB bytes, and how often each stands below the other. Each visible
    character is a grey cell of the grid on white; all scanlines of a line's cells are equal."""
    lines = max(1, -(-len(text) // COLUMNS))
    w = X0 + STRIDE * (COLUMNS - 1) + CELL_W + 40
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cells = np.full(lines * COLUMNS, 255, np.uint8)
    cells[: len(codes)] = np.where(_spaces()[codes], 255, 40 + codes % 100)
    cells = cells.reshape(lines, COLUMNS)
    rows = np.full((2 * lines + 1, 3 * w), 255, np.uint8)  # white stands before, between and after the lines
    inked = rows[1::2]
    inked[:, 3 * X0 : 3 * (X0 + STRIDE * COLUMNS)] = np.repeat(cells, 3 * STRIDE, axis=1)
    # cells are wider than their stride: the columns that they share belong to the next cell, if it is visible
    after = np.column_stack((cells[:, 1:], np.full(lines, 255, np.uint8)))
    shared = np.where(after == 255, cells, after)
    for dx in range(STRIDE, CELL_W):
        for channel in range(3):
            inked[:, 3 * (X0 + dx) + channel :: 3 * STRIDE][:, :COLUMNS] = shared
    times = np.tile([PITCH - CELL_H, CELL_H], lines + 1)[: 2 * lines + 1]
    times[0], times[-1] = Y0, PITCH - CELL_H + 40
    return rows, times


def page_pixels(text: str) -> np.ndarray:
    """The pixels of a virtual page."""
    rows, times = page_rows(text)
    return np.repeat(rows, times, axis=0).reshape(int(times.sum()), -1, 3)


def few_pages(spark: SparkSession, rows: int = 16) -> None:
    """Few rows to a batch, as a page has some MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def render_pages(docs: DataFrame) -> DataFrame:
    """doc_id, content (PNG): virtual pages of texts."""
    few_pages(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": [codec.encode(page_pixels(t)) for t in b["text"]]})

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, content binary")


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1) of a boolean mask."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    _, x1 = np.nonzero(edge == -1)
    return y, x0, x1


def ink_of_images(images: DataFrame, threshold: int = INK, key: str = "doc_id") -> DataFrame:
    """key, y, x0, x1: runs of pixels with a channel below the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, data in zip(b[key], b["content"]):
                y, x0, x1 = runs((codec.decode(bytes(data)) < threshold).any(axis=2))
                yield pd.DataFrame({key: k, "y": y.astype(np.int32), "x0": x0.astype(np.int32), "x1": x1.astype(np.int32)})

    return images.select(key, "content").mapInPandas(run, f"{key} {images.schema[key].dataType.simpleString()}, y int, x0 int, x1 int")


#: Limits of the supported layout, and what is cut around a word for the recogniser.
MAX_SHARE, LEAST_HEIGHT, GAP, MAX_WORDS, RIM, MAX_TEXT = 0.25, 10, 0.45, 512, 8, 6000


def png_side(content: str, at: int):
    """Width (at 17) or height (at 21) from the header of a PNG, without reading pixels."""
    return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")


def layouts(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, boxes (of words, in reading order), error: from the runs of ink, as bands and their segments. An image without
    ink, too dark or with a low band has the error `layout`, one with too many words `too_many_words`."""
    ink = ink_of_images(images, key=key)
    rows = R.bands(ink, [key])
    words = R.segments(ink, rows, [key], GAP)
    area = ink.groupBy(key).agg(F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("_ink"))
    low = rows.groupBy(key).agg(F.min(F.col("y1") - F.col("y0")).alias("_low"))
    count = words.groupBy(key).agg(F.count("*").alias("_n"))
    found = images.select(key, (png_side("content", 17) * png_side("content", 21)).alias("_pixels"))
    for df in (area, low, count):
        found = found.join(df, key, "left")
    odd = F.col("_ink").isNull() | (F.col("_ink") > F.col("_pixels") * MAX_SHARE) | (F.col("_low") < LEAST_HEIGHT)
    found = found.select(key, F.when(odd, "layout").when(F.col("_n") > MAX_WORDS, "too_many_words").alias("error"))
    # only images within the limits gather their words
    fine = words.join(found.where("error is null").select(key), key)
    boxes = fine.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "y1", "x1"))).alias("boxes"))
    return found.join(boxes, key, "left").select(key, "boxes", "error")


def recognised(images: DataFrame, recognize_batch, batch: int = 16, key: str = "doc_id") -> DataFrame:
    """key, error, lines: words of images by a recogniser, a callable from pixel crops to (text, score) pairs. An image
    outside the limits, or one of whose words has no text or no score from 0 to 1, has an error in place of lines. Errors
    are codes: what a recogniser says may hold text of the document. Keys are unique."""
    keytype = images.schema[key].dataType.simpleString()
    sound = decodable(images, key)
    pages = images.join(sound, key)
    cut = pages.where("_sound").join(layouts(pages.where("_sound"), key), key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said, errors = [], []
            for data, boxes in zip(b["content"], b["boxes"]):
                pixels, answers, error = codec.decode(bytes(data)), [], None
                crops = [pixels[max(0, x["y0"] - RIM) : x["y1"] + RIM, max(0, x["x0"] - RIM) : x["x1"] + RIM] for x in boxes]
                try:
                    for a in range(0, len(crops), batch):
                        answers += [(t if isinstance(t, str) else None, float(s)) for t, s in recognize_batch(crops[a : a + batch])]
                except Exception:  # each image fails for itself
                    error = "recogniser_failed"
                said.append([{"text": t, "confidence": s} for t, s in answers])
                errors.append(error)
            yield pd.DataFrame({key: b[key], "said": said, "failed": errors})

    answers = cut.where("error is null").select(key, "content", "boxes").mapInPandas(run, f"{key} {keytype}, said array<struct<text:string,confidence:double>>, failed string")
    rows = pages.select(key, "_sound").join(cut.select(key, "boxes", "error"), key, "left").join(answers, key, "left")
    stripped = F.transform("said", lambda x: F.struct(strip(x["text"]).alias("text"), x["confidence"].alias("confidence")))
    bad_text = F.exists("said", lambda x: x["text"].isNull() | (F.length(strip(x["text"])) == 0) | (F.length(x["text"]) > MAX_TEXT))
    bad_score = F.exists("said", lambda x: x["confidence"].isNull() | F.isnan(x["confidence"]) | ~x["confidence"].between(0, 1))
    error = F.when(~F.col("_sound"), "bad_image").when(F.col("error").isNotNull(), F.col("error")).when(F.col("failed").isNotNull(), F.col("failed"))
    error = error.when(F.size("said") != F.size("boxes"), "count_differs").when(bad_text, "bad_text").when(bad_score, "bad_score")
    lines = F.zip_with(stripped, "boxes", lambda t, x: F.struct(t["text"].alias("text"), t["confidence"].alias("confidence"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1")))
    rows = rows.withColumn("error", error)
    return rows.select(key, "error", F.when(F.col("error").isNull(), lines).alias("lines"))


def decodable(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, _sound: whether the content is an image that can be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for data in b["content"]:
                try:
                    codec.decode(bytes(data))
                    out.append(True)
                except (ValueError, KeyError, IndexError, TypeError, zlib.error, struct.error):
                    out.append(False)
            yield pd.DataFrame({key: b[key], "_sound": out})

    return images.select(key, "content").mapInPandas(run, f"{key} {images.schema[key].dataType.simpleString()}, _sound boolean")
