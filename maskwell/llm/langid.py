"""Language ID: nearest centroid among several per language, on normalised TF-IDF vectors of character n-grams.

Character n-grams (1 to 3 code points of the text, A-Z and other capitals lower-cased, white space as one
space, digits and ASCII punctuation left out) are hashed into DIMS buckets. Document frequencies are counted
over all training documents. The weight of a bucket is (1 + ln tf) * idf, and vectors have length one. A
bounded sample of each language (MAX_TRAIN different texts, a documented parameter: those of the lowest hashes) is clustered by
spherical k-means into CENTROIDS centroids, each language in a task of its own; a text takes the language of the nearest
centroid by cosine. The sample is found in one pass over all languages: from the number of a language's rows follows the
hash below which its sample lies, so few rows meet, and each brings its vector along. Distance-based
rejection: if the cosine is below the reject threshold (a low quantile of the training rows' own cosines,
scaled), the text is flagged as rejected; lang_pred stays the nearest language.

Null texts, and texts without a letter, are `und` with score 0. Without training rows all texts are `und`.
Repeated rows have equal results, and count once in the sample, whatever their ids. Ties go to the first language in alphabetical order. Extra columns of the
input are not read; texts are read whole, in blocks of code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches

DIMS = 1 << 13
MAX_TRAIN = 1500
CENTROIDS = 4
#: A text is rejected below this share of the 1 % quantile of the training rows' cosines.
REJECT_SHARE = 0.6
#: The limits of so many languages are broadcast (a hundred bytes each).
MOST_LANGS = 10_000
BLOCK = 1 << 16


def _fold_table() -> np.ndarray:
    """Code point of the Basic Multilingual Plane -> lower case; 32 for white space; 0 for what is left out."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            out[i] = 32
        elif i < 128 and not c.isalpha() or unicodedata.category(c)[0] in "NPSC":
            out[i] = 0
        elif len(low := c.lower()) == 1:
            out[i] = min(ord(low), (1 << 16) - 1)
    return out


_TABLE: np.ndarray | None = None


def table() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = _fold_table()
    return _TABLE


def has_letter(text: str | None) -> bool:
    """isalpha of any character; cheap, as it stops at the first."""
    return text is not None and any(map(str.isalpha, text))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of the whole text."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    t, total = table(), np.zeros(DIMS, np.int64)
    tail = np.array([32, 32], np.uint32)
    for a in range(0, len(cp), BLOCK):
        x = cp[a : a + BLOCK]
        x = np.where(x < (1 << 16), t[np.minimum(x, (1 << 16) - 1)], x)
        x = np.concatenate((tail, x[x > 0]))
        space = x == 32
        x = x[~(space & np.concatenate(([False], space[:-1])))] if a == 0 else x[np.concatenate(([True, True], ~(space[2:] & space[1:-1])))]
        tail = x[-2:] if len(x) >= 2 else np.concatenate((tail, x))[-2:]
        if len(x) < 3:
            continue
        one, two = x[2:], (x[1:-1] << np.uint32(16)) ^ x[2:]
        three = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        for salt, g in enumerate((one, two, three)):
            h = (g + np.uint32(salt * 0x27D4EB2F)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            total += np.bincount(h >> np.uint32(32 - DIMS.bit_length() + 1), minlength=DIMS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # [languages * CENTROIDS, DIMS]
    owner: np.ndarray
    langs: list[str]
    reject: float = 0.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = counts(text)
        w = ((1 + np.log(n)) * self.idf[at]).astype(np.float32)
        norm = np.sqrt((w * w).sum())
        return at, w / norm if norm > 0 else w

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        at, w = self.vector(text)
        cos = self.columns[at].T @ w
        best = int(cos.argmax())
        c = float(min(1.0, max(0.0, cos[best])))
        return self.langs[self.owner[best]], c, c < self.reject

    def __post_init__(self):
        self.columns = np.ascontiguousarray(self.centroids.T)  # rows are gathered by bucket


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centres are rows far apart. Fewer rows than k give fewer centres."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    near = x @ centres[0]
    while len(centres) < min(k, len(x)):
        d = np.maximum(1 - near, 0)
        if d.sum() <= 1e-9:
            break
        centres.append(x[rng.choice(len(x), p=d / d.sum())])
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        mine = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (rows := mine == i).any():
                c[i] = x[rows].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, k: int = CENTROIDS, seed: int = 5) -> Model:
    """usable: a condition for training rows. Document frequencies come from all of them, centroids from the sample."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def df_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for t in column(b, "text"):
                total[counts(t)[0]] += 1
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(DIMS + 1), pa.int32()), "n": pa.array(np.append(total, n), pa.int64())})

    df = rows.select("text").mapInArrow(df_run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    freq = np.zeros(DIMS + 1, np.int64)
    for r in df:  # DIMS + 1 rows at most
        freq[r.bucket] = r.n
    idf = np.log((1 + freq[DIMS]) / (1 + freq[:DIMS])).astype(np.float32) + 1
    # the share of each language's hashes that holds a little more than max_train rows
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    model = Model(idf, np.zeros((0, DIMS), np.float32), np.zeros(0, int), [])
    if not langs:
        return model
    limits = spark.createDataFrame([(lang, int(min(1.0, (1.1 * max_train + 50) / sizes[lang]) * ((1 << 62) - 1))) for lang in langs], "its string, most long")

    def vec_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.vector(t) for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("lang")), b.column(b.schema.get_field_index("h")), pa.array([a.astype("<u2").tobytes() for a, _ in got], pa.binary()), pa.array([w.astype("<f2").tobytes() for _, w in got], pa.binary())], names=["lang", "h", "at", "w"])

    hashed = rows.select("lang", "text", F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "text"), 2).alias("h"))
    sample = hashed.join(F.broadcast(limits) if len(langs) <= MOST_LANGS else limits, (F.col("lang") == F.col("its")) & (F.col("h") <= F.col("most"))).select("lang", "h", "text")
    vectors = sample.mapInArrow(vec_run, "lang string, h long, at binary, w binary").dropDuplicates(["lang", "h"])

    def centres_of(got):
        import pandas as pd  # not at the top: workers of operators that share kmeans() need not hold it

        got = got.sort_values("h").head(max_train)
        x = np.zeros((len(got), DIMS), np.float32)
        for j, (at, w) in enumerate(zip(got["at"], got["w"])):
            x[j, np.frombuffer(at, "<u2")] = np.frombuffer(w, "<f2")
        x = x[np.linalg.norm(x, axis=1) > 0.5]  # texts without an n-gram
        if not len(x):
            return pd.DataFrame({"lang": [], "centres": [], "cosines": []})
        c = kmeans(x, k, seed)
        return pd.DataFrame({"lang": got["lang"].iloc[:1].tolist(), "centres": [c.astype("<f4").tobytes()], "cosines": [(x @ c.T).max(axis=1).astype("<f4").tobytes()]})

    # a few centroids and numbers come back for each language
    fitted = vectors.groupBy("lang").applyInPandas(centres_of, "lang string, centres binary, cosines binary").collect()
    if not fitted:
        return model
    fitted.sort(key=lambda r: r.lang)
    centres = [np.frombuffer(r.centres, "<f4").reshape(-1, DIMS) for r in fitted]
    cosines = np.concatenate([np.frombuffer(r.cosines, "<f4") for r in fitted])
    owner = np.repeat(np.arange(len(fitted)), [len(c) for c in centres])
    return Model(idf, np.concatenate(centres).astype(np.float32), owner, [r.lang for r in fitted], float(REJECT_SHARE * np.quantile(cosines, 0.01)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid), rejected. One narrow pass; the model is of fixed size."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            rows = [model.predict(t) for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
