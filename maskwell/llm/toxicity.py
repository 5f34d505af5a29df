"""Toxicity: a convolutional text classifier, trained in numpy.

Words have hashed embeddings: a table of the 32-bit hashes of words and word beginnings that occur in MIN_DOCS
training texts or more; a word outside it takes its longest known beginning, else the zero vector, so that new
words are neutral. Filters of several widths run over the sequence of words, each is max-pooled over the whole text, and a logistic layer scores the pooled values. Training: Adam on balanced
minibatches of windows of the labelled texts; the embedding's first direction starts at the words' log-odds, all else at
random values (lift: with few toxic texts random values alone are learned from too slowly). Scores are calibrated: a threshold is chosen for each language
guess on a part of the training rows that was kept aside, and scores are moved so that 0.5 stands for it. The
language guess is learned from the training texts alone: their shares of the COMMON most widespread words are clustered
into LANGS groups at most, and a text is of the nearest one. The lang column is never read.

A convolution over words is a sum of rows of tables (embedding times filter slice), so scoring is a few table
look-ups for each word and a running maximum; texts are scored whole, in blocks of words.

The training sample is bounded by MAX_TRAIN labelled ids for each label (a documented parameter; ids with the
lowest hash are taken). A label that is repeated counts once, an id with both labels is left out, and of different texts
of an id the one with the least hash is taken. Without labels of both kinds the score is 0.5 - epsilon for each text.

Null and empty texts count as texts without words and have a score like any other. Repeated rows have equal
scores. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, column, plain_words, small_batches, texts, tidied
from .langid import kmeans

#: Labelled rows of either label that the model is fitted on, at most.
MAX_TRAIN = 2000
MIN_DOCS = 4
EMBEDDING = 12
#: Lengths in bytes of the word beginnings, longest first.
PREFIXES = (6, 5, 4)
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Clean training texts are cut into samples of so many words; toxic ones stay whole, as only some words make them so.
TRAIN_WORDS = 4096
EPOCHS = 6

#: Words by which the language of a text is guessed, and groups of texts, for calibration only.
COMMON, LANGS = 64, 8


def hashes(word: bytes) -> tuple[int, ...]:
    """Hashes of the word and of its beginnings, longest first; 0 for one that is too short."""
    import xxhash

    return (xxhash.xxh32_intdigest(word) or 1, *((xxhash.xxh32_intdigest(b"^" + word[:n]) or 1) if len(word) > n else 0 for n in PREFIXES))


class Raw(dict):
    """word -> hashes()"""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        h = self[word] = hashes(word)
        return h


class Rows(WordHasher):
    """word -> row of the embedding table; 0 for unknown words."""

    def __init__(self, known: np.ndarray):
        self.known = dict(zip(known.tolist(), range(1, len(known) + 1)))

    def __missing__(self, word: bytes) -> int:
        row = self[word] = next((r for h in hashes(word) if (r := self.known.get(h))), 0)
        return row

    def ids(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.int32, count=len(ws))


@dataclass
class Languages:
    """Groups of texts by their most widespread words. place: row of the embedding table -> number of the word, -1 for others."""

    place: np.ndarray
    centres: np.ndarray

    def vector(self, ids: np.ndarray) -> np.ndarray:
        v = np.sqrt(np.bincount(self.place[ids] + 1, minlength=COMMON + 1)[1:]).astype(np.float32)
        n = np.linalg.norm(v)
        return v / n if n else v

    def of(self, ids: np.ndarray) -> int:
        """The nearest group; the first where there is no such word."""
        return int((self.centres @ self.vector(ids)).argmax())


def find_languages(samples: list[np.ndarray], rows: int, seed: int) -> Languages:
    """samples: rows of the words of the texts."""
    spread = np.zeros(rows, np.int64)
    for ids in samples:
        spread[np.unique(ids)] += 1
    spread[0] = 0
    top = np.argsort(-spread, kind="stable")[:COMMON]
    place = np.full(rows, -1, np.int64)
    place[top[spread[top] > 0]] = np.flatnonzero(spread[top] > 0)
    languages = Languages(place, np.zeros((1, COMMON), np.float32))
    x = np.array([languages.vector(ids) for ids in samples], np.float32).reshape(-1, COMMON)
    x = x[x.any(axis=1)]
    if len(x):
        languages.centres = kmeans(x, LANGS, seed)
    return languages


@dataclass
class Model:
    known: np.ndarray  # hash of each row but the first
    tables: list[np.ndarray]  # for each width: [width, rows, FILTERS], embedding times filter slice
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float
    languages: Languages | None = None
    shift: np.ndarray = field(default_factory=lambda: np.zeros(1))  # added to the logit, by language guess
    BLOCK = 1 << 14

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """Maxima of all filters over the whole text."""
        pad = max(WIDTHS) - 1
        ids = np.concatenate((np.zeros(pad, np.int32), ids, np.zeros(pad, np.int32)))
        out = np.full((len(WIDTHS), FILTERS), -np.inf, np.float32)
        for a in range(0, max(1, len(ids) - pad), self.BLOCK):
            part = ids[a : a + self.BLOCK + pad]
            for k, w in enumerate(WIDTHS):
                n = len(part) - w + 1
                x = self.tables[k][0][part[:n]]
                for j in range(1, w):
                    x += self.tables[k][j][part[j : j + n]]
                np.maximum(out[k], x.max(axis=0), out=out[k])
        return np.maximum(out + np.stack(self.bias), 0).ravel()

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids) @ self.weight + self.offset)

    def score(self, ids: np.ndarray) -> float:
        z = self.logit(ids) + (self.shift[self.languages.of(ids)] if self.languages else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def backed_off(known: np.ndarray, raw: np.ndarray, skip_word: np.ndarray | None = None) -> np.ndarray:
    """Rows for [words, 1 + PREFIXES] hashes: the first known one; skip_word: words that must take a beginning."""
    out = np.zeros(len(raw), np.int32)
    for j in reversed(range(raw.shape[1])):
        at = np.searchsorted(known, raw[:, j])
        hit = known[np.minimum(at, len(known) - 1)] == raw[:, j] if len(known) else np.zeros(len(raw), bool)
        if j == 0 and skip_word is not None:
            hit &= ~skip_word
        out[hit] = at[hit] + 1
    return out


def fit(raw: list[np.ndarray], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS, min_docs: int = MIN_DOCS, lift: bool = True) -> Model:
    """raw: hashes of the words of each text, [words, 1 + PREFIXES]. One row in five is kept aside for calibration;
    a word in four is seen as its beginning, so that beginnings learn too."""
    rng = np.random.default_rng(seed)
    each = [np.unique(r) for i, r in enumerate(raw) if i % 5 != 4]
    known, n = np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint32),) * 2
    known = known[(n >= min_docs) & (known > 0)]
    samples = [backed_off(known, r, rng.random(len(r)) < 0.25 if i % 5 != 4 else None) for i, r in enumerate(raw)]
    BUCKETS = len(known) + 1
    labels = np.asarray(labels, np.float32)
    aside = np.arange(len(labels)) % 5 == 4
    train = np.flatnonzero(~aside)
    pos, neg = train[labels[train] > 0], train[labels[train] == 0]
    E = (rng.standard_normal((BUCKETS, EMBEDDING)) * 0.1).astype(np.float32)
    E[0] = 0
    C = [(rng.standard_normal((w, EMBEDDING, FILTERS)) / np.sqrt(w * EMBEDDING)).astype(np.float32) for w in WIDTHS]
    params = {"E": E, "v": (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32), "c": np.zeros(1, np.float32)} | {f"C{k}": c for k, c in enumerate(C)} | {f"b{k}": np.zeros(FILTERS, np.float32) for k in range(len(WIDTHS))}
    if lift:  # words that tell the labels apart start with a direction of their own, so that max pooling finds them
        seen = np.zeros((2, BUCKETS), np.float32)
        for i, found in zip(train, each):
            at = np.searchsorted(known, found)
            hit = at < len(known)
            at, found = at[hit], found[hit]
            seen[int(labels[i] > 0), at[known[at] == found] + 1] += 1
        rate = (seen + 0.5) / (np.array([[len(neg)], [len(pos)]], np.float32) + 1)
        E[:, 0] = np.clip(np.log(rate[1] / rate[0]), -3, 3) * np.minimum(seen.sum(0) / (2 * min_docs), 1)
        E[0] = 0
        for c in C:
            c[:, 0, : FILTERS // 2] = np.abs(c[:, 0, : FILTERS // 2]) + 0.5
    m = {k: np.zeros_like(p) for k, p in params.items()}
    s = {k: np.zeros_like(p) for k, p in params.items()}
    step, half, pad = 0, 16, max(WIDTHS) - 1
    rounds = max(len(pos), len(neg)) // half + 1
    for epoch in range(epochs):
        order = [np.resize(rng.permutation(x), rounds * half) for x in (pos, neg)]
        for r in range(rounds):
            rows = np.concatenate([o[r * half : (r + 1) * half] for o in order])
            grads = {k: np.zeros_like(p) for k, p in params.items() if k != "E"}
            gE: list[tuple[np.ndarray, np.ndarray]] = []
            for i in rows:
                ids = samples[i]
                ids = np.concatenate((np.zeros(pad, np.int32), ids, np.zeros(pad, np.int32)))
                X = E[ids]
                pooled, where = [], []
                for k, w in enumerate(WIDTHS):
                    n = len(ids) - w + 1
                    z = X[:n] @ params[f"C{k}"][0]
                    for j in range(1, w):
                        z += X[j : j + n] @ params[f"C{k}"][j]
                    at = z.argmax(axis=0)
                    where.append(at)
                    pooled.append(z[at, np.arange(FILTERS)] + params[f"b{k}"])
                raw = np.concatenate(pooled)
                act = np.maximum(raw, 0)
                z = act @ params["v"] + params["c"][0]
                d = np.float32((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) / len(rows))
                grads["v"] += d * act
                grads["c"] += d
                back = d * params["v"] * (raw > 0)
                for k, w in enumerate(WIDTHS):
                    g = back[k * FILTERS : (k + 1) * FILTERS]
                    grads[f"b{k}"] += g
                    for j in range(w):
                        grads[f"C{k}"][j] += X[where[k] + j].T * g
                        gE.append((ids[where[k] + j], g[:, None] * params[f"C{k}"][j].T))
            step += 1
            lr = 0.01 * (1 - 0.8 * epoch / epochs)
            at = np.concatenate([a for a, _ in gE])
            touched, inverse = np.unique(at, return_inverse=True)
            total = np.zeros((len(touched), EMBEDDING), np.float32)
            np.add.at(total, inverse, np.concatenate([g for _, g in gE]))
            total[touched == 0] = 0
            for k, p in params.items():
                g, x = (total, touched) if k == "E" else (grads[k], ...)
                m[k][x] = 0.9 * m[k][x] + 0.1 * g
                s[k][x] = 0.999 * s[k][x] + 0.001 * g * g
                p[x] -= lr * (m[k][x] / (1 - 0.9**step)) / (np.sqrt(s[k][x] / (1 - 0.999**step)) + 1e-7)
    model = Model(known, [np.stack([E @ c for c in params[f"C{k}"]]) for k in range(len(WIDTHS))], [params[f"b{k}"] for k in range(len(WIDTHS))], params["v"], float(params["c"][0]))
    model.languages = find_languages([samples[i] for i in train], BUCKETS, seed)
    calibrate(model, [samples[i] for i in np.flatnonzero(aside)], labels[aside])
    return model


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best mean of both labels' accuracy, in the middle of its gap."""
    order = np.argsort(z)
    z, y = z[order], y[order] > 0
    kept = np.concatenate(([0], np.cumsum(~y))) / max(1, (~y).sum())  # negatives below the cut
    found = 1 - np.concatenate(([0], np.cumsum(y))) / max(1, y.sum())  # positives above it
    good = kept + found
    edges = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    middle = (edges[:-1] + edges[1:]) / 2
    real = np.concatenate(([True], z[1:] > z[:-1], [True]))
    best = np.flatnonzero(real & (good >= good[real].max() - 1e-9))
    return float(middle[best[np.argmin(np.abs(middle[best]))]])


def calibrate(model: Model, samples: list[np.ndarray], labels: np.ndarray, least: int = 30) -> None:
    """A threshold for each language guess; languages with few rows of a label take that of all rows."""
    n = len(model.languages.centres)
    model.shift = np.zeros(n)
    if not len(samples):
        return
    z = np.array([model.logit(x) for x in samples])
    lang = np.array([model.languages.of(x) for x in samples])
    y = labels > 0
    general = best_threshold(z, y) if y.any() and not y.all() else 0.0
    for i in range(n):
        mine = lang == i
        enough = min((y & mine).sum(), (~y & mine).sum()) >= least
        model.shift[i] = -(best_threshold(z[mine], y[mine]) if enough else general)


def train(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, seed: int = 7) -> Model | None:
    """usable: a condition on the id column that training rows meet. The sample is max_train rows of each label at most."""
    small_batches(docs.sparkSession)
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & usable).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = marks.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most")
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = None
    for y in (0, 1):  # top-k by hash: each task keeps max_train rows
        part = known.where(F.col("y") == y).orderBy(*order).limit(max_train).select("doc_id", "y")
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")).select("doc_id", "y", "least.text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, wide = Raw(), 1 + len(PREFIXES)
        for b in batches:
            ids = [np.array([h[w] for w in plain_words(t)], np.uint32).reshape(-1, wide) for t in column(b, "text")]
            # a very long text is cut to blocks, each a sample of its own if the label is 0; a toxic one stays whole
            out = []
            for d, x, y in zip(column(b, "doc_id"), ids, column(b, "y")):
                size = max(1, len(x)) if y else TRAIN_WORDS
                out += [(d, y, x[a : a + size].tobytes()) for a in range(0, max(1, len(x)), size)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([o[0] for o in out], pa.int64()), "y": pa.array([o[1] for o in out], pa.int32()), "ids": pa.array([o[2] for o in out], pa.binary())})
            h.clear()

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y").mapInArrow(run, "doc_id long, y int, ids binary").orderBy(F.xxhash64("doc_id"), "doc_id", "ids").toPandas()
    if got["y"].nunique() < 2:
        return None
    return fit([np.frombuffer(x, np.uint32).reshape(-1, 1 + len(PREFIXES)) for x in got["ids"]], got["y"].to_numpy(), seed)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score. One narrow pass over whole texts; the model (a few MB, bounded by the sample) goes to each task."""
    small_batches(docs.sparkSession)
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0.5 - 1e-9).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        h = Rows(model.known)
        for b in batches:
            s = [model.score(h.ids(plain_words(t))) for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])
            h.trim()

    return texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold. One narrow pass."""
    small_batches(docs.sparkSession)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        h = Rows(model.known)
        for b in batches:
            yield b.filter(pa.array([model.score(h.ids(plain_words(t or ""))) < threshold for t in column(b, text_col)], pa.bool_()))
            h.trim()

    return docs.mapInArrow(run, docs.schema)
