"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

Test items are short and documents long, so the MinHash of a whole document says little about an item in it.
Items are partitioned by their number of shingles (size classes with the bounds 8, 16, 32, ...). For the class
with the bound u a document is seen as windows of 2u shingles, one starting every u, so a passage of up to u
shingles lies in one window whole, and a containment of THRESHOLD or more becomes a Jaccard similarity of at
least THRESHOLD / (4 + 1 - THRESHOLD), 0.19. With HASHES bands of one hash each such a window is missed with a
probability below 4e-5. Minima of windows come from minima of blocks, and those of a class from the class below.

A window's minima are looked up in a bitmap of the items' minima (of bounded size; what passes wrongly falls out
in the join). Rows leave a task only for documents with such a hit: the hits, and those of its distinct shingles
that pass a bitmap of the items' shingles. Candidates are joined by class, hash number and minimum, and only for them
|document and item| / |item| is counted exactly, over the whole document.

Words: runs of letters, digits and non-ASCII characters, A-Z lower-cased; shingles of five. An item of two to four words
has one shingle, of all of them, and is found wherever they stand one after the other; one of a single word matches only
documents of that word. Null and empty texts and items match nothing. Of documents or items with the same id the pair that holds most
counts; repeated rows count once. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, column, plain_words, settle, shingles, small_batches, tidied

WIDTH = 5
THRESHOLD = 0.8
HASHES = 48
SMALLEST = 8
#: Size of the bitmaps in bits: 64 for each entry, between these bounds.
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 27

_ODD = np.random.default_rng(6).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def size_class(n: int) -> int:
    """0 for up to SMALLEST shingles, 1 for up to twice as many, ..."""
    return max(0, (n - 1).bit_length() - (SMALLEST - 1).bit_length())


def signature(s: np.ndarray) -> np.ndarray:
    return np.array([(s * a).min() for a in _ODD], np.uint64)


def window_minima(s: np.ndarray, sizes: np.ndarray, classes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(hash number, class, minima, owner) of the windows of documents whose shingles lie one after the other in s.
    owner: the number of the document that each window is of."""
    counts = [-(-sizes // SMALLEST)]
    for _ in range(classes - 1):
        counts.append(-(-counts[-1] // 2))
    starts, owners, lasts = [], [], []
    for c, n in enumerate(counts):
        owner = np.repeat(np.arange(len(n)), n)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        below = sizes if c == 0 else counts[c - 1]
        starts.append(np.repeat(np.cumsum(below) - below, n) + rank * (SMALLEST if c == 0 else 2))
        owners.append(owner)
        lasts.append(rank == np.repeat(n, n) - 1)
    for j, a in enumerate(_ODD):
        x = s * a
        for c in range(classes):
            x = np.minimum.reduceat(x, starts[c])
            after = np.concatenate((x[1:], x[-1:]))
            yield j, c, np.where(lasts[c], x, np.minimum(x, after)), owners[c]


def key_of(values: np.ndarray, j, c) -> np.ndarray:
    """The value of a minimum with its hash number and class mixed in."""
    number = np.atleast_1d(np.asarray(j, np.uint64) * np.uint64(64) + np.asarray(c, np.uint64) + np.uint64(1))
    return values ^ (np.uint64(0x9E3779B97F4A7C15) * number)


def bitmap(keys: DataFrame, col: str, rows: int) -> np.ndarray:
    """Bits set at the low bits of the keys; its size follows the rows within bounds. Bits meet as words of 64, so 2 million
    rows at most come to the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (64 * max(1, rows) - 1).bit_length()))
    out = np.zeros(bits // 64, np.uint64)
    word = F.expr(f"cast((`{col}` & {bits - 1}) >> 6 as int)").alias("word")
    got = keys.groupBy(word).agg(F.expr(f"bit_or(shiftleft(1L, cast(`{col}` & 63 as int)))").alias("bits")).toPandas()
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out.view(np.uint8)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def short_shingles(words: np.ndarray, widths: list[int]) -> np.ndarray:
    """Shingles of the widths of short items, but of a text's own length, which it has anyway."""
    return np.concatenate([np.zeros(0, np.uint64), *(shingles(words, w) for w in widths if len(words) > w)])


def item_table(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, item_id, n (distinct shingles), width (of a short item's shingle, else 0), cls, shingles, keys; item numbers the
    distinct rows. Cut from its lineage."""
    schema = pa.schema([("item_id", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("cls", pa.int32()), ("shingles", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = WordHasher()
        for b in batches:
            out = []
            for i, t in zip(column(b, "item_id"), column(b, "text")):
                words = h.array(plain_words(t))
                s = np.unique(shingles(words, WIDTH))
                if len(s):
                    c = size_class(len(s))
                    out.append((i, len(s), len(words) if 1 < len(words) < WIDTH else 0, c, s.view(np.int64), key_of(signature(s), np.arange(HASHES), c).view(np.int64)))
            cols = zip(*out) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(cols, schema)], schema=schema)
            h.trim()

    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    return settle(rows.mapInArrow(run, "item_id long, n int, width int, cls int, shingles array<long>, keys array<long>").withColumn("item", F.monotonically_increasing_id()))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item (distinct shingles of the item), n_common, containment: all pairs that were found with
    a containment of threshold or more."""
    spark = docs.sparkSession
    small_batches(spark)
    table = item_table(items, item_id_col, item_text_col)
    item_keys = table.select("item", F.explode("keys").alias("key"))
    size = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("cls"), F.lit(0))).first()
    widths = sorted(r.width for r in table.select("width").distinct().collect() if r.width)  # 2 to 4
    classes = size[2] + 1
    shared = spark.sparkContext.broadcast((bitmap(item_keys, "key", size[0] * HASHES), bitmap(table.select(F.explode("shingles").alias("shingle")), "shingle", size[1])))
    schema = pa.schema([("doc_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, (key_bits, shingle_bits) = WordHasher(), shared.value
        for b in batches:
            ids, each, short = [], [], []
            for i, t in zip(column(b, "doc_id"), column(b, "text")):
                words = h.array(plain_words(t))
                if len(words):
                    ids.append(i)
                    each.append(shingles(words, WIDTH))
                    short.append(short_shingles(words, widths) if widths else words[:0])
            h.trim()
            hits: dict[int, list[int]] = {}
            if each:
                s, sizes = np.concatenate(each), np.array([len(x) for x in each])
                for j, c, minima, owner in window_minima(s, sizes, classes):
                    keys = key_of(minima, j, c)
                    for w in np.flatnonzero(in_bitmap(key_bits, keys)).tolist():
                        hits.setdefault(int(owner[w]), []).append(int(keys[w].view(np.int64)))
            if widths:  # a short item has one shingle, whose first minimum is enough to find it
                for d, x in enumerate(short):
                    keys = key_of(x * _ODD[0], 0, 0)
                    hits.setdefault(d, []).extend(keys[in_bitmap(key_bits, keys)].view(np.int64).tolist())
            rows = []
            for d, keys in hits.items():
                if keys:
                    x = np.unique(np.concatenate((each[d], short[d])))
                    rows.append((ids[d], sorted(set(keys)), x[in_bitmap(shingle_bits, x)].view(np.int64)))
            cols = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(cols, schema)], schema=schema)

    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = settle(rows.mapInArrow(run, "doc_id long, keys array<long>, shingles array<long>").withColumn("row", F.monotonically_increasing_id()))
    candidates = found.select("row", F.explode("keys").alias("key")).join(item_keys, "key").select("row", "item").distinct()
    pairs = candidates.join(found.select("row", "doc_id", F.col("shingles").alias("theirs")), "row").join(table.select("item", "item_id", F.col("n").alias("n_item"), "shingles"), "item")
    common = F.size(F.array_intersect("theirs", "shingles")).cast("long")
    scored = pairs.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), common.alias("n_common")).withColumn("containment", F.col("n_common") / F.col("n_item")).where(F.col("containment") >= threshold)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_common", "n_item")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_item", "best.n_common", "best.containment")
