"""Token-id files in Simple-8b: word-aligned packing of ids, with escapes and per-block offsets.

A payload holds the ids of a run of documents:

    magic "S8B1" | u32 number of documents | u32 number of blocks | u64 number of ids
    u32[documents] ids of each document | u32[blocks + 1] offset of each block, in words | u64[...] words

Every block has BLOCK ids (the last one what is left). A word's top four bits select how many ids of which
width it holds; selector 0 is the escape: the next word is one id as it is (for ids of 61 to 64 bits). Blocks
start at a word of their own, so each is decoded alone, and all words of a payload are decoded together, one
vector operation for each selector.

The files are Parquet containers (they can lie in any store that Spark writes): a row is a payload with its
shard, its place in the shard, its document ids and their number of token ids. Shards and rows follow the
ascending document id, equal ids by text; null ids come first.

Null and empty texts have the end id alone. Repeated rows are written as often as they occur. Empty tables give
an empty file set. Texts are encoded whole, cut only where the tokenizer cuts too.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, mix64, shared_folder, small_batches, texts

MAGIC = b"S8B1"
BLOCK = 1024
#: (ids in a word, bits of each) by selector; selector 0 is the escape.
SELECTORS = ((1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
#: Words whose ids a Python worker remembers (about 40 bytes each).
REMEMBERED = 900_000


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset of each block and of the end, in words)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    room = block - np.arange(n) % block  # ids left in the block
    room = np.minimum(room, n - np.arange(n)).astype(np.int16)
    # the selector for a word that starts at each id: the first whose ids all fit; short ends are padded
    choice = np.zeros(n, np.uint8)
    for s, (count, bits) in reversed(list(enumerate(SELECTORS))[1:]):
        low = np.flatnonzero(ids < np.uint64(1 << bits))
        if not len(low):
            break
        # ids that fit come in runs; the densest selector is set last and stays
        last = np.append(np.flatnonzero(low[1:] - low[:-1] != 1), len(low) - 1)
        run_end = np.repeat(low[last] + 1, np.diff(last, prepend=-1))
        choice[low[run_end - low >= np.minimum(room[low], count)]] = s
    step = np.minimum(np.array([c for c, _ in SELECTORS], np.int16)[choice], room).astype(np.int64)
    # all blocks go forward together
    at = np.arange(0, n, block)
    ends = np.minimum(at + block, n)
    begins, block_of = [], []
    alive = np.arange(len(at))
    while len(alive):
        begins.append(at[alive])
        block_of.append(alive)
        at[alive] += step[at[alive]]
        alive = alive[at[alive] < ends[alive]]
    begin = np.concatenate(begins)
    order = np.argsort(begin, kind="stable")
    begin, owner = begin[order], np.concatenate(block_of)[order]
    picked = choice[begin]
    size = 1 + (picked == 0)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(picked == s)
        if not len(mine):
            continue
        if s == 0:
            words[place[mine] + 1] = ids[begin[mine]]
            continue
        held = step[begin[mine]]
        word = np.full(len(mine), np.uint64(s) << np.uint64(60), np.uint64)
        for j in range(count):
            has = held > j
            value = ids[np.minimum(begin[mine] + j, n - 1)]
            word |= np.where(has, value << np.uint64(j * bits), np.uint64(0))
        words[place[mine]] = word
    sizes = np.bincount(owner, weights=size, minlength=len(ends)).astype(np.int64)
    return words, np.concatenate(([0], np.cumsum(sizes))).astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of all blocks."""
    if not n:
        return np.zeros(0, np.uint64)
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    # a word after an escape is a value; values can look like escapes, so escapes are resolved in order
    zero = np.flatnonzero(selector == 0)
    value = np.zeros(len(words), bool)
    for i in zero.tolist():
        if not value[i]:
            value[i + 1] = True
    counts = np.array([c for c, _ in SELECTORS] + [0], np.int64)
    kind = np.where(value, len(SELECTORS), selector)
    held = counts[kind]
    # the last word of a block may hold fewer than its selector says
    first = np.asarray(offsets[:-1], np.int64)
    begin = np.cumsum(held) - held
    blocks = np.repeat(np.arange(len(first)), np.diff(np.asarray(offsets, np.int64)))
    begin = begin - begin[first][blocks] + blocks * block
    end = np.minimum((blocks + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(kind == s)
        if not len(mine):
            continue
        if s == 0:
            out[begin[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << bits) - 1)
        for j in range(count):
            here = begin[mine] + j
            ok = here < end[mine]
            out[here[ok]] = (words[mine[ok]] >> np.uint64(j * bits)) & mask
    return out


def payload(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    return b"".join((MAGIC, struct.pack("<IIQ", len(lengths), len(offsets) - 1, len(ids)), lengths.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()))


def parse(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each document, all ids)."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b payload")
    docs, blocks, n = struct.unpack_from("<IIQ", data, 4)
    at = 20
    lengths = np.frombuffer(data, "<u4", docs, at)
    offsets = np.frombuffer(data, "<u4", blocks + 1, at + 4 * docs)
    words = np.frombuffer(data, "<u8", int(offsets[-1]), at + 4 * docs + 4 * blocks + 4)
    return lengths, unpack(words, offsets, n)


#: 0: of a word, 1: space, 2: line feed, 3: other white space or \\x00
_CLASS = np.zeros(256, np.uint8)
_CLASS[32], _CLASS[10], _CLASS[[0, 9, 11, 12, 13, 28, 29, 30, 31]] = 1, 2, 3
_RANDOM = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Longer words are not remembered, as a polynomial hash modulo 2**64 is weak for long ones.
LONGEST = 128


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _odd_space(b: np.ndarray) -> np.ndarray:
    """Where a white-space character of more than one UTF-8 byte starts."""
    lead = np.flatnonzero((b == 0xC2) | ((b >= 0xE1) & (b <= 0xE3)))
    lead = lead[lead + 1 < len(b)]
    x, y, z = b[lead], b[lead + 1], b[np.minimum(lead + 2, len(b) - 1)]
    two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
    three = (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    e2 = (x == 0xE2) & ((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (y == 0x81) & (z == 0x9F))
    return lead[two | three | e2]


class Encoder:
    """Ids of texts by a tokenizer file of the tokenizers library.

    In a text whose white space is single spaces and line feeds between other characters, a byte-level
    pre-tokenizer always cuts before a space and around a line feed. There the ids of words (with the space before
    them) are remembered under a 64-bit hash and put together with vector operations; words that are new are
    encoded in one call, a line feed between them. Other texts are encoded as they are, and so are those that hold an added
    token of the file, as the library finds it before it cuts."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(added)) if added else None
        self.feed = self.whole("\n")
        self._forget()

    def _forget(self) -> None:
        self.hash, self.at, self.n, self.hits = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each)"""
        got = self.whole("\n".join(words))
        cuts = np.flatnonzero(got == self.feed[0])
        if len(self.feed) == 1 and len(cuts) == len(words) - 1:
            edges = np.concatenate(([-1], cuts, [len(got)]))
            return np.delete(got, cuts), np.diff(edges) - 1
        each = [self.whole(w) for w in words]  # a tokenizer that cuts in another way
        return np.concatenate(each), np.array([len(x) for x in each])

    def _learn(self, hashes: np.ndarray, words: list[str], used: np.ndarray) -> None:
        """hashes: ascending, none known; used: places of known words that are needed now and stay, at whatever number"""
        if len(self.hits) and len(self.hash) + len(hashes) > REMEMBERED:
            needed = np.zeros(len(self.hits), bool)
            needed[used] = True
            kept = np.flatnonzero(needed | (self.hits >= min(2, np.partition(self.hits, len(self.hits) // 2)[len(self.hits) // 2] + 1)))
            kept = kept if len(kept) + len(hashes) <= REMEMBERED else np.flatnonzero(needed)
            ids, _ = _gather(self.ids, self.at[kept], self.n[kept])
            self.hash, self.n, self.ids, self.hits = self.hash[kept], self.n[kept], ids, np.zeros(len(kept), np.int64)
            self.at = np.cumsum(self.n) - self.n
        ids, n = self._encode_words(words)
        at = np.searchsorted(self.hash, hashes)
        self.at = np.insert(self.at, at, len(self.ids) + np.cumsum(n) - n)
        self.hash, self.n, self.hits = np.insert(self.hash, at, hashes), np.insert(self.n, at, n), np.insert(self.hits, at, 0)
        self.ids = np.concatenate((self.ids, ids))

    def batch(self, many: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids), end_id after each text. Texts go in groups of a few MB."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        group: list[bytes] = []
        size = 0
        for t in many:
            raw = t.encode("utf-8", "surrogatepass")
            if group and size + len(raw) > 1 << 21:
                out.append(self._group(group, end_id))
                group, size = [], 0
            group.append(raw)
            size += len(raw)
        if group:
            out.append(self._group(group, end_id))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _group(self, raw: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        b = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        size = np.array([len(x) for x in raw])
        ends = np.cumsum(size + 1) - 1  # of the zero after each text
        kind = _CLASS[b]
        kind[ends] = 4
        word = kind == 0
        before = np.concatenate(([False], word[:-1]))
        after = np.concatenate((word[1:], [False]))
        # texts with other white space, or with white space that has no word on either side
        odd = np.concatenate((np.flatnonzero((kind == 3) | ((kind == 1) | (kind == 2)) & ~(before & after)), _odd_space(b)))
        text = b.tobytes()
        if self.added:
            odd = np.append(odd, np.array([m.start() for m in self.added.finditer(text)], np.int64))
        slow = np.zeros(len(raw), bool)
        slow[np.searchsorted(ends, odd)] = True
        start = np.flatnonzero(word & ~before | (kind == 2))
        stop = np.flatnonzero(word & ~after | (kind == 2)) + 1
        long = stop - start > LONGEST
        slow[np.searchsorted(ends, start[long])] = True
        owner = np.searchsorted(ends, start)
        fast = ~slow[owner]
        start, stop, owner = start[fast], stop[fast], owner[fast]
        up, down = _powers(1 << max(22, (len(b) + 1).bit_length()))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_RANDOM[b] * up[: len(b)], dtype=np.uint64)))
        h = mix64((total[stop] - total[start]) * down[start])
        spaced = (start > 0) & (b[np.maximum(start, 1) - 1] == 32)
        h ^= np.where(spaced, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        unique, first, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.hash, unique)
        new = np.ones(len(unique), bool)
        if len(self.hash):
            new = self.hash[np.minimum(at, len(self.hash) - 1)] != unique
        if new.any():
            which = first[new]
            feeds = kind[start[which]] == 2
            words = [text[s - lead : e].decode("utf-8", "surrogatepass") for s, e, lead in zip(start[which].tolist(), stop[which].tolist(), (spaced[which] & ~feeds).tolist())]
            self._learn_mixed(unique[new], words, feeds, at[~new])
            at = np.searchsorted(self.hash, unique)
        ids, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(unique):
            self.hits[at] += times
            ids, n = _gather(self.ids, self.at[at][inverse], self.n[at][inverse])
        lengths = np.bincount(owner, weights=n, minlength=len(raw)).astype(np.int64)
        parts = {i: self.whole(raw[i].decode("utf-8", "surrogatepass")) for i in np.flatnonzero(slow).tolist()}
        for i, x in parts.items():
            lengths[i] = len(x)
        final = np.cumsum(lengths + 1)
        out = np.zeros(int(final[-1]), np.uint32)
        hole = np.zeros(len(out), bool)
        out[final - 1], hole[final - 1] = end_id, True
        for i, x in parts.items():
            a = final[i] - 1 - len(x)
            out[a : a + len(x)], hole[a : a + len(x)] = x, True
        out[~hole] = ids
        return lengths + 1, out

    def _learn_mixed(self, hashes: np.ndarray, words: list[str], feeds: np.ndarray, used: np.ndarray) -> None:
        plain = np.flatnonzero(~feeds)
        if len(plain):
            self._learn(hashes[plain], [words[i] for i in plain.tolist()], used)
        for i in np.flatnonzero(feeds).tolist():
            at = np.searchsorted(self.hash, hashes[i : i + 1])
            self.at, self.n = np.insert(self.at, at, len(self.ids)), np.insert(self.n, at, len(self.feed))
            self.hash, self.hits = np.insert(self.hash, at, hashes[i]), np.insert(self.hits, at, 0)
            self.ids = np.concatenate((self.ids, self.feed))


def _gather(ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ids[at : at + n], one after the other, and n."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(n) else 0
    return ids[np.repeat(at - (ends - n), n) + np.arange(total)], n


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


FILE = "shard int, seq int, n_docs int, n_ids long, doc_ids array<long>, payload binary"
_FILE = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])


def write_token_files(docs: DataFrame, to: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encodes every whole text with the tokenizer file, appends end_id, and writes shards in ascending id order.
    One shuffle, of the texts by ranges of the id; a task holds one batch of rows."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seq = _encoder(tokenizer), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, ids = encoder.batch(column(batch, "text"), end_id)
            row = [batch.column(2)[0].as_py()], [seq], [len(lengths)], [len(ids)], [batch.column(0).to_pylist()], [payload(lengths, ids)]
            seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(row, _FILE)], schema=_FILE)

    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())
    rows.mapInArrow(run, FILE).write.option("compression", "uncompressed").parquet(to)


#: The starts of so many payloads are broadcast (24 bytes each); beyond that they are joined by shuffling.
BROADCAST_PAYLOADS = 1_000_000


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (little-endian
    u32 bytes), decoded from the files. Without ids nothing but numbers is joined to the starts."""
    files = spark.read.parquet(path)
    small_batches(spark, 256)
    # a few numbers for each payload: what stands before it
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = files.select("shard", "seq", (F.sum("n_ids").over(W.partitionBy("shard").orderBy("seq")) - F.col("n_ids")).alias("seq_start"))
    starts = within.join(before, "shard").select("shard", "seq", (F.col("shard_start") + F.col("seq_start")).alias("base"))
    out = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("seq", pa.int32()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, seq, doc_ids, data in zip(*(column(batch, c) for c in ("shard", "seq", "doc_ids", "payload"))):
                lengths, ids = parse(data)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths, dtype=np.int64)
                local = ends - lengths
                cols = doc_ids, [shard] * len(ends), [seq] * len(ends), local, lengths, [raw[4 * a : 4 * b] for a, b in zip(local.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out)], schema=out)

    decoded = files.select("shard", "seq", "doc_ids", "payload").mapInArrow(run, "doc_id long, shard int, seq int, local long, n_tokens long, ids binary")
    decoded = decoded.withColumn("ids_crc32", F.crc32("ids"))
    if not with_ids:
        decoded = decoded.drop("ids")
    if files.count() <= BROADCAST_PAYLOADS:
        starts = F.broadcast(starts)
    return decoded.join(starts, ["shard", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_files(docs: DataFrame, tokenizer: str, with_ids: bool = True, **more) -> DataFrame:
    """Writes the files into a shared folder and returns what read_token_files() finds there."""
    to = shared_folder(docs.sparkSession)
    write_token_files(docs, to, tokenizer, **more)
    return read_token_files(docs.sparkSession, to, with_ids)
