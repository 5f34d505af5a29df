"""LM scoring: a gated recurrent language model in numpy.

Tokens of a text: its words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end. The model reads a text token by
token; its state is carried across windows, from the first token to the end, so a score is the log-likelihood of the
whole document. The output is a class-factored softmax: p(group | state) * p(class | group, state) * p(word | class, state).

From all training texts: counts of all words (in a table, of any size), the number of tokens, and the counts of words in
each of GROUPS groups of texts. The most frequent words (those above a count that HEAD words at most exceed) are sent to
the tasks; all others are of the class of rare words, whose counts are joined, so no word is left out. Classes are
made of words of one group and of similar frequency, from FIRST of the most frequent words to LARGEST. In each of them the
word's softmax depends on the state: the logit is the log of the word's count, and the product of the state, a learned
matrix and the word's profile (how much more often than others it stands in each group of texts). In the class of rare words it is
(c + 1) / (n + v + 1), with one more word for all unknown ones.

The recurrent weights are learned by truncated backpropagation through WINDOW steps (Adam), from all training texts at
every size, each in one of ROUNDS rounds. In learning a text of more than PIECE tokens goes on in another slot, with a fresh
state; in scoring its state is carried from the first token to the last. Tasks learn on their texts from the same weights, and the weights
are averaged after each round. The groups come from k-means on the counts of the GROUP_WORDS commonest words in every training
text: the first centres are drawn from all of them, and all of them move the centres, MOVES times at most.

Texts are read side by side in slots; a slot takes up the next text when one ends, and slots without texts cost nothing, so
long texts hold up no others. In scoring the states of many windows meet before the softmax is taken.

Null and empty texts have the end alone. Repeated rows have equal results. Extra columns are not read. Without
training texts all counts are 0 and the score is that of an untrained model over one class.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, column, keep_memory, settle, small_batches, texts, tidied, words_of

HEAD = 1 << 17
GROUPS, GROUP_WORDS, MOVES = 6, 64, 8
#: Words of a group's first class, and of its largest; classes double in between.
FIRST, LARGEST = 32, 256
#: Classes of a block: a softmax over blocks and one over a block's classes cost less than one over all classes of a group.
BLOCK = 32
#: Of profiles: counts that each word is taken to have beside its own, and the largest value.
PRIOR, STEEPEST = 4.0, 4.0
HIDDEN = 16
#: Words with an input row of their own; others share that of their class.
INPUTS = 4096
WINDOW, SLOTS, PIECE = 32, 192, 1024
#: Bytes of the batches in which texts are taken apart, and words that a task counts at once.
JOIN, COUNTED = 1 << 22, 1 << 22
#: Tokens whose probabilities are taken at once in scoring.
MEET = 1 << 16
#: Rows whose softmax over classes is taken at once.
CHUNK = 1024
#: Logits up to which exponentials, and sums of them, are numbers of 32 bits.
REACH = 80.0
ROUNDS, TRAIN_SLOTS, RATE = 2, 32, 0.02
#: Tasks with many texts learn from up to WIDE of them side by side, one slot to DEEP texts, as that takes less time a token.
WIDE, DEEP = 384, 16
#: A task learns from about so many texts; there are LEAST to MOST tasks, whose weights are added up in SUMS tasks.
TEXTS_EACH, LEAST, MOST, SUMS = 6000, 6, 512, 4
LN10 = float(np.log(10))


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts of the common words, at length one."""
    v = np.sqrt(counts).astype(np.float32)
    n = np.linalg.norm(v)
    return v / n if n else v


@dataclass
class Groups:
    """Of texts, by the counts of the common words: the first `common` of the head."""

    common: int
    centres: np.ndarray

    def nearest(self, counts: np.ndarray) -> int:
        return int((self.centres @ unit(counts)).argmax())


def common_of(x: np.ndarray, common: int) -> np.ndarray:
    """Counts of the common words in a text's numbers."""
    return np.bincount(x[x < common], minlength=common)


def vectors_of(training: DataFrame, common: int) -> DataFrame:
    """v: the vectors of all texts (ids) that hold a common word, those of a batch in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [v for x in column(b, "ids") if (v := unit(common_of(unpacked(x), common))).any()]
            if found:
                yield pa.RecordBatch.from_pydict({"v": pa.array([np.stack(found).tobytes()], pa.binary())})

    return training.select("ids").mapInArrow(run, "v binary")


def added_up(parts: DataFrame) -> np.ndarray | None:
    """The sum of the arrays of 64-bit integers or floats in parts (row: kind, x), by way of SUMS tasks, so that the driver gets
    few rows of however many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = None, None
        for b in batches:
            for kind, x in zip(column(b, "kind"), column(b, "x")):
                x = np.frombuffer(x, kind)
                total = x.astype(f"{kind[:2]}8") if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"kind": pa.array([total.dtype.str]), "x": pa.array([total.tobytes()], pa.binary())})

    schema = "kind string, x binary"
    got = parts.repartition(SUMS).sortWithinPartitions("x").mapInArrow(run, schema).collect()
    return sum(np.frombuffer(r.x, r.kind) for r in sorted(got, key=lambda r: bytes(r.x))) if got else None


def find_groups(vectors: DataFrame, common: int, seed: int = 3) -> Groups:
    """k-means over all vectors: each pass reads their table, and a task gives one row."""
    width = common

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.frombuffer(v, np.float32) for v in column(b, "v")]).reshape(-1, width)

    def draw(centres: np.ndarray) -> np.ndarray | None:
        """A vector, drawn by its distance to the nearest centre: that of the least -log(u) / distance, u uniform."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = (np.inf, None)
            for b in batches:
                x = matrix(b)
                u = np.random.default_rng([seed, len(centres), zlib.crc32(x.tobytes())]).random(len(x))
                far = np.maximum(1 - (x @ centres.T).max(axis=1), 0) if len(centres) else np.ones(len(x))
                key = np.where(far > 1e-6, -np.log(1 - u) / np.maximum(far, 1e-6), np.inf)
                i = int(key.argmin())
                if key[i] < best[0]:
                    best = key[i], x[i].tobytes()
            if best[1]:
                yield pa.RecordBatch.from_pydict({"key": pa.array([best[0]]), "v": pa.array([best[1]], pa.binary())})

        got = vectors.mapInArrow(run, "key double, v binary").orderBy("key", "v").limit(1).collect()
        return np.frombuffer(got[0].v, np.float32) if got else None

    def members(centres: np.ndarray) -> np.ndarray:
        """For each centre the sum of its vectors, and their number."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centres), width + 1))
            for b in batches:
                x = matrix(b)
                mine = np.eye(len(centres), dtype=np.float32)[(x @ centres.T).argmax(axis=1)]
                total[:, :width] += mine.T @ x
                total[:, width] += mine.sum(axis=0)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([total.dtype.str]), "x": pa.array([total.tobytes()], pa.binary())})

        return added_up(vectors.mapInArrow(run, "kind string, x binary")).reshape(-1, width + 1)

    centres = np.zeros((0, width), np.float32)
    while width and len(centres) < GROUPS and (x := draw(centres)) is not None:
        centres = np.vstack((centres, x))
    if len(centres) < 2:
        return Groups(common, np.zeros((1, width), np.float32))
    before = None
    for _ in range(MOVES):
        total = members(centres)
        some = total[:, width] > 0
        centres = centres.copy()
        centres[some] = total[some, :width]
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        if before is not None and (before == total[:, width]).all():
            break
        before = total[:, width]
    return Groups(common, centres)


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(how many words each text has, the words of all of them): those of words_of(), by Arrow's kernels. No text is null."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    real = np.asarray(pc.binary_length(words)) > 0  # the kernel gives empty ones where a text begins or ends with space
    at = np.concatenate(([0], np.cumsum(real)))[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    return np.diff(at), words.filter(pa.array(real))


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of JOIN bytes, if there are so many: what a step does once a batch costs little then."""
    some, size = [], 0

    def together() -> pa.RecordBatch:
        out = pa.Table.from_batches(some).combine_chunks().to_batches()
        some.clear()
        return out[0]

    for b in batches:
        if len(b):
            some.append(b)
            size += b.nbytes
        if size > JOIN:
            yield together()
            size = 0
    if some:
        yield together()


def count_words(docs: DataFrame) -> DataFrame:
    """word, c over all texts of docs (text)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            total = pc.value_counts(pa.chunked_array(waiting))
            waiting.clear()
            return pa.RecordBatch.from_pydict({"word": total.field("values").cast(pa.binary()), "n": total.field("counts")})

        for b in joined(batches):
            waiting.append(words_in(b.column("text"))[1])
            if sum(map(len, waiting)) > COUNTED:
                yield flush()
        if waiting:
            yield flush()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def group_counts(training: DataFrame, k: int, groups: Groups) -> np.ndarray:
    """[k, groups]: how often each of the k words of the head stands in all training texts (ids) of each group."""
    n_groups = len(groups.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, n = np.zeros((n_groups, k), np.int64), [[] for _ in range(n_groups)], 0

        def count() -> None:
            for g, some in enumerate(waiting):
                if some:
                    total[g] += np.bincount(np.concatenate(some), minlength=k + 2)[:k]
                    some.clear()

        for b in batches:
            for packed in column(b, "ids"):
                x = unpacked(packed)
                waiting[groups.nearest(common_of(x, groups.common))].append(x)
                n += len(x)
            if n > 1 << 20:
                count()
                n = 0
        count()
        kind = "<i4" if total.max(initial=0) < 1 << 31 else "<i8"
        yield pa.RecordBatch.from_pydict({"kind": pa.array([kind]), "x": pa.array([total.astype(kind).tobytes()], pa.binary())})

    got = added_up(training.select("ids").mapInArrow(run, "kind string, x binary")) if k else None
    return np.zeros((k, n_groups), np.int64) if got is None else np.ascontiguousarray(got.reshape(n_groups, k).T)


@dataclass
class Vocabulary:
    """Words of the head by number; then the rare one and the end."""

    words: list[bytes]
    count: np.ndarray
    group: np.ndarray
    by_group: np.ndarray  # [words, groups]
    n_tokens: int  # training tokens, ends included
    n_types: int  # distinct ones, the end included
    n_docs: int

    def __post_init__(self) -> None:
        k = len(self.words)
        self.rare, self.end = k, k + 1
        cls = np.zeros(k + 2, np.int32)
        n, self.spans = 0, []  # blocks of a group's classes; the rare ones and the end are blocks of their own
        for g in np.unique(self.group).tolist():
            mine = np.flatnonzero(self.group == g)  # by descending count
            at, size, begin = 0, FIRST, n
            while at < len(mine):
                cls[mine[at : at + size]] = n
                at, size, n = at + size, min(2 * size, LARGEST), n + 1
            self.spans += [(a, min(a + BLOCK, n)) for a in range(begin, n, BLOCK)]
        cls[self.rare], cls[self.end] = n, n + 1
        self.spans += [(n, n + 1), (n + 1, n + 2)]
        self.top = np.repeat(np.arange(len(self.spans)), [b - a for a, b in self.spans])
        self.cls, self.classes = cls, n + 2
        head = int(self.count.sum())
        self.rare_tokens = self.n_tokens - self.n_docs - head
        self.rare_types = max(0, self.n_types - (self.n_docs > 0) - k)
        counts = np.concatenate((self.count, [self.rare_tokens + 1, self.n_docs + 1])).astype(np.float64)
        self.class_count = np.bincount(cls, weights=counts, minlength=self.classes)
        # words of the head by class: their places, log counts and profiles
        order = np.argsort(cls[:k], kind="stable")
        size = np.bincount(cls[:k], minlength=self.classes)
        self.begin = np.concatenate(([0], np.cumsum(size)))
        self.place = np.zeros(k + 2, np.int32)
        self.place[order] = np.arange(k) - np.repeat(self.begin[:-1], size)
        self.log_count = np.log(self.count[order]).astype(np.float32)
        share = np.maximum(self.by_group.sum(axis=0), 1e-9).astype(np.float64)
        share /= share.sum()
        own = self.by_group[order] + PRIOR * share
        profile = np.log(own / own.sum(axis=1, keepdims=True) / share)
        self.profile = np.clip(profile, -STEEPEST, STEEPEST).astype(np.float32)
        # one product with (z, 1) gives a class's logits, one of their exponentials with (profile, 1) what the gradient needs
        across = np.column_stack((self.profile, self.log_count))
        self.across = [np.ascontiguousarray(across[a:b].T) for a, b in zip(self.begin[:-1], self.begin[1:])]  # by class
        self.beside = np.column_stack((self.profile, np.ones(k, np.float32)))
        self.ones = np.ones(k, np.float32)
        self.order = cls.astype(np.int16) if self.classes < 1 << 15 else cls  # sorted faster
        # rows of the input table: frequent words, then classes, then the start
        self.row = np.where(np.arange(k + 2) < min(k, INPUTS), np.arange(k + 2), min(k, INPUTS) + cls).astype(np.int32)
        self.start = min(k, INPUTS) + self.classes
        self.rows = self.start + 1

    def base(self) -> np.ndarray:
        """log10((c + 1) / (N + V + 1)) of head words; the numerator is left out for rare ones."""
        c = np.concatenate((self.count, [0, self.n_docs]))
        return np.log10(c + 1.0) - np.log10(self.n_tokens + self.n_types + 1.0)


class Ids(dict):
    """word -> number, rare if it is not of the head."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(zip(vocabulary.words, range(len(vocabulary.words))))


def initial(v: Vocabulary, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    tops = np.bincount(v.top, weights=v.class_count)
    p = {"X": f(v.rows, 3 * HIDDEN), "U": f(HIDDEN, 3 * HIDDEN) * 3, "C": f(HIDDEN, v.classes) * 0.3, "c": np.log(v.class_count / tops[v.top]).astype(np.float32)}
    p["T"], p["t"] = f(HIDDEN, len(tops)) * 0.3, np.log(tops / tops.sum()).astype(np.float32)
    p["X"][:, :HIDDEN] += 1  # the state is kept at first
    p["A"], p["a"] = f(HIDDEN, v.profile.shape[1]), np.zeros(v.profile.shape[1], np.float32)
    return p


def sigmoid(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    x = np.negative(x, out=out)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def forward(p: dict, v: Vocabulary, h: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, tuple]:
    """States after each step [T, B, HIDDEN], and what the backward pass needs. rows [T, B]: input rows; keep [T, B]: 0
    where a text starts."""
    out = np.empty((*rows.shape, HIDDEN), p["U"].dtype)
    U, H = p["U"], HIDDEN
    before, z, r, n, an = (np.empty((*rows.shape, H), U.dtype) for _ in range(5))
    keep = keep[:, :, None]
    # three arrays without gaps are faster than parts of one
    parts = [slice(k * H, (k + 1) * H) for k in range(3)]
    gz, gr, gn = (np.ascontiguousarray(p["X"][:, k]).take(rows, axis=0) for k in parts)
    uz, ur, un = (np.ascontiguousarray(U[:, k]) for k in parts)
    for t in range(len(rows)):
        h = np.multiply(h, keep[t], out=before[t])
        gz[t] += h @ uz
        gr[t] += h @ ur
        update, reset, a = sigmoid(gz[t], z[t]), sigmoid(gr[t], r[t]), np.matmul(h, un, out=an[t])
        new = np.multiply(reset, a, out=n[t])
        new += gn[t]
        np.tanh(new, out=new)
        h = np.subtract(h, new, out=out[t])
        h *= update
        h += new
    return out, (before, z, r, n, an)


def within(p: dict, v: Vocabulary, h: np.ndarray, words: np.ndarray, back: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(natural log-probability of each of the words, all of the head and sorted by class, in its class, gradient by its state's
    product with A). back: weights of the tokens; without them there is no gradient."""
    n = v.profile.shape[1]
    cls, z = v.cls[words], h @ p["A"] + p["a"]
    z = np.column_stack((z, np.ones(len(z), z.dtype)))
    word = v.begin[cls] + v.place[words]
    profile = v.profile.take(word, axis=0)
    lp = np.einsum("ij,ij->i", z[:, :n], profile) + v.log_count[word]
    # the largest logit is taken off only where an exponential could leave the range of numbers
    wild = len(z) > 0 and STEEPEST * np.abs(z[:, :n]).sum(axis=1).max() + v.log_count.max() > REACH
    total, sums = np.empty(len(z), z.dtype), np.empty_like(z)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(cls)) + 1, [len(cls)])).tolist() if len(cls) else [0]
    ends = v.begin.tolist()
    for a, b, k in zip(cuts, cuts[1:], cls[cuts[:-1]].tolist()):
        first, last = ends[k], ends[k + 1]
        x = z[a:b] @ v.across[k]
        if wild:
            top = x.max(axis=1)
            x -= top[:, None]
            lp[a:b] -= top
        np.exp(x, out=x)
        if back is None:
            np.matmul(x, v.ones[first:last], out=total[a:b])
        else:
            np.matmul(x, v.beside[first:last], out=sums[a:b])
    if back is None:
        return lp - np.log(total), None
    total = sums[:, n]
    return lp - np.log(total), (sums[:, :n] / total[:, None] - profile) * back[:, None]


def softmax(h: np.ndarray, C: np.ndarray, c: np.ndarray, pick: np.ndarray, back: np.ndarray | None = None) -> tuple:
    """(natural log-probability of what each row picks, gradients of C, of c and by the state), a CHUNK of rows at a time,
    which a processor's cache holds. h: states and a column of ones. back: weights of the rows; without them there is no
    gradient."""
    lp, n = np.empty(len(pick), h.dtype), len(C)
    both = np.vstack((C, c - c.max()))
    wild = len(h) > 0 and np.abs(h).max() * np.abs(C).sum(axis=0).max() > REACH / 2
    mine_of = np.ascontiguousarray(C.T)
    beside = np.column_stack((mine_of, np.ones_like(c)))
    ones = np.ones(C.shape[1], h.dtype)
    d, dh = (np.zeros_like(both), np.empty((len(h), n), h.dtype)) if back is not None else (None, None)
    for a in range(0, len(pick), CHUNK):
        part = slice(a, a + CHUNK)
        own = h[part]
        x = own @ both
        if wild:
            x -= x.max(axis=1, keepdims=True)
        mine = np.arange(len(x)), pick[part]
        picked = x[mine]
        np.exp(x, out=x)
        if back is None:
            lp[part] = picked - np.log(x @ ones)
            continue
        sums = x @ beside
        total = sums[:, n]
        lp[part] = picked - np.log(total)
        share = (back[part] / total)[:, None]
        dh[part] = sums[:, :n] * share - mine_of.take(pick[part], axis=0) * back[part, None]
        x[mine] -= total
        d += (own * share).T @ x
    return lp, *((d[:n], d[n]) if back is not None else (None, None)), dh


def by_class(v: Vocabulary, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of the targets by class, the targets so sorted, how many of them are words of the head: those come first)."""
    order = np.argsort(v.order[target], kind="stable")
    y = target[order]
    return order, y, int(np.searchsorted(v.cls[y], v.cls[v.rare]))


def of_classes(p: dict, v: Vocabulary, h: np.ndarray, cls: np.ndarray, back: np.ndarray | None = None) -> tuple[np.ndarray, dict, np.ndarray | None]:
    """(natural log-probability of each class given its state, gradients, gradient by the state): that of the class's block,
    and in it that of the class. The classes are sorted."""
    h = np.column_stack((h, np.ones(len(h), h.dtype)))
    lp, dT, dt, dh = softmax(h, p["T"], p["t"], v.top[cls], back)
    g = {"T": dT, "t": dt, "C": np.zeros_like(p["C"]), "c": np.zeros_like(p["c"])} if back is not None else {}
    for (a, b), first, last in zip(v.spans, *np.searchsorted(cls, np.array(v.spans).T).tolist()):
        if b - a > 1 and first < last:
            at = slice(first, last)
            more, dC, dc, d = softmax(h[at], p["C"][:, a:b], p["c"][a:b], cls[at] - a, None if back is None else back[at])
            lp[at] += more
            if back is not None:
                g["C"][:, a:b], g["c"][a:b] = dC, dc
                dh[at] += d
    return lp, g, dh


def log_prob(p: dict, v: Vocabulary, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log-probability of each target given its state (rare ones: of their class)."""
    order, y, n = by_class(v, target)
    h = h.take(order, axis=0)
    lp = of_classes(p, v, h, v.cls[y])[0].astype(np.float64)
    lp[:n] += within(p, v, h[:n], y[:n])[0]
    out = np.empty_like(lp)
    out[order] = lp
    return out


def gradients(p: dict, v: Vocabulary, h0: np.ndarray, rows: np.ndarray, keep: np.ndarray, target: np.ndarray, live: np.ndarray, full: int) -> tuple[dict, np.ndarray, float]:
    """(gradients, last state, loss) of one window; live [T, B]: 0 for places without a token. Gradients and loss are shares of
    a window of `full` tokens, so a window of few texts moves the weights less."""
    T, B, H = *rows.shape, HIDDEN
    states, trace = forward(p, v, h0, rows, keep)
    order, y, n_head = by_class(v, target.ravel())
    flat, weight = states.reshape(-1, H).take(order, axis=0), live.ravel()[order].astype(np.float32) / full
    lp, g, back = of_classes(p, v, flat, v.cls[y], weight)
    loss = -(lp * weight).sum()
    lp, dz = within(p, v, flat[:n_head], y[:n_head], weight[:n_head])
    loss -= (lp * weight[:n_head]).sum()
    g["A"], g["a"] = flat[:n_head].T @ dz, dz.sum(axis=0)
    back[:n_head] += dz @ p["A"].T
    dh_all = np.empty_like(back)
    dh_all[order] = back
    dh_all = dh_all.reshape(T, B, H)
    before, z, r, n, an = trace
    # all that does not depend on what comes back from later steps
    to_n, to_z, to_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), an * r * (1 - r)
    dX, da, dh = np.empty((T, B, 3 * H), np.float32), np.empty((T, B, 3 * H), z.dtype), np.zeros((B, H), np.float32)
    back = p["U"].T
    for t in reversed(range(T)):
        dh = dh + dh_all[t]
        d = da[t]
        dn = dX[t, :, 2 * H :] = dh * to_n[t]
        d[:, :H] = dh * to_z[t]
        d[:, H : 2 * H] = dn * to_r[t]
        d[:, 2 * H :] = dn * r[t]
        dh = (dh * z[t] + d @ back) * keep[t][:, None]
    dX[:, :, : 2 * H] = da[:, :, : 2 * H]
    g["U"] = before.reshape(-1, H).T @ da.reshape(-1, 3 * H)
    flat_rows = rows.ravel().astype(np.int16 if v.rows < 1 << 15 else np.int32)  # small numbers are sorted faster
    order = np.argsort(flat_rows, kind="stable")
    sorted_rows = flat_rows[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(sorted_rows)) + 1))
    touched = sorted_rows[first].astype(np.int64)
    dense = np.add.reduceat(dX.reshape(-1, 3 * H).take(order, axis=0), first, axis=0)
    g["X"] = (touched, dense)
    return g, states[-1], float(loss)


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.t += 1
        a, b = 1 - 0.9**self.t, 1 - 0.999**self.t
        for k, d in g.items():
            at, d = d if k == "X" else (..., d)
            d = np.clip(d, -1, 1)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * d
            self.s[k][at] = 0.999 * self.s[k][at] + 0.001 * d * d
            self.p[k][at] -= self.rate * (self.m[k][at] / a) / (np.sqrt(self.s[k][at] / b) + 1e-6)


class Slots:
    """Texts side by side: windows of [WINDOW, slots] tokens. Each text's numbers end with the end."""

    def __init__(self, v: Vocabulary, n: int):
        self.v, self.n = v, n
        #: of each slot, what waits: input row (of a text's start: its complement), target, owner of each token
        self.parts: list[deque] = [deque() for _ in range(n)]
        self.waiting = np.zeros(n, np.int64)

    def add(self, owner: int, ids: np.ndarray, before: int | None = None) -> None:
        """before: the token in front of the first one, if it is not the start of the text."""
        s = int(self.waiting.argmin())
        x = np.empty((len(ids), 3), np.int32)
        x[0, 0] = ~(self.v.start if before is None else self.v.row[before])
        x[1:, 0] = self.v.row[ids[:-1]]
        x[:, 1] = ids
        x[:, 2] = owner
        self.parts[s].append(x)
        self.waiting[s] += len(ids)

    def full(self) -> bool:
        return self.waiting.min() >= WINDOW

    def window(self) -> tuple[np.ndarray, ...]:
        """(slots that have tokens; input rows, keep, target, owner [WINDOW, those slots]); owner -1 where there is no token."""
        used = np.flatnonzero(self.waiting)
        out = np.empty((len(used), WINDOW, 3), np.int32)
        for k, s in enumerate(used.tolist()):
            at, parts = 0, self.parts[s]
            while parts and at < WINDOW:
                x = parts[0]
                n = min(len(x), WINDOW - at)
                out[k, at : at + n] = x[:n]
                at += n
                if n == len(x):
                    parts.popleft()
                else:
                    parts[0] = x[n:]
            if at < WINDOW:
                out[k, at:] = ~self.v.start, self.v.end, -1
        self.waiting[used] = np.maximum(self.waiting[used] - WINDOW, 0)
        rows, target, owner = np.ascontiguousarray(out.transpose(2, 1, 0))
        return used, np.where(rows < 0, ~rows, rows), (rows >= 0).astype(np.float32), target, owner


def numbers(v: Vocabulary | int, ids: dict[bytes, int], text: str) -> tuple[np.ndarray, list[bytes]]:
    """(numbers of the tokens, the words that are rare). v: the vocabulary, or the number of words of its head."""
    rare = v if isinstance(v, int) else v.rare
    words = words_of(text)
    x = np.fromiter(map(ids.get, words, repeat(rare)), np.int32, len(words))
    return np.append(x, np.int32(rare + 1)), [words[i] for i in np.flatnonzero(x == rare).tolist()]


def packed(x: np.ndarray) -> bytes:
    """Three bytes a number, first all low ones: most of the others are 0, so that they take little room compressed."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def unpacked(packed: bytes) -> np.ndarray:
    low, middle, high = np.frombuffer(packed, np.uint8).reshape(3, -1).astype(np.int32)
    return low | middle << 8 | high << 16


def rare_words(text: np.ndarray, words: pa.Array, n: int) -> tuple[pa.Array, pa.Array]:
    """Of each of n texts the different ones of its words, and how often each stands in it. text: of each word."""
    known = words.dictionary_encode()
    v = max(1, len(known.dictionary))
    pairs, times = np.unique(text * v + np.asarray(known.indices), return_counts=True)
    offsets = pa.array(np.searchsorted(pairs, np.arange(n + 1) * v), pa.int32())
    found = known.dictionary.take(pa.array(pairs % v)).cast(pa.binary())
    return pa.ListArray.from_arrays(offsets, found), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))


def encoded(rows: DataFrame, words: list[bytes]) -> DataFrame:
    """The columns of rows but text, ids (packed numbers of the head's words, rare ones and the end as in Vocabulary) rare
    (the different rare words) and times (how often each of them stands in the text). Each text is taken apart once."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    others = [f for f in rows.schema.fields if f.name != "text"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shared.value)
        head = pa.array(shared.value, pa.binary())
        for b in joined(batches):
            sizes, found = words_in(b.column("text"))
            x = np.asarray(pc.index_in(found, head.cast(found.type)).fill_null(k))
            ends = np.cumsum(sizes + 1)
            ids = np.full(ends[-1], k + 1, np.int32)
            inner = np.ones(len(ids), bool)
            inner[ends - 1] = False
            ids[inner] = x
            rare, times = rare_words(np.repeat(np.arange(len(sizes)), sizes)[x == k], found.filter(pa.array(x == k)), len(sizes))
            columns = [b.column(b.schema.get_field_index(f.name)) for f in others]
            columns += [pa.array([packed(ids[end - n - 1 : end]) for n, end in zip(sizes.tolist(), ends.tolist())], pa.binary()), rare, times]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in others] + ["ids", "rare", "times"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(run, f"{schema}, ids binary, rare array<binary>, times array<bigint>")


def learn_from(some: Iterator[str], v: Vocabulary, start: dict, width: int, rate: float) -> tuple[int, dict]:
    """(tokens, weights) after one pass over the texts, width of them side by side."""
    ids = Ids(v)
    return learn_numbers((numbers(v.rare, ids, t)[0] for t in some), v, start, width, rate)


def learn_numbers(some: Iterator[np.ndarray], v: Vocabulary, start: dict, width: int, rate: float) -> tuple[int, dict]:
    """learn_from(), of texts as numbers."""
    p = {k: x.copy() for k, x in start.items()}
    adam, slots, h, n = Adam(p, rate), Slots(v, width), np.zeros((width, HIDDEN), np.float32), 0

    def step() -> None:
        used, rows, keep, target, owner = slots.window()
        g, h[used], _ = gradients(p, v, h[used], rows, keep, target, owner >= 0, WINDOW * width)
        adam.step(g)

    for x in some:
        n += len(x)
        for a in range(0, len(x), PIECE):
            slots.add(0, x[a : a + PIECE], x[a - 1] if a else None)
        while slots.full():
            step()
    while slots.waiting.any():
        step()
    return n, p


def learn(part: DataFrame, v: Vocabulary, p: dict, turn: int, n_texts: int) -> dict:
    """The mean of what the tasks learn from their texts (ids: as encoded() gives them), weighted by tokens."""
    spark = part.sparkSession
    shared = spark.sparkContext.broadcast((v, p))
    rate = RATE / (1 + turn)
    tasks = min(MOST, max(LEAST, n_texts // TEXTS_EACH))
    width = max(TRAIN_SLOTS, min(WIDE, n_texts // tasks // DEEP))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        n, p = learn_numbers((unpacked(x) for b in batches for x in column(b, "ids")), *shared.value, width, rate)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "weights": pa.array([np.concatenate([p[k].ravel() for k in sorted(p)]).astype("<f4").tobytes()], pa.binary())})

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for b in batches:
            for k, w in zip(column(b, "n"), column(b, "weights")):
                n, total = n + k, total + k * np.frombuffer(w, "<f4").astype(np.float64)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})

    learned = part.select("ids").repartition(tasks).sortWithinPartitions(F.xxhash64("ids")).mapInArrow(run, "n long, weights binary")
    # a few sums come to the driver, however many tasks there are
    got = learned.repartition(SUMS).sortWithinPartitions("n", "weights").mapInArrow(add_up, "n long, weights binary").collect()
    if not got:
        return p
    n = sum(r.n for r in got)
    mean = sum(np.frombuffer(r.weights, np.float64) for r in sorted(got, key=lambda r: (r.n, bytes(r.weights)))) / n
    out, at = {}, 0
    for k in sorted(p):
        out[k] = mean[at : at + p[k].size].reshape(p[k].shape).astype(np.float32)
        at += p[k].size
    return out


def score(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of all texts; learned from the rows that are usable."""
    ws = Workspace(docs.sparkSession)
    try:
        return _score(docs, usable, id_col, text_col, ws)
    finally:
        ws.close()


def _score(docs: DataFrame, usable: Column, id_col: str, text_col: str, ws: Workspace) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts(docs, id_col, text_col, usable.alias("_usable")).withColumn("doc_id", F.col("doc_id").cast("long"))
    training = rows.where("_usable").select("doc_id", "text")
    n_docs = training.count()
    counts = ws.settle(count_words(training))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least count that HEAD words at most reach, from the number of words by steps of the count: a few hundred rows
    least, above = 1, 0
    for r in counts.groupBy(F.floor(F.log2(F.col("c").cast("double")) * 8 + 1e-9).alias("step")).agg(F.count("*").alias("n"), F.max("c").alias("most")).orderBy(F.desc("step")).collect():
        above += r.n
        if above > HEAD:
            least = r.most + 1
            break
    head = counts.where(F.col("c") >= least).toPandas().sort_values(["c", "word"], ascending=[False, True], kind="stable", ignore_index=True)
    words = [bytes(w) for w in head["word"]]
    turn = F.pmod(F.xxhash64(F.lit("learn"), "doc_id", "text"), F.lit(ROUNDS)).alias("turn")
    rows = ws.settle(encoded(rows.select("doc_id", "text", "_usable", turn), words).withColumn("row", F.monotonically_increasing_id()))
    training, common = rows.where("_usable").select("doc_id", "ids", "turn"), min(GROUP_WORDS, len(words))
    by_group = group_counts(training, len(words), find_groups(ws.settle(vectors_of(training, common)), common))
    v = Vocabulary(words, head["c"].to_numpy(np.int64), by_group.argmax(axis=1).astype(np.int32), by_group.astype(np.float32), total[0] + n_docs, total[1] + (n_docs > 0), n_docs)
    p = initial(v)
    for turn in range(ROUNDS):
        p = learn(training.where(F.col("turn") == turn), v, p, turn, n_docs // ROUNDS)
    shared = spark.sparkContext.broadcast((v, p))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_all", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        v, p = shared.value
        base, slots, h = v.base(), Slots(v, SLOTS), np.zeros((SLOTS, HIDDEN), np.float32)
        open_: dict[int, list] = {}  # number -> [row, doc_id, n, rare ones, base, model, tokens to come]
        number = 0

        met: list[tuple[np.ndarray, ...]] = []  # owners, states and targets of windows

        def step() -> None:
            used, rows, keep, target, owner = slots.window()
            states, _ = forward(p, v, h[used], rows, keep)
            h[used] = states[-1]
            on = owner.ravel() >= 0
            met.append((owner.ravel()[on], states.reshape(-1, HIDDEN)[on], target.ravel()[on]))

        def ended() -> list:
            """The texts that all states have come of."""
            if not met:
                return []
            who, states, target = map(np.concatenate, zip(*met))
            met.clear()
            each, inverse = np.unique(who, return_inverse=True)
            for d, x, n in zip(each.tolist(), np.bincount(inverse, weights=log_prob(p, v, states, target)).tolist(), np.bincount(inverse).tolist()):
                r = open_[d]
                r[5] += x
                r[6] -= n
            return [open_.pop(d)[:6] for d in each.tolist() if not open_[d][6]]

        def batch(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*done), schema)], schema=schema)

        for b in batches:
            for i, doc_id, packed in zip(column(b, "row"), column(b, "doc_id"), column(b, "ids")):
                x = unpacked(packed)
                open_[number] = [i, doc_id, len(x), int((x == v.rare).sum()), float(base[x].sum()), 0.0, len(x)]
                slots.add(number, x)
                number += 1
                while slots.full():
                    step()
                    if len(met) * SLOTS * WINDOW >= MEET:
                        done = ended()
                        if done:
                            yield batch(done)
        while slots.waiting.any():
            step()
            if sum(len(x[0]) for x in met) >= MEET:
                done = ended()
                if done:
                    yield batch(done)
        done = ended()
        if done:
            yield batch(done)

    # the longest texts first, so that slots end together
    scored = ws.settle(rows.select("row", "doc_id", "ids").sortWithinPartitions(F.desc(F.length("ids"))).mapInArrow(run, "row long, doc_id long, n_tokens long, n_all long, base double, model double"))
    words = rows.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("n"))))
    rare = words.join(counts.select("word", "c"), "word").groupBy("row").agg(F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"))
    joined = scored.join(rare, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return settle(
        joined.select(
            "doc_id",
            "n_tokens",
            (F.col("n_tokens") - F.col("n_all") - int(v.n_docs == 0) + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
            F.lit(v.n_tokens).cast("long").alias("train_tokens"),
            (F.col("base") + logs).alias("base_score"),
            (F.col("model") / LN10 + logs - F.col("n_all") * float(np.log10(v.rare_tokens + v.rare_types + 1.0))).alias("score"),
        )
    )
