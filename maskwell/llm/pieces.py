"""SentencePiece encoding and decoding with weighted finite-state transducers.

A model file is compiled into transducers. The normaliser maps characters to symbols (space to the mark U+2581, a mark
before the text, and, if the model says so, runs of spaces to one): a small machine with an arc of identity. The pieces
are the closure of a trie: from its one looping state each piece is a path that comes back, with its id as output and
its weight. The byte fallback maps a character that is no piece to its UTF-8 bytes, and these to byte pieces; the two
are composed when a character first comes up, and the path joins the compiled transducer. A text, a linear acceptor, is
composed with the normaliser, the result with the pieces, and the tropical shortest path gives the ids.

For a unigram model a piece weighs minus its score, a fallback the lowest score less UNKNOWN; of paths of the same weight
the one whose last piece is longest stays (then second last, and so on). For a BPE model the pieces are composed with a
filter as well: an acceptor with the last piece as its state, whose arc from u to v weighs 0 if merging turns the
characters of uv into u, v, and infinity if not. A path of finite weight is then the one that merging gives, and the
only one, for each beginning of the text; so the composition is explored depth first, and a position that led nowhere is
not entered again. The filter's arcs are found from how pieces are made: merging goes by rank, so the symbols at the end
of u and at the start of v grow at known ranks, and uv is left alone if no symbol of the one and symbol of the other that stand side by side
at some time make a piece of a rank that comes first. Pieces of equal score (runs of marks) are merged out.

No path of a piece goes on from another character into a mark (checked when a model is compiled; with other
models the text is one piece of work), so the composition is cut in front of marks that follow another character:
the shortest path of a text is those of its words, one after the other. The paths of frequent words are remembered.

Models with a normalisation map, and BPE models with pieces of the user or with characters that are no pieces, are refused.
Null texts have no pieces, as empty ones. decode() gives back the text exactly, but for texts that hold the mark
itself, which reads as a space (decoded_ok is false for them). Repeated rows have equal results; extra columns are not
read; texts are whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, tidied

MARK = "▁"
UNKNOWN = 10.0
#: Words whose paths a Python worker remembers, in each of two generations.
REMEMBERED = 75_000
INF = float("inf")


class Transducer:
    """The closure of a trie. A state is its arcs, input symbol -> state; under "" it has the weight and the outputs of the
    empty arc back to the first state, which starts and ends."""

    def __init__(self) -> None:
        self.root: dict = {}

    def path(self, symbols: str, outputs: tuple[int, ...], weight: float) -> None:
        """A path from the start and back to it. Of two with the same symbols the lighter stays."""
        state = self.root
        for c in symbols:
            state = state.setdefault(c, {})
        if "" not in state or weight < state[""][0]:
            state[""] = (weight, outputs)


def shortest_path(fst: Transducer, text: str, other) -> list[int]:
    """Outputs of the tropical shortest path through the composition of the text with the transducer. other(c): the
    (weight, outputs) of a character without a path of one symbol."""
    n = len(text)
    best = [0.0] + [INF] * n
    step: list[tuple[int, tuple[int, ...]]] = [(0, ())] * (n + 1)
    for i in range(n):
        base, state, j, single = best[i], fst.root, i, False
        while j < n and (state := state.get(text[j])) is not None:
            j += 1
            if (b := state.get("")) is not None:
                single |= j == i + 1
                if (w := base + b[0]) < best[j]:
                    best[j], step[j] = w, (i, b[1])
        if not single and (w := base + (b := other(text[i]))[0]) < best[i + 1]:
            best[i + 1], step[i + 1] = w, (i, b[1])
    out: list[tuple[int, ...]] = []
    while n:
        n, ids = step[n]
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]


def read_fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            raise ValueError("not a model file")
        yield key >> 3, kind, value


class Normaliser:
    """A transducer of characters: arcs[state][character] = (output, next state); any other character goes out as it is,
    after what the state holds back, to state `other`."""

    def __init__(self, prefix: bool, squeeze: bool, escape: bool):
        mark = MARK if escape else " "
        self.first = mark if prefix else ""
        # 0: as it comes; with squeeze 0 at the start, 1 in a word, 2 after a word's spaces (held back)
        self.arcs = [{" ": ("", 0)}, {" ": ("", 2)}, {" ": ("", 2)}] if squeeze else [{" ": (mark, 0)}]
        self.held, self.other = ["", "", mark] if squeeze else [""], 1 if squeeze else 0
        self.squeeze, self.by_word = squeeze, not squeeze and prefix and escape

    def apply(self, text: str) -> str:
        """The composition of a text with the machine, as symbols."""
        state, out = 0, []
        for c in text:
            arc = self.arcs[state].get(c)
            if arc is None:
                out += [self.held[state], c]
                state = self.other
            else:
                out.append(arc[0])
                state = arc[1]
        symbols = "".join(out)
        if self.squeeze:  # marks of the text itself go from its end too
            symbols = symbols.rstrip(MARK)
        return self.first + symbols if symbols else ""


class Merges:
    """The filter of a BPE model: whether two pieces can stand side by side. rank: of each piece of two characters or more."""

    def __init__(self, pieces: dict[str, int], scores: list[float]):
        self.pieces = pieces
        self.rank = {p: -scores[i] for p, i in pieces.items() if len(p) > 1}
        times: dict[float, int] = {}
        for r in self.rank.values():
            times[r] = times.get(r, 0) + 1
        #: by id: the symbols at the right and left rim of a piece while it is made, with their ranks; None: merge it out
        self.right: dict[int, tuple[tuple[str, float], ...] | None] = {}
        self.left: dict[int, tuple[tuple[str, float], ...] | None] = {}
        self.known: dict[int, bool] = {}
        for p, i in pieces.items():
            if len(p) == 1:
                self.right[i] = self.left[i] = ((p, -INF),)
        for p, r in sorted(self.rank.items(), key=lambda x: (x[1], x[0])):
            i, step = pieces[p], (p, r)
            for k in range(1, len(p)):
                a, b = pieces.get(p[:k]), pieces.get(p[k:])
                if times[r] == 1 and a in self.right and b in self.right and self.right[a] and self.right[b] and self.apart(self.right[a], self.left[b], r):
                    self.right[i], self.left[i] = (*self.right[b], step), (*self.left[a], step)
                    break
            else:
                if self.merged(p) == [p]:
                    self.right[i] = self.left[i] = None

    def apart(self, right: tuple[tuple[str, float], ...], left: tuple[tuple[str, float], ...], below: float = INF) -> bool:
        """No merge across the border comes first. Of merges of equal rank the left one does."""
        i, j, m, n, rank = 0, 0, len(right) - 1, len(left) - 1, self.rank
        while True:
            next_right = right[i + 1][1] if i < m else INF
            next_left = left[j + 1][1] if j < n else INF
            across = rank.get(right[i][0] + left[j][0], INF)
            if across < below and across < next_right and across <= next_left:
                return False
            if i == m and j == n:
                return True
            if next_right <= next_left:
                i += 1
            else:
                j += 1

    def merged(self, text: str) -> list[str]:
        """Merging, step by step: of all neighbours that make a piece those of the best score, from the left."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: (self.rank.get(parts[k] + parts[k + 1], INF), k))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def allow(self, key: int, u: int, v: int, text: str, cut: int) -> bool:
        """Whether u and v, text[:cut] and text[cut:], stay apart; remembered. Nothing merges with what is no piece."""
        if u in self.right and v in self.right:
            right, left = self.right[u], self.left[v]
            ok = self.apart(right, left) if right and left else self.merged(text) == [text[:cut], text[cut:]]
        else:
            ok = True
        if len(self.known) > REMEMBERED * 2:
            self.known.clear()
        self.known[key] = ok
        return ok


def only_path(fst: Transducer, merges: Merges, symbols: str, other) -> list[int]:
    """Outputs of the path of finite weight through the composition of symbols, pieces and filter."""
    n, root, known, dead = len(symbols), fst.root, merges.known, set()
    path: list[tuple] = []  # of each step: its start, that of the step before, the last id before, other ways on, outputs
    at, came, last = 0, 0, -1
    while at < n:
        options, state, j = [], root, at
        while j < n and (state := state.get(symbols[j])) is not None:
            j += 1
            if (b := state.get("")) is not None:
                options.append((j, b[1]))
        if not options:
            options.append((at + 1, other(symbols[at])[1]))
        while True:
            ok = False
            while options and not ok:
                end, out = options.pop()
                if end not in dead:
                    key = last << 32 | out[0]
                    ok = last < 0 or known.get(key)
                    if ok is None:
                        ok = merges.allow(key, last, out[0], symbols[came:end], at - came)
            if ok:
                break
            dead.add(at)  # no way on from here
            at, came, last, options, _ = path.pop()
        path.append((at, came, last, options, out))
        at, came, last = end, at, out[-1]
    return [i for step in path for i in step[4]]


class Model:
    """The transducers of a SentencePiece model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []  # piece, score, type
        flags, kind_of_model = {3: 1, 4: 1, 5: 1}, 1
        for number, _, value in read_fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for f, _, v in read_fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = v
                    elif f == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                kind_of_model = next((v for f, _, v in read_fields(value) if f == 3), 1)
            elif number == 3:
                for f, _, v in read_fields(value):
                    if f == 2 and v:
                        raise ValueError("a model with a normalisation map")
                    if f in flags:
                        flags[f] = v
        self.normaliser = Normaliser(*map(bool, flags.values()))
        normal = [s for _, s, k in self.pieces if k in (1, 4)]
        self.unknown = UNKNOWN - min(normal)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == 6}
        self.unk = next((i for i, (_, _, k) in enumerate(self.pieces) if k == 2), 0)
        self.cut = not any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k in (1, 4))
        self.merges = None
        if kind_of_model == 2:
            own = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == 1 and p}
            if any(k == 4 for _, _, k in self.pieces) or any(c not in own for p in own for c in p):
                raise ValueError("a BPE model with pieces of the user or characters that are no pieces")
            self.merges = Merges(own, [s for _, s, _ in self.pieces])
        elif kind_of_model != 1:
            raise ValueError("neither a unigram nor a BPE model")
        self.fst = Transducer()
        for i, (p, s, k) in enumerate(self.pieces):
            if k in (1, 4) and p and (not self.merges or i in self.merges.right):
                self.fst.path(p, (i,), -s)
        self.back = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.replace(MARK, " ").encode() for p, _, k in self.pieces]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def other(self, c: str) -> tuple[float, tuple[int, ...]]:
        """The byte fallback of a character: its UTF-8 bytes, composed with the byte pieces. The path joins the transducer."""
        raw = c.encode("utf-8", "surrogatepass")
        ids = tuple(self.bytes[b] for b in raw) if self.bytes else (self.unk,)
        self.fst.path(c, ids, self.unknown)
        return self.unknown, ids

    def path(self, symbols: str) -> list[int]:
        """The tropical shortest path of normalised symbols."""
        return only_path(self.fst, self.merges, symbols, self.other) if self.merges else shortest_path(self.fst, symbols, self.other)

    def encode_bytes(self, text: str) -> bytes:
        """Little-endian u32 ids. Words between single spaces are remembered without their mark, others with theirs."""
        words = text.split(" ") if text else []
        if not (self.cut and self.normaliser.by_word) or MARK in text or "" in words:
            normal = self.normaliser.apply(text)
            words = _WORDS.findall(normal) if self.cut else [normal] if normal else []
            if not (self.cut and self.normaliser.by_word):
                return b"".join(np.array(self.path(w), "<u4").tobytes() for w in words)
        new = self.new
        for w in set(filterfalse(new.__contains__, words)):
            new[w] = self.old.get(w) or array("I", self.path(w if w[0] == MARK else MARK + w)).tobytes()
        out = b"".join(map(new.__getitem__, words))
        if len(new) > REMEMBERED:
            self.new, self.old = {}, new
        return out

    def forget(self) -> None:
        """Workers live on after a task, and what they remember would stay in an executor's memory."""
        self.new, self.old = {}, {}
        if self.merges:
            self.merges.known.clear()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The inverse: pieces to characters, byte pieces to bytes, marks to spaces, the first one left out."""
        raw = b"".join(map(self.back.__getitem__, ids))
        return raw[1:] if self.normaliser.first and raw.startswith(b" ") else raw

    def decode(self, ids) -> str:
        return self.decode_bytes(list(ids)).decode("utf-8", "surrogatepass")


#: Marks and what follows them up to the next mark after another character; a text that starts without a mark too.
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.S)


@lru_cache(maxsize=2)
def _model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, n_bytes (pieces of the byte fallback), ids_crc32 (of the ids as little-endian u32), decoded_ok
    (decode() gives the text back), and the ids if asked for. One narrow pass; model: a file on each machine."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_bytes", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_ok", pa.bool_())] + [("ids", pa.binary())] * with_ids)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        is_byte = np.array([k == 6 for _, _, k in m.pieces])
        for b in batches:
            rows = []
            for t in column(b, "text"):
                raw = m.encode_bytes(t)
                ids = np.frombuffer(raw, "<u4")
                same = m.decode_bytes(ids.tolist()) == t.encode("utf-8", "surrogatepass")
                rows.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(raw), same, *[raw] * with_ids))
            cols = zip(*rows) if rows else [[]] * (4 + with_ids)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, type=f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema)
        m.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, decoded_ok boolean" + ", ids binary" * with_ids)


def decode(coded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """The rows of encode(with_ids=True) with a column text in place of the ids."""
    small_batches(coded.sparkSession)
    names = [c for c in coded.columns if c != ids_col]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for b in batches:
            out = [None if x is None else m.decode(np.frombuffer(x, "<u4").tolist()) for x in column(b, ids_col)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(out, pa.string())], names=[*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema if f.name != ids_col)
    return coded.mapInArrow(run, f"{fields}, text string")
