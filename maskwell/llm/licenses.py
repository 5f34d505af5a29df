"""License scan: fuzzy search for short notices.

A notice that may hold up to k edits is cut into k + 1 pieces; by the pigeonhole principle at least one of
them stands unedited. An Aho-Corasick automaton finds the pieces in one pass over the text, and the regex
library's bounded-error matching verifies each place and gives the span and its edits. Beside it, exact
phrases of words are counted (the base).

Text: A-Z lower-cased; words are runs of letters, digits and non-ASCII characters; all else separates.
Null and empty texts: no words, no labels, score 0. Repeated rows give repeated results. Extra columns of the
input are not read. A document is scanned whole; memory follows the longest document.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, plain_words, small_batches, texts

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Short notices and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution", "cc"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "proprietary"),
)
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPAN = "struct<label:string,notice:int,first_word:int,n_words:int,start:int,end:int,edits:int>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>"


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces of nearly equal length that make up the notice."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def _compiled(notices: tuple[tuple[str, str], ...], chars_per_edit: int):
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    rules = []
    for i, (text, label) in enumerate(notices):
        k = max(1, len(text) // chars_per_edit)
        rules.append((label, text, k, regex.compile(f"(?e)(?:{regex.escape(text, special_only=True, literal_spaces=True)}){{e<={k}}}")))
        for at, piece in pieces(text, k):
            seeds.setdefault(piece, []).append((i, at))
    automaton = ahocorasick.Automaton()
    for piece, places in seeds.items():
        automaton.add_word(piece, (len(piece), tuple(places)))
    automaton.make_automaton()
    return automaton, rules


def find_notices(normal: str, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) in the normalised text, by notice and start; spans of one notice don't overlap."""
    automaton, rules = _compiled(notices, chars_per_edit)
    ranges: dict[int, list[tuple[int, int]]] = {}
    for last, (length, places) in automaton.iter(normal):
        for i, at in places:
            _, text, k, _ = rules[i]
            start = last - length + 1 - at
            ranges.setdefault(i, []).append((max(0, start - k), min(len(normal), start + len(text) + k)))
    found = []
    for i, near in sorted(ranges.items()):
        done = 0
        for a, b in sorted(set(near)):
            while (a := max(a, done)) < b and (m := rules[i][3].search(normal, a, b)):
                # an edit at the rim can take a separator along
                x, y = m.start(), m.end()
                x, y = x + (normal[x] == " "), y - (normal[y - 1] == " ")
                found.append((i, x, y, sum(m.fuzzy_counts)))
                a = done = m.end()
    return best_of_overlapping(found)


def best_of_overlapping(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of spans that share characters the one with the fewest edits stays (then the longest, then the first notice)."""
    kept: list[tuple[int, int, int, int]] = []
    taken: list[tuple[int, int]] = []  # disjoint, ascending
    for hit in sorted(found, key=lambda h: (h[3], h[1] - h[2], h[0], h[1])):
        at = bisect.bisect(taken, (hit[1], hit[2]))
        if (at == 0 or taken[at - 1][1] <= hit[1]) and (at == len(taken) or hit[2] <= taken[at][0]):
            taken.insert(at, (hit[1], hit[2]))
            kept.append(hit)
    return sorted(kept, key=lambda h: (h[1], h[2], h[0]))


def scan(text: str, phrases=PHRASES, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> tuple:
    words = plain_words(text)
    joined = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in phrases:
        needle, at, before, number = b" " + phrase.encode() + b" ", -1, 0, 0
        while (at := joined.find(needle, at + 1)) >= 0:
            number += joined.count(b" ", before, at)  # words before this place
            before = at
            starts.append(number)
            base.add(label)
    normal = joined.decode("utf-8", "surrogatepass")
    hits = find_notices(normal, notices, chars_per_edit)
    labels, score, spans = set(base), 1.0 if base else 0.0, []
    if hits:
        at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        before, number = 0, 0
        for i, a, b, edits in hits:  # by start
            number += normal.count(" ", before, a + 1)
            before, first = a + 1, number - 1
            n = normal.count(" ", a, b) + 1
            label = notices[i][1]
            labels.add(label)
            score = max(score, 1 - edits / len(notices[i][0]))
            spans.append({"label": label, "notice": i, "first_word": first, "n_words": n, "start": at[first][0], "end": at[first + n - 1][1], "edits": edits})
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """One row per input row: SCHEMA. One narrow pass, no shuffle."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), *((c, pa.int32()) for c in ("notice", "first_word", "n_words", "start", "end", "edits"))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t, phrases, notices, chars_per_edit) for t in column(batch, "text")]
            cols = [batch.column(0), *map(list, zip(*rows))] if rows else [batch.column(0), *[[]] * 8]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if isinstance(c, list) else c for c, f in zip(cols, schema)], schema=schema)

    return texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCHEMA)
