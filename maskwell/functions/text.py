"""Words with offsets, windows of words, virtual lines: native expressions on code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Runs of letters, digits and underscores with inner joints, or one other visible character.
WORD = r"[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*|[^\s\p{Z}\p{L}\p{N}_]"
WINDOW_WORDS, OVERLAP = 72, 18
#: The virtual page: columns of the grid, and the geometry of its cells in pixels.
COLUMNS, X0, Y0, STRIDE, PITCH, CELL_W, CELL_H = 72, 40, 44, 16, 48, 17, 19


def matches(text: str, pattern: str) -> tuple[Column, Column]:
    """_tok and _gap: the matches of the pattern and what stands before, between and after them."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"regexp_extract_all(`{text}`, {p}, 0)").alias("_tok"), F.expr(f"split(`{text}`, {p}, -1)").alias("_gap")


def exploded(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep..., _row, ord, token, _g, _n: one row for each match of rows with _tok and _gap, with the lengths of its gap and
    its own. _row numbers the texts. The texts are dealt out by it before they are taken apart, so that with_starts() moves
    no matches."""
    steps = F.expr("transform(_tok, (t, i) -> struct(length(_gap[i]) AS g, length(t) AS n))")
    pairs = F.arrays_zip(F.col("_tok").alias("token"), steps.alias("step"))
    return rows.select(*keep, "_row", F.posexplode(pairs).alias("ord", "_x")).select(*keep, "_row", "ord", "_x.token", F.col("_x.step.g").alias("_g"), F.col("_x.step.n").alias("_n"))


def numbered(df: DataFrame, *columns) -> DataFrame:
    """The columns and _row, dealt out by it."""
    return df.select(*columns, F.monotonically_increasing_id().alias("_row")).repartition("_row")


def matches_with_offsets(df: DataFrame, text: str, pattern: str, keep: list[str]) -> DataFrame:
    """keep..., _row, ord, token, _g, _n of all matches of the pattern; with_starts() gives the offsets. Null texts give no
    rows, and so do empty ones; a text of any length is taken whole."""
    rows = numbered(df.where(F.col(text).isNotNull()), *keep, text)
    return exploded(rows.select(*keep, "_row", *matches(text, pattern)), keep)


def with_starts(rows: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Adds start and end of each token in code points: the running sum of gaps and tokens of its text (and of `more`
    columns, where a text was searched more than once). Texts that share a key are kept apart by their numbers."""
    w = W.partitionBy("_row", *(more or [])).orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.sum(F.col("_g") + F.col("_n")).over(w) - F.col("_n")
    return rows.withColumn("start", start.cast("int")).withColumn("end", (F.col("start") + F.col("_n")).cast("int")).drop("_g", "_n", "_row")


def words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ord, token, start, end of the words of each text. Texts with the same key have rows of their own each."""
    return with_starts(matches_with_offsets(df, text, WORD, [key])).select(key, "ord", "token", "start", "end")


def word_count(text: str) -> Column:
    p = "'" + WORD.replace("\\", "\\\\") + "'"
    return F.expr(f"coalesce(regexp_count(`{text}`, {p}), 0)")


def windows(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """key, n_words, win, first_word, last_word (exclusive): overlapping windows of words; the last one ends the text.
    Texts without words have none."""
    step = size - overlap
    rows = df.select(key, word_count(text).cast("int").alias("n_words")).where("n_words > 0")
    last = F.greatest(F.lit(0), F.ceil((F.col("n_words") - size) / step)) * step
    rows = rows.select(key, "n_words", F.posexplode(F.sequence(F.lit(0), last.cast("int"), F.lit(step))).alias("win", "first_word"))
    return rows.withColumn("last_word", F.least(F.col("first_word") + size, F.col("n_words")))


def budget_windows(df: DataFrame, key: str = "doc_id", counts: str = "counts", size: int = WINDOW_WORDS, overlap: int = OVERLAP, budget: int = 352) -> DataFrame:
    """key, win, first_word, last_word, error: windows whose words have `budget` sub-tokens at most. counts: an array with the
    number of sub-tokens of each word, by whatever tokenizer. A window that holds more ends earlier, the next one begins
    `overlap` words before its end, one word on at least; a text with a word over the budget has one row with an error.
    Null and empty arrays have no windows."""
    keytype = df.schema[key].dataType.simpleString()

    def cut(n: list[int]) -> list[tuple]:
        if max(n, default=0) > budget:
            return [(None, None, None, "word_over_budget")]
        total, out, start = np.concatenate(([0], np.cumsum(n))), [], 0
        while n and (not out or out[-1][2] < len(n)):
            # the most words whose sum stays within the budget
            end = min(start + size, int(np.searchsorted(total, total[start] + budget, side="right")) - 1)
            out.append((len(out), start, end, None))
            start = max(start + 1, end - overlap)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *w) for k, n in zip(b[key], b[counts]) if n is not None for w in cut(list(n))]
            yield pd.DataFrame(rows, columns=[key, "win", "first_word", "last_word", "error"]).astype({c: "Int32" for c in ("win", "first_word", "last_word")})

    return df.select(key, counts).mapInPandas(run, f"{key} {keytype}, win int, first_word int, last_word int, error string")


def blank(text: Column) -> Column:
    """Whether there is nothing but Unicode white space."""
    return ~text.rlike(r"[^\s\p{Z}]")


def strip(text: Column) -> Column:
    """Unicode strip()."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def line_of(offset: Column) -> Column:
    return F.floor(offset / COLUMNS).cast("int")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)
