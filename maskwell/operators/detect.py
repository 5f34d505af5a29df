"""Candidates by rules, resolution of identical spans, spans of entities on words. A detector that is a model can
stand in for the rules: a callable from texts of windows to candidates, run by detected()."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.policy import POLICY, policy
from ..functions.text import blank, exploded, matches, numbered, with_starts

#: (label, pattern, score); the last one competes for the same spans and loses by the alphabet.
RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.9),
    ("ip_address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0.9),
    ("phone_number", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.8),
    ("credit_debit_card", r"[0-9]{16}", 0.7),
    ("other_pii", r'token = "[0-9a-f]{40}"', 0.6),
    ("national_id", r"[0-9]{16}", 0.7),
)
MIN_SCORE, MAX_ENTITIES, MAX_CHARS, MAX_WORDS = 0.3, 128, 6000, 512


def rule_candidates(df: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """key, start, end, label, score: all matches of each rule, in one scan. Only texts that hold a match are moved and taken
    apart. Texts with the same key give the rows of each."""
    found = [F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"), *matches(text, pattern)) for label, pattern, score in rules]
    rows = numbered(with_matches(df, text, rules), key, text).select(key, "_row", F.explode(F.array(*found)).alias("_m")).where(F.size("_m._tok") > 0)
    rows = exploded(rows.select(key, "_row", "_m.*"), [key, "label", "score"])
    return with_starts(rows, ["label"]).select(key, "start", "end", "label", "score")


def with_matches(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows whose text holds a match of a rule. One narrow pass."""
    return df.where(F.col(text).rlike("|".join(f"(?:{p})" for p in dict.fromkeys(p for _, p, _ in rules))))


def resolve_identical(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of candidates with the same span the best stays: highest score, then first label. Other overlaps all stay."""
    order = W.partitionBy(key, "start", "end").orderBy(F.desc("score"), F.asc("label"))
    return candidates.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def entities(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return resolve_identical(rule_candidates(df, key, text), key)


def valid_entity(n_chars: Column, min_score: float = MIN_SCORE) -> Column:
    """In range, scored, and of the policy; NaN scores fail."""
    score = F.col("score")
    fine = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= n_chars)
    return F.coalesce(fine & ~F.isnan(score) & (score >= min_score) & (score <= 1) & F.col("label").isin(*POLICY), F.lit(False))


def has_evidence(text: Column) -> Column:
    """The span covers something besides white space."""
    return ~blank(F.substring(text, F.col("start") + 1, F.col("end") - F.col("start")))


def spans_on_words(found: DataFrame, words: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One span for each word (key, line, w_start, w_end) that an entity touches, clipped to the word and counted from
    its start; keep: columns of the words that stay. An equi-join on the text with the overlap as its residue. Entities that
    touch no word give no row; untouched() names them."""
    e, w = found.alias("e"), words.alias("w")
    hit = (F.col(f"e.{key}") == F.col(f"w.{key}")) & (F.col("e.start") < F.col("w.w_end")) & (F.col("e.end") > F.col("w.w_start"))
    return e.join(w, hit).select(
        F.col(f"e.{key}").alias(key),
        F.col("e.label").alias("label"),
        F.col("e.start").alias("e_start"),
        F.col("e.end").alias("e_end"),
        F.col("w.line").alias("line"),
        (F.greatest("e.start", "w.w_start") - F.col("w.w_start")).cast("int").alias("start"),
        (F.least("e.end", "w.w_end") - F.col("w.w_start")).cast("int").alias("end"),
        *[F.col(f"w.{c}").alias(c) for c in keep],
    )


def untouched(found: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entities (key, start, end, label) without a span on any word: what they hide would stay visible, so their texts fail."""
    hit = spans.select(key, F.col("e_start").alias("start"), F.col("e_end").alias("end"), "label").distinct()
    return found.select(key, "start", "end", "label").join(hit, [key, "start", "end", "label"], "left_anti")


def detected(df: DataFrame, windows: DataFrame, words: DataFrame, detect_batch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, label, score, error: a detector over windows of words, in code points of the whole text.

    windows: key, win, first_word, last_word; words: key, ord, start, end; keys are unique. detect_batch is a callable from
    texts of windows to a list of (start, end, label, score) each. Candidates that stand outside their window, cover nothing
    visible, have no score from 0 to 1 or no label of the policy are rows with an error in place of a span; so is a
    window whose call fails. Of identical spans of overlapping windows the best stays (resolve_identical)."""
    keytype = df.schema[key].dataType.simpleString()
    first = words.select(key, F.col("ord").alias("first_word"), F.col("start").alias("_from"))
    last = words.select(key, (F.col("ord") + 1).alias("last_word"), F.col("end").alias("_to"))
    parts = windows.join(first, [key, "first_word"]).join(last, [key, "last_word"]).join(df.select(key, F.col(text).alias("_text")), key)
    parts = parts.select(key, "win", "_from", F.expr("substring(_text, _from + 1, _to - _from)").alias("_part"))
    allowed = frozenset(POLICY)

    def fault(part: str, start, end, label, score) -> str | None:
        if not (isinstance(start, int) and isinstance(end, int) and 0 <= start < end <= len(part)):
            return "bad_range"
        if not part[start:end].strip():
            return "no_evidence"
        if not isinstance(score, float) or not 0 <= score <= 1:
            return "bad_score"
        return None if label in allowed else "unknown_label"

    def answers_of(some: list[str]) -> list | None:
        try:
            found = list(detect_batch(some))
            return found if len(found) == len(some) else None
        except Exception:  # what it says may hold text of documents
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, some = [], b["_part"].tolist()
            answers = answers_of(some)
            if answers is None:  # each window fails for itself
                answers = [(answers_of([part]) or [None])[0] for part in some]
            for k, at, part, found in zip(b[key], b["_from"], some, answers):
                if found is None:
                    rows.append((k, None, None, None, None, "detector_failed"))
                for start, end, label, score in found or ():
                    error = fault(part, start, end, label, score)
                    rows.append((k, None, None, None, None, error) if error else (k, at + start, at + end, label, score, None))
            frame = pd.DataFrame(rows, columns=[key, "start", "end", "label", "score", "error"])
            yield frame.astype({"start": "Int32", "end": "Int32"})

    rows = parts.select(key, "_from", "_part").mapInPandas(run, f"{key} {keytype}, start int, end int, label string, score double, error string")
    fine = resolve_identical(rows.where("error is null").drop("error"), key).withColumn("error", F.lit(None).cast("string"))
    return fine.unionByName(rows.where("error is not null"))


def over_cap(rows: DataFrame, key: str = "doc_id", cap: int = MAX_ENTITIES) -> DataFrame:
    """Keys with more rows than the cap; such texts fail as a whole."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > cap).select(key)


def failed_by_cap(found: DataFrame, spans: DataFrame, key: str = "doc_id", cap: int = MAX_ENTITIES) -> DataFrame:
    """Keys with more entities than the cap, or with more spans after these were laid on words; nothing is cut off."""
    return over_cap(found, key, cap).unionByName(over_cap(spans, key, cap)).distinct()


#: The order of a document's steps.
PHASES = ("ocr", "redact", "finish")


def phase_errors(steps: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, action, error: steps (key, pos from 0, action) that are unknown, out of order or more than there are phases."""
    due = F.get(F.array(*map(F.lit, PHASES)), F.col("pos"))
    error = F.when(~F.col("action").isin(*PHASES) | F.col("action").isNull(), "unknown_action").when(~F.col("action").eqNullSafe(due), "wrong_phase")
    return steps.select(key, "pos", "action", error.alias("error")).where("error is not null")


def in_policy(rows: DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose label is (or is not) of the policy."""
    return rows.join(F.broadcast(policy(rows.sparkSession)), "label", "left_anti" if negate else "left_semi")
