"""PII: information-theoretic sanitisation.

Four kinds of protected entities are found by pattern (the base): email, ip, card, phone. What stands in the same
document can give them away too. Over the whole corpus, a term t reveals an entity c by their pointwise mutual information

    PMI(t; c) = log2(N * n_tc / (n_t * n_c)),        IC(c) = log2(N / n_c)

with N documents, n_t of them with the term, n_c with the entity, and n_tc with both, at any distance. A term whose
PMI reaches ALPHA * IC(c), so that it gives away that share of what the entity tells, exceeds the disclosure
threshold: in documents with that entity it is removed if it gives the entity away in full (PMI >= IC), else
generalised to its class: a capitalised word to [NAME], one in capitals to [ACRONYM], any other to [WORD]. Such places are spans of kind `term`. Entities that occur once are no exception: PMI is
then log2(N / n_t), the rarity of the term. min_contexts asks for so many documents with different terms; it is 1, so
it drops nothing. Terms are words of four letters or more without digits; shorter ones and those with digits are not
looked at.

Three passes over the texts: contexts of entities (only documents with entities give rows), document counts of
the candidate terms, and the spans or the new texts. Candidate terms are looked up in a bitmap of fixed size;
what passes it wrongly falls out in a join. The table of disclosing terms is broadcast up to BROADCAST_TERMS
rows, and joined by document beyond.

Null and empty texts have no spans. Repeated rows have equal results and count each time. Extra columns are kept
by redact() and not read by find(). Texts are scanned whole; no pattern backtracks over more than its match.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import column, settle, small_batches, tidied

KINDS = ("email", "ip", "card", "phone", "term")
MIN_CONTEXTS = 1
ALPHA = 0.8
BITS = 1 << 22
BROADCAST_TERMS = 100_000
#: Pairs of an entity and a term that leave a task at once.
PAIRS = 20_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_]{4,}")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each @ outwards, so that long runs of letters cost nothing; the same spans as the pattern from the left."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the four kinds, by start and then by kind as listed; code points, end exclusive."""
    found = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def entity_key(text: str, span: Span) -> str:
    """One key for all spellings of an entity's value."""
    value = text[span[1] : span[2]]
    return f"{span[0]}:{value.lower() if span[0] in ('email', 'ip') else _NOT_DIGIT.sub('', value)}"


def near_terms(text: str, span: Span, base: list[Span]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the whole words of the text outside of all base spans, so the same for each span of it."""
    return document_terms(text, base)


def document_terms(text: str, base: list[Span]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all words outside of the base spans, which come by start."""
    out, k, reach = [], 0, 0
    for m in _TERM.finditer(text):
        s, e = m.span()
        while k < len(base) and base[k][1] < e:  # those that start before the word's end
            reach = max(reach, base[k][2])
            k += 1
        if reach <= s:
            out.append((m[0].lower(), s, e))
    return out


class Passes(dict):
    """term -> whether its bit is set; remembered."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __missing__(self, term: str) -> bool:
        h = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), seed=42) % BITS
        ok = self[term] = bool(self.bits[h >> 3] >> (h & 7) & 1)
        return ok


def disclosures(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """entity, term, pmi, ic, removed: the terms that exceed the threshold. Cut from its lineage."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int32()))], names=["entity", "term", "context", "docs"])

    @tidied
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text in column(b, "text"):
                base = base_spans(text)
                if not base:
                    continue
                terms = [t for t, _, _ in document_terms(text, base)]
                context = xxhash.xxh3_64_intdigest(" ".join(terms).encode("utf-8", "surrogatepass")) >> 1
                terms = ["", *dict.fromkeys(terms)]
                for key in {entity_key(text, span) for span in base}:
                    out += [(key, t, context, 1) for t in terms]
                    if len(out) > PAIRS:
                        yield batch(out)
                        out = []
            yield batch(out)

    seen = rows.mapInArrow(contexts, "entity string, term string, context long, docs int")
    # each pair has a context, so one is no condition and needs no shuffle of its own
    by_context = seen.groupBy("entity", "term", "context").agg(F.sum("docs").alias("docs")) if min_contexts > 1 else seen.drop("context")
    pairs = settle(by_context.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("docs").alias("n_tc")))
    entities = pairs.where(F.col("term") == "").select("entity", F.col("n_tc").alias("n_c"))
    candidates = pairs.where((F.col("term") != "") & (F.col("contexts") >= min_contexts))
    bits = np.zeros(BITS // 8, np.uint8)
    at = candidates.select(F.expr(f"pmod(xxhash64(term), {BITS})").cast("int").alias("at")).distinct().toPandas()["at"].to_numpy(np.int64)  # BITS rows at most
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    shared = spark.sparkContext.broadcast(bits)

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, total, n = Passes(shared.value), Counter(), 0

        def flush() -> pa.RecordBatch:
            rb = pa.RecordBatch.from_pydict({"term": pa.array(["", *total], pa.string()), "n": pa.array([n, *total.values()], pa.int64())})
            total.clear()
            return rb

        for b in batches:
            for text in column(b, "text"):
                n += 1
                if len(at):
                    total.update(filter(passes.__getitem__, set(_TERM.findall(text.lower()))))
            if len(passes) > 100_000:
                passes.clear()
            if len(total) > 100_000:
                yield flush()
                n = 0
        yield flush()

    counts = settle(rows.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t")))
    n_docs = counts.where(F.col("term") == "").agg(F.coalesce(F.sum("n_t"), F.lit(0))).first()[0]
    joined = candidates.join(entities, "entity").join(counts.where(F.col("term") != ""), "term")
    pmi, ic = F.log2(F.lit(float(n_docs)) * F.col("n_tc") / (F.col("n_t") * F.col("n_c"))), F.log2(F.lit(float(n_docs)) / F.col("n_c"))
    scored = joined.select("entity", "term", pmi.alias("pmi"), ic.alias("ic"))
    return settle(scored.where((F.col("ic") > 0) & (F.col("pmi") >= alpha * F.col("ic"))).withColumn("removed", F.col("pmi") >= F.col("ic") - 1e-9))


def all_spans(text: str, table: dict[str, dict[str, bool]]) -> tuple[list[Span], list[tuple[int, int, bool]]]:
    """(base spans, (start, end, removed) of the terms that disclose an entity of the text)."""
    base = base_spans(text)
    mine: dict[str, bool] = {}
    for key in {entity_key(text, span) for span in base} if table else ():
        for t, removed in table.get(key, {}).items():
            mine[t] = mine.get(t, False) or removed
    return base, [(s, e, mine[t]) for t, s, e in document_terms(text, base) if t in mine] if mine else []


def word_class(word: str) -> str:
    """What a generalised term tells no more than: the shape of the word."""
    return "[ACRONYM]" if word.isupper() else "[NAME]" if word[0].isupper() else "[WORD]"


def masked(text: str, base: list[Span], terms: list[tuple[int, int, bool]]) -> str:
    """Entities become their kind; overlapping ones become one, named by the first. Terms are generalised or removed."""
    out, at = [], 0
    for s, e, label in sorted([(s, e, f"[{k.upper()}]") for k, s, e in base] + [(s, e, "" if r else word_class(text[s:e])) for s, e, r in terms]):
        if s >= at:
            out += [text[at:s], label]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _with_terms(docs: DataFrame, found: DataFrame, text_col: str, terms_col: str = "_terms") -> tuple[DataFrame, dict]:
    """The documents with a column of terms (null if the table is small and comes back as a dict)."""
    if found.count() <= BROADCAST_TERMS:
        table: dict[str, dict[str, bool]] = {}
        for r in found.toLocalIterator():
            table.setdefault(r.entity, {})[r.term] = r.removed
        return docs.withColumn(terms_col, F.lit(None).cast("array<struct<entity:string,term:string,removed:boolean>>")), table
    # each document with entities gets the terms of its own entities; the rest take no part in the join
    spark = docs.sparkSession
    has_col, key_col = f"{terms_col}_has", f"{terms_col}_key"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, e) for k, t in zip(column(b, "_key"), column(b, "text")) for e in {entity_key(t, s) for s in base_spans(t)}]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.string()) for x in (zip(*out) if out else [[], []])], names=["_key", "entity"])

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            has = pa.array([bool(base_spans(t or "")) for t in column(b, text_col)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, has], names=[*b.schema.names, has_col])

    small_batches(spark)
    kinds = "array<struct<entity:string,term:string,removed:boolean>>"
    every = docs.mapInArrow(tagged, StructType([*docs.schema.fields, StructField(has_col, BooleanType())]))
    plain = every.where(~F.col(has_col)).drop(has_col).withColumn(terms_col, F.lit(None).cast(kinds))
    keyed = every.where(F.col(has_col)).drop(has_col).withColumn(key_col, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    named = keyed.select(F.col(key_col).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(keys, "_key string, entity string").distinct()
    lists = named.join(found, "entity").groupBy("_key").agg(F.collect_list(F.struct("entity", "term", "removed")).alias(terms_col))
    return plain.unionByName(keyed.join(lists.withColumnRenamed("_key", key_col), key_col, "left").drop(key_col)), {}


def _table(rows, default: dict) -> dict:
    if rows is None:
        return default
    table: dict[str, dict[str, bool]] = {}
    for r in rows:
        table.setdefault(r["entity"], {})[r["term"]] = r["removed"]
    return table


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined), n_terms."""
    joined, table = _with_terms(docs.select(id_col, text_col), disclosures(docs, text_col, **thresholds), text_col)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_terms", pa.int64())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, rows in zip(column(b, "text"), column(b, "_terms")):
                base, terms = all_spans(text, _table(rows, table))
                n = Counter(k for k, _, _ in base)
                join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                out.append((*(n[k] for k in KINDS[:4]), hashlib.sha256(join(base).encode()).hexdigest(), join(in_order(base + [("term", s, e) for s, e, _ in terms])), len(terms)))
            cols = zip(*out) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, type=f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema)

    rows = joined.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), "_terms")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long")


def redact(docs: DataFrame, text_col: str = "text", **thresholds) -> DataFrame:
    """The documents with sanitised texts; all other columns as they are. Null texts stay null."""
    own = "_terms_" + uuid.uuid4().hex[:8]  # no column of the input goes by it
    joined, table = _with_terms(docs, disclosures(docs, text_col, **thresholds), text_col, own)
    names = joined.columns

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if t is None else masked(t, *all_spans(t, _table(rows, table))) for t, rows in zip(column(b, text_col), column(b, own))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_col else b.column(i) for i, c in enumerate(names)], names=names)

    return joined.mapInArrow(run, joined.schema).drop(own)
