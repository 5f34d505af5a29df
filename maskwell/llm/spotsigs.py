"""Document fingerprints: SpotSigs, in DataFrame and SQL functions only.

A spot is a run of common words (the anchor is its last one; the start of the text is one too) with the CHAIN content words
that follow it, common words left out. Where a stretch of content words goes on for longer (tables, lists, other
languages), each word with LONG or more of them between itself and the last common word is an anchor too, with the CHAIN words
after it in the stretch. So anchors depend on what stands near them only, and an edit changes the spots around it. The
signatures of a text are the distinct 64-bit hashes of its spots, sorted; the likeness of two texts is the Jaccard similarity
of their signatures.

search() compares a set of queries with all texts, each different set of signatures once. Signature sets are partitioned by length: only sets whose
lengths differ by a factor of at most the threshold can be that similar, and the bounds of the partitions grow by that
factor, so a query meets its own partition and the two beside it. Jaccard is pruned twice: two similar sets share one
of the first n - ceil(threshold * n) + 1 signatures in sorted order (only these are joined), and a pair whose lengths
rule it out is not compared.

Words: runs of letters, digits and non-ASCII characters, in lower case. Null texts count as empty; all texts without
content words are alike. Repeated rows have equal results. The next document is that of the next id in ascending order (null ids
first, equal ids by text); after the last one comes the first, and a single document follows itself. Extra
columns are not read. Texts are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle

#: Common words of four languages (fixed values).
ANCHORS = (
    "the of and to in a is that for it on was as with be by this at are from an or not have "
    "de la le les des et en un une du que pour dans est sur au par il ce se qui ne pas plus avec "
    "der die das und den von zu mit ist im dem nicht ein eine auf für sich auch als bei nach wird "
    "el los las y del con por para una su al lo como más pero sus ya o muy sin sobre"
).split()
CHAIN = 2
LONG = 6
#: So many of the signatures that queries share are put last; any order gives the same pairs.
COMMON = 1000


def trie_pattern(words: list[str]) -> str:
    """A pattern of the words that looks at each character once."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ends = "" in node
        ways = [c + pattern(n) for c, n in sorted(node.items()) if c]
        return "" if not ways else ways[0] if len(ways) == 1 and not ends else f"(?:{'|'.join(ways)})" + "?" * ends

    return pattern(tree)


#: In the normal form each word stands between two spaces of its own, so neighbours don't share one. The possessive
#: quantifier keeps Java's matcher from recursing once for each word of a long run; the group is the run's last word.
RUN = f"(?: ({trie_pattern(ANCHORS)}) )++"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: str) -> str:
    """SQL for the normal form of a text expression."""
    return f"concat(' ', trim(regexp_replace(lower({text}), r'{_GAP}', '  ')), ' ')"


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the column `name` with the signatures of the text column."""
    parts, anchors, heads, gaps = (f"_{name}_{x}" for x in ("parts", "anchors", "heads", "gaps"))
    # anchor and stretch by turns; each stretch has a word but perhaps the first and the last
    df = df.withColumn(parts, F.expr(f"split(concat('^\\u0002', regexp_replace({normal(text)}, '{RUN}', '\\u0001$1\\u0002')), '\\u0001')"))
    df = df.withColumn(anchors, F.expr(f"transform({parts}, p -> substring_index(p, '\\u0002', 1))"))
    df = df.withColumn(heads, F.expr(f"transform({parts}, p -> rtrim(substring_index(substring_index(p, '\\u0002', -1), '  ', {CHAIN})))"))
    # the first CHAIN words of a stretch and those after it, as a text; short of some at the end of the text
    after = lambda i: f"rtrim(substring_index(concat_ws(' ', {', '.join(f'get({heads}, {i} + {k})' for k in range(CHAIN))}), '  ', {CHAIN}))"
    full = f"length(x) - length(replace(x, '  ', ' ')) = {CHAIN - 1}"
    spots = f"transform({anchors}, (a, i) -> get(transform(array({after('i')}), x -> case when i > 0 and {full} then xxhash64(a, x) end), 0))"
    start = f"xxhash64('^', case when {heads}[0] = '' then {after('1')} else {after('0')} end)"
    # stretches of more than LONG + CHAIN words
    word = lambda k: f"get(w, i + {LONG + k})"
    inner = f"transform(slice(w, {LONG + 1}, greatest(0, size(w) - {LONG + CHAIN})), (x, i) -> xxhash64('', {', '.join(map(word, range(CHAIN + 1)))}))"
    long = f"filter({parts}, p -> length(substring_index(p, '  ', {LONG + CHAIN})) < length(p))"
    df = df.withColumn(gaps, F.expr(f"flatten(transform({long}, p -> get(transform(array(split(trim(substring_index(p, '\\u0002', -1)), '  ')), w -> {inner}), 0)))"))
    df = df.withColumn(name, F.expr(f"array_sort(array_distinct(concat(array({start}), array_compact({spots}), {gaps})))"))
    return df.drop(parts, anchors, heads, gaps)


def likeness(a: str, b: str):
    """Jaccard similarity of two columns of signatures."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


#: Ranges of ids for each task of the ranges' shuffle, so that tasks get nearly equal shares.
RANGES = 4


def range_of(bounds: list[int], id_col: str) -> str:
    """SQL for the number of ascending bounds below the id: groups of bounds first, then those of one group, so that an
    id is compared with twice the square root of their number."""
    if not bounds:
        return "0"
    g = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + g] for i in range(0, len(bounds), g)] + [[]]
    array = lambda xs: f"array({', '.join(f'{x}L' for x in xs)})" if xs else "cast(array() AS array<bigint>)"
    full = f"size(filter({array([x[-1] for x in groups if len(x) == g])}, b -> b < `{id_col}`))"
    return f"get(transform(array({full}), k -> k * {g} + size(filter(get(array({', '.join(map(array, groups))}), k), b -> b < `{id_col}`))), 0)"


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> tuple[DataFrame, W]:
    """The rows with _bucket (a range of ids) and _guest: the first row of each range stands at the end of the range
    before as a guest too, so that the next row of each row is in its own range. With the window of that order.
    One shuffle, by range, which the window's order needs too; only the ranges' bounds and first ids come to the driver."""
    spark = docs.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = RANGES * tasks
    bounds = docs.agg(F.percentile_approx(id_col, [k / n for k in range(1, n)], 10 * n)).first()[0]
    bounds = sorted(set(bounds or []))
    bucket = F.expr(range_of(bounds, id_col))
    bucket = F.when(F.col(id_col).isNull(), -1).otherwise(bucket)
    firsts = {r[0]: r[1] for r in docs.select(F.col(id_col).alias("id"), bucket.alias("b")).groupBy("b").agg(F.min("id")).collect()}
    order = sorted(firsts)
    before = dict(zip((firsts[b] for b in order), [order[-1:], *([b] for b in order)]))
    known = [x for k, v in before.items() if k is not None for x in (F.lit(k), F.lit(v[0]))]
    guest = F.try_element_at(F.create_map(*known), F.col(id_col)) if known else F.lit(None)
    guest = F.when(F.col(id_col).isNull(), F.lit(before[None][0]) if None in before else F.lit(None)).otherwise(guest)
    rows = docs.select(*columns, bucket.alias("_own"), guest.cast("int").alias("_before"))
    places = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_own").alias("_bucket"), F.lit(False).alias("_guest")))).otherwise(F.array(F.struct(F.col("_own").alias("_bucket"), F.lit(False).alias("_guest")), F.struct(F.col("_before").alias("_bucket"), F.lit(True).alias("_guest"))))
    rows = rows.withColumn("_place", F.explode(places)).select(*columns, "_place.*").repartitionByRange(tasks, "_bucket")
    return rows, W.partitionBy("_bucket").orderBy("_guest", F.col(id_col).asc_nulls_first(), *[c for c in columns if c != id_col])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_chars, signatures, edited (the last quarter of the code points replaced by the first of the next
    document), edited_signatures, next_signatures."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, window = with_next(rows, "doc_id", ["doc_id", "text"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_quarter", (F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumn("_next", F.lead("text").over(window))
    rows = with_signatures(rows, "text", "signatures").withColumn("next_signatures", F.lead("signatures").over(window)).where(~F.col("_guest"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - _quarter)), substring(_next, 1, _quarter))"))
    return with_signatures(rows, "edited", "edited_signatures").select("doc_id", "text", "n_chars", "signatures", "edited", "edited_signatures", "next_signatures")


def length_partition(size: str, threshold: float):
    """The number of the length partition of a set of this size."""
    return F.floor(F.log(F.col(size).cast("double")) / F.lit(-math.log(threshold))).cast("int")


def search(queries: DataFrame, docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, similarity: all texts that are as similar as the threshold to a query (0 < threshold < 1). Rows with
    equal signatures are compared once, and named one by one at the end only."""

    def prepared(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        rows = with_signatures(df.select(F.col(id_col).cast("long").alias(name), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "_s").drop("text")
        rows = settle(rows.withColumn(f"{name}_set", F.sha2(F.array_join(F.col("_s").cast("array<string>"), ","), 256)))
        sets = rows.groupBy(f"{name}_set").agg(F.first("_s").alias(f"{name}_s")).withColumn(f"{name}_n", F.size(f"{name}_s"))
        return rows.select(name, f"{name}_set").distinct(), sets

    (q_rows, q), (d_rows, d) = prepared(queries, "query_id"), prepared(docs, "doc_id")
    # signatures that many queries share come last in every set, so they are joined only where a set has hardly any others
    common = q.select(F.explode("query_id_s").alias("spot")).groupBy("spot").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "spot").limit(COMMON).collect()
    last = F.array(*[F.lit(r.spot) for r in reversed(common)]).cast("array<bigint>")

    def spots(df: DataFrame, name: str) -> DataFrame:
        ordered = F.concat(F.array_except(f"{name}_s", last), F.array_intersect(last, F.col(f"{name}_s")))
        first = F.slice(ordered, F.lit(1), (F.col(f"{name}_n") - F.ceil(F.col(f"{name}_n") * threshold - 1e-9) + 1).cast("int"))
        return df.withColumn("_part", length_partition(f"{name}_n", threshold)).withColumn("_spot", F.explode(first))

    near = spots(q, "query_id").withColumn("_part", F.explode(F.expr("sequence(_part - 1, _part + 1)")))
    pairs = near.select("query_id_set", "query_id_n", "_part", "_spot").join(spots(d, "doc_id").select("doc_id_set", "doc_id_n", "_part", "_spot"), ["_part", "_spot"])
    pairs = pairs.where(F.least("query_id_n", "doc_id_n") >= threshold * F.greatest("query_id_n", "doc_id_n") - 1e-9).select("query_id_set", "doc_id_set").distinct()
    scored = pairs.join(q, "query_id_set").join(d, "doc_id_set").withColumn("similarity", likeness("query_id_s", "doc_id_s")).where(F.col("similarity") >= threshold - 1e-12)
    return scored.select("query_id_set", "doc_id_set", "similarity").join(q_rows, "query_id_set").join(d_rows, "doc_id_set").select("query_id", "doc_id", "similarity")
