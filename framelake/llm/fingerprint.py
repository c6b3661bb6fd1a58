"""Bottom-k sketches of word shingles, in DataFrame functions alone.

A sketch is the ascending array of the ``k`` least distinct 64-bit hashes of a text's shingles of
five words (a text of one to four words is one shingle; an empty one has none).  Sketches of
parts merge into the sketch of the whole, and estimate resemblance, containment and the number
of distinct shingles; below k shingles the estimates are exact.

Results: null text: empty.  Two empty sketches resemble each other fully; an empty one is fully
contained.  Ties of doc_id are ordered by a hash of the text and the text; a null doc_id is the least.
Repeated rows each have a row. Texts of any length count whole. Empty tables give no rows; other columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.ordering import CUTS, RANGE, ranges

K = 128
SHINGLE = 5


def with_sketch(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """``name``: the sketch of a text column.  Intermediate arrays are columns of their own, as a
    lambda would compute them anew for every element."""
    words, codes = f"__words_{name}", f"__codes_{name}"
    df = df.withColumn(words, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = df.withColumn(codes, F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size(codes)
    later = lambda i, j: F.get(F.col(codes), i + j)
    runs = F.transform(F.slice(codes, 1, F.greatest(n - (SHINGLE - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[later(i, j) for j in range(1, SHINGLE)]))
    short = F.array(F.xxhash64(F.array_join(words, " "), n))
    shingles = F.when(n >= SHINGLE, runs).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop(words, codes)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per group of parts.  Hashes stay rows until only k of each group are left, so
    a group of any size is thinned before it meets."""
    hashes = df.select(*keys, F.explode(sketch).alias("__h"), F.spark_partition_id().alias("__part"))
    near = Window.partitionBy(*keys, "__part").orderBy("__h")
    whole = Window.partitionBy(*keys).orderBy("__h")
    for w in (near, whole):
        hashes = hashes.withColumn("__rank", F.dense_rank().over(w)).where(F.col("__rank") <= k).drop("__rank")
        hashes = hashes.dropDuplicates([*keys, "__part", "__h"]) if w is near else hashes.dropDuplicates([*keys, "__h"])
    return hashes.groupBy(*keys).agg(F.sort_array(F.collect_set("__h")).alias(sketch))  # k values at most


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    n = F.size(sketch)
    share = (F.element_at(sketch, F.lit(k)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(n < k, n.cast("double")).otherwise((k - 1) / share)


def _shared(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    both = merge(a, b, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), both)), F.size(both)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard index, 0 to 1."""
    same, of = _shared(a, b, k)
    return F.when(of == 0, 1.0).otherwise(same / of)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def as_text(sketch: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits per hash, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _dealt(docs: DataFrame, rows_per_range: int) -> DataFrame:
    """``docs`` with RANGE: numbers that ascend with doc_id, null least, about ``rows_per_range`` rows to each.  An id
    with so many rows that quantiles repeat it is divided by a hash of the text; ``tie`` has that hash."""
    total, nulls = docs.select(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    dealt = ranges(docs, "doc_id", max(1, total // rows_per_range))
    busy = []
    if total > CUTS * rows_per_range:
        quantiles = docs.select(F.percentile_approx("doc_id", [i / CUTS for i in range(1, CUTS + 1)], 20 * CUTS)).first()[0] or []
        busy = sorted({a for a, b in zip(quantiles, quantiles[1:], strict=False) if a == b})
    parts = 1 + (total if busy else nulls) // rows_per_range
    dealt = dealt.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    hot = F.col("doc_id").isin(busy) if busy else F.lit(False)
    last = F.lit(parts - 1).cast("long")
    sub = last - F.least(F.floor(F.col("tie") / (2.0**63 / parts)).cast("long"), last)  # the least hash comes first, in the greatest range
    # an id that is divided stands alone in its range, its neighbours below and above it
    below = F.size(F.filter(F.lit(busy), lambda x: x < F.col("doc_id"))) if busy else F.lit(0)
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(2 * below + hot.cast("int")).cast("long")
    return dealt.withColumn(RANGE, F.struct(F.col(RANGE).alias("gap"), place.alias("place"), F.when(hot | F.col("doc_id").isNull(), sub).otherwise(F.lit(0).cast("long")).alias("sub")))


def next_documents(docs: DataFrame, derive: Callable[[DataFrame], DataFrame], rows_per_range: int = 2000) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with the columns of ``derive``, and as ``next_*`` those of the
    row after it by descending doc_id (after the last: the first).  Rows are dealt to ranges of
    doc_id once; windows run within ranges, and only each range's first row crosses to the one before."""
    dealt = _dealt(docs, rows_per_range)
    inside = Window.partitionBy(RANGE).orderBy(F.desc_nulls_last("doc_id"), "tie", F.asc("text"))
    derived = derive(dealt)
    columns = [c for c in derived.columns if c not in ("doc_id", "tie", RANGE)]
    # each range's first row goes to the range before it; only the first rows of each task are shuffled for this
    first = dealt.withColumn("__place", F.row_number().over(inside)).where("__place = 1").drop("__place")
    edge = derive(first).join(_range_before(dealt.select(RANGE).distinct()), RANGE).select(F.col("__to").alias(RANGE), F.lit(True).alias("__edge"), *[F.col(c).alias(f"__edge_{c}") for c in columns])
    out = derived.withColumns({"__last": F.lead(F.lit(0)).over(inside).isNull()} | {f"next_{c}": F.lead(c).over(inside) for c in columns})
    out = out.join(edge, RANGE, "left")
    return out.select("doc_id", *columns, *[F.when(F.col("__last"), F.col(f"__edge_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in columns])


def _range_before(known: DataFrame) -> DataFrame:
    """(RANGE, __to): of every range the one before it in descending order; the first has the last.  Ranges are
    taken some hundreds at a time, and one row of each such lot crosses to the next."""
    known = known.select(RANGE, F.floor(F.col(f"{RANGE}.gap") / 512).alias("lot"))
    down = Window.partitionBy("lot").orderBy(F.desc(RANGE))
    lots = known.groupBy("lot").agg(F.min(RANGE).alias("least"))
    across = Window.orderBy(F.desc("lot"))  # one row per lot
    lots = lots.select("lot", F.coalesce(F.lag("least").over(across), F.min("least").over(Window.partitionBy())).alias("before"))
    return known.withColumn("own", F.lag(RANGE).over(down)).join(lots, "lot").select(RANGE, F.coalesce("own", "before").alias("__to"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half (rounded down) replaced by as much of the start of ``following``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(following, half))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Sketches of every text and of its edited text (see ``edited``), and how alike they are."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = next_documents(docs, lambda df: with_sketch(df, "text", "sketch", k))
    pairs = pairs.withColumn("edited", edited(F.col("text"), F.col("next_text"))).drop("next_text")
    pairs = pairs.withColumn("n_chars", F.char_length("text").cast("long")).drop("text")
    pairs = with_sketch(pairs, "edited", "edited_sketch", k)
    a, e, f = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(a).alias("fingerprint"), as_text(e).alias("edited_fingerprint"),
        resemblance(a, e, k).cast("double").alias("near_edited"), resemblance(a, f, k).cast("double").alias("near_next"), distinct_shingles(a, k).alias("n_shingles"), containment(a, e, k).cast("double").alias("in_edited"),
    )
