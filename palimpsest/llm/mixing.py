"""Mixing sources to target weights with hash-threshold histograms (operator 9).

Each document has a 60-bit hash.  A source whose target is ``r`` times its size keeps every document ``floor(r)``
times, and once more those whose hash is below a threshold.  The threshold comes from histograms: words are summed by
source and the next bits of the hash, the bucket in which the budget ends is found, and only that bucket is refined,
until it holds one hash.  No document is sorted, and a source of any size costs one row per bucket and task.

Defined results: a null or empty text has size 0, a very long one counts whole; a null source is a source of its own,
the last; a document with a null ``doc_id`` is hashed by its text; repeated rows, which share a hash, are taken
together; ties in a source's order can't be, as sources are distinct; an empty table gives no rows; a source of size 0
has target 0; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2.0
HASH_BITS, LEVEL_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The first 60 bits of the MD5 of the id's decimal text, or of the text itself where there is no id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))), 1, 15), 16, 10).cast("long")


def _ranked(totals: DataFrame) -> DataFrame:
    """``totals``, one row per source, with ``rank`` from 0 in the sources' order, null last.

    Sources are sorted over range partitions, whose row counts alone meet in one task: they may be as many as domains."""
    by = F.col("source").asc_nulls_last()
    placed = totals.repartitionByRange(by).sortWithinPartitions(by).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    placed = materialize(placed, "mix-ranges")
    parts = placed.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return placed.join(parts, "part").withColumn("rank", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: source, source_size, target.  Weights follow the sources by code point, null last.

    Resharing what exceeds the caps by weight ends where every source has ``min(cap * size, x * weight)``; x is found
    by a few sums over the table of sources, which itself is never collected."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    totals = materialize(_ranked(totals).withColumn("weight", weight).drop("rank"), "mix-sources")
    limit = cap * F.col("source_size")
    budget = share * (totals.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        over = limit <= F.col("weight") * F.lit(level)
        full, open_weight = totals.agg(F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight or (found := (budget - full) / open_weight) <= level:
            break
        level = found
    return totals.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(level)).alias("target"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: copies (of every document) and limit (documents whose hash is below it get one more copy).

    plan: source, source_size, target.  The last hash is taken if that comes nearer to the target."""
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = plan.select("source", ratio.cast("long").alias("copies"), (F.col("target") - ratio * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("low"))
    for done in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        width = 1 << (HASH_BITS - done)
        s, d = state.alias("s"), sized.alias("d")
        inside = d.join(s, same(F.col("s.source"), F.col("d.source")) & (F.col("d.hash") >= F.col("s.low")) & (F.col("d.hash") < F.col("s.low") + F.lit(width << LEVEL_BITS)))
        bucket = F.shiftright(F.col("d.hash") - F.col("s.low"), HASH_BITS - done)
        sums = inside.groupBy(F.col("d.source").alias("source"), bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        nested = sums.withColumn("upto", upto).alias("n").join(state.alias("s"), same(F.col("n.source"), F.col("s.source")), "right")
        whole = F.col("n.upto") <= F.col("s.left")
        found = nested.groupBy(F.col("s.source").alias("source"), F.col("s.copies").alias("copies"), F.col("s.left").alias("before"), F.col("s.low").alias("from")).agg(
            F.coalesce(F.max(F.when(whole, F.col("n.upto"))), F.lit(0)).alias("spent"),
            F.min(F.when(~whole, F.struct("n.bucket", "n.words"))).alias("edge"),
        )
        end = F.lit(1 << LEVEL_BITS)
        at = F.coalesce(F.col("edge.bucket"), end)
        if done == HASH_BITS:  # a bucket is one hash: take it or leave it
            at += F.when((F.col("edge.words") - (F.col("before") - F.col("spent"))) < (F.col("before") - F.col("spent")), 1).otherwise(0)
        state = found.select("source", "copies", (F.col("before") - F.col("spent")).alias("left"), (F.col("from") + at * F.lit(width)).alias("low"))
        state = materialize(state, "mix-level")
    return state.select("source", "copies", F.col("low").alias("limit"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and copies (taken is copies times size)."""
    narrow = docs.select("doc_id", "source", word_count().alias("size"), document_hash().alias("hash"))
    sized = materialize(narrow, "mix-sizes")
    plan = targets(sized, weights, share, cap)
    chosen = thresholds(sized, plan)
    per = plan.alias("p").join(chosen.alias("c"), same(F.col("p.source"), F.col("c.source"))).select("p.source", "p.source_size", "p.target", "c.copies", "c.limit")
    copies = (F.col("m.copies") + (F.col("d.hash") < F.col("m.limit")).cast("long")).alias("copies")
    joined = sized.alias("d").join(per.alias("m"), same(F.col("d.source"), F.col("m.source")))
    return joined.select("d.doc_id", "d.size", "m.source_size", "m.target", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` itself with each document as often as the mix takes it; sources and sizes are those of ``docs``."""
    sized = materialize(docs.select("source", word_count().alias("size"), document_hash().alias("hash")), "mix-sizes")
    plan = targets(sized, **options)
    chosen = thresholds(sized, plan).alias("m")
    names = docs.columns
    kept = docs.alias("d").withColumn("__hash", document_hash("d.doc_id", "d.text")).join(chosen, same(F.col("d.source"), F.col("m.source")))
    copies = (F.col("m.copies") + (F.col("__hash") < F.col("m.limit")).cast("long")).cast("int")
    each = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))
    return kept.select(*[F.col(f"d.`{n}`") for n in names], each.alias("__copy")).drop("__copy")
