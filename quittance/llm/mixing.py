"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each source gets a target of words by water filling: the budget is shared by
weight, a source stops at ``max_copies`` times its size and the excess is shared
again.  A source's documents then all expect target/size copies.  They are put in
an order, their expected copies are prefix-summed, one offset drawn from the
source's name is added, and a document is emitted once per integer the sum
crosses.  Documents are ordered by size class first, so the words taken follow
the target closely.

The prefix sum has three levels so that no task holds a whole source: rows within
a block (source, size class, salt) of about the square root of its class, blocks
within the source, and the telescoped floor.

Cases: null or empty text has size 0; the null source is a source, last in order;
a source of size 0 has target 0 and is never taken; repeated rows count each;
ties in doc_id are ordered by the row's text hash and else are equal rows; a null
doc_id comes last; no document, however long, is split; an empty table gives an
empty result; columns with the names of the result's give way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quittance.llm.common import fresh, n_words, save, small

WEIGHTS = (3.0, 1.0, 2.0)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_copies: float = 2.0) -> DataFrame:
    """sizes(src, source_size) -> with target.  One row per source; the window runs over these rows only.

    With caps c = max_copies * size, sources are filled in order of c / weight: all
    those whose cap lies below the level that the rest would then reach.
    """
    nth = F.row_number().over(W.orderBy(F.col("src").asc_nulls_last()))
    d = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((nth - 1) % len(weights) + 1).cast("int")))
    d = d.withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    order = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("src").asc_nulls_last())
    below, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = d.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    d = d.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(rest))
    fits = F.col("level") * F.col("w") <= F.col("cap")
    d = d.withColumn("lambda", F.first(F.when(fits, F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    fill = F.least(F.col("cap"), F.coalesce(F.col("lambda") * F.col("w"), F.col("cap")))
    return d.select("src", "source_size", fill.alias("target"))


def size_class(size: Column) -> Column:
    """Four classes per power of two, from the binary digits (no logarithm, so no rounding)."""
    digits = F.bin(size + 4)
    return (F.length(digits) * 4 + F.conv(F.substring(digits, 2, 2), 2, 10).cast("int")).cast("int")


def salt_of(doc_id: Column, n: Column) -> Column:
    mixed = F.pmod(F.pmod(F.coalesce(doc_id, F.lit(0)), F.lit(1000003)) * 7919, F.lit(1000003))
    return F.pmod(mixed, n)


def offset_of(src: Column, seed: str) -> Column:
    """In [0, 1), a multiple of 2**-20, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), src), F.lit("-")))), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)


def mixed_rows(docs: DataFrame, carry: Sequence[str], doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_copies: float = 2.0) -> DataFrame:
    """row (a struct of the columns in carry), src, key, tie, size, source_size, target, copies."""
    slim = [F.col(source).cast("string").alias("src"), F.col(doc_id).cast("long").alias("key"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(text).cast("string")).alias("tie")]
    light = docs.select(*slim)
    light = save(light.withColumn("cls", size_class(F.col("size"))), "mix-sizes")
    if set(carry) <= {doc_id, source}:
        d = light.withColumn("row", F.struct(*[F.col({doc_id: "key", source: "src"}[c]).alias(c) for c in carry]))
    else:
        d = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), *slim).withColumn("cls", size_class(F.col("size")))
    classes = light.groupBy("src", "cls").agg(F.count("*").alias("n"), F.sum("size").alias("class_size"))
    classes = classes.withColumn("blocks", F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long"))
    sized = targets(classes.groupBy("src").agg(F.sum("class_size").cast("long").alias("source_size")), weights, share, max_copies)
    sized = sized.select(F.col("src").alias("s2"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))
    known = classes.join(sized, F.col("src").eqNullSafe(F.col("s2"))).select(F.col("src").alias("s1"), F.col("cls").alias("c1"), "blocks", "source_size", "target", "rate", offset_of(F.col("src"), seed).alias("start"))

    def salted(df: DataFrame) -> DataFrame:
        joined = df.join(known, F.col("src").eqNullSafe(F.col("s1")) & (F.col("cls") == F.col("c1"))).drop("s1", "c1")
        return joined.withColumn("salt", salt_of(F.col("key"), F.col("blocks")))

    d = salted(d).withColumn("pos", F.row_number().over(W.partitionBy("src", "cls", "salt").orderBy("size", F.col("key").asc_nulls_last(), "tie")))
    blocks = salted(light).groupBy("src", "cls", "salt").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("src").orderBy("cls", "salt").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("src").alias("s3"), F.col("cls").alias("c3"), F.col("salt").alias("t3"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    d = d.join(blocks, F.col("src").eqNullSafe(F.col("s3")) & (F.col("cls") == F.col("c3")) & (F.col("salt") == F.col("t3")))
    rank = F.col("before") + F.col("pos")
    crossed = F.floor(rank * F.col("rate") + F.col("start")) - F.floor((rank - 1) * F.col("rate") + F.col("start"))
    return d.select("row", "src", "key", "tie", "size", "source_size", "target", crossed.cast("long").alias("copies"))


OWN = ("size", "source_size", "target", "copies")


def mix(docs: DataFrame, carry: Sequence[str] | None = None, **options) -> DataFrame:
    """The columns in carry (all, if not given) with size, source_size, target, copies; columns of docs with these names give way."""
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in OWN]
    return mixed_rows(docs, carry, **options).select(*[F.col("row")[c].alias(c) for c in carry], *OWN)


def _copied(mixed: DataFrame, name: str) -> DataFrame:
    return mixed.filter("copies > 0").withColumn(name, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy of mix()'s rows, with copy_no from 1."""
    return _copied(mixed, "copy_no")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix itself, a document once per copy; copy_no counts them (with _ before it if docs has that name).

    Copies are worked out on ids, sizes and hashes; texts take part in one join only.  Rows
    that are equal in source, doc_id and text share their copies: those equal in all columns
    become one row with the copies of all, and variants share by their numbers.  Null
    sources, ids and texts are as in the module's cases; an empty table stays empty.
    """
    number, s1, k1, t1, s2, k2, t2, times, before = fresh(docs, "copy_no", "s1_", "k1_", "t1_", "s2_", "k2_", "t2_", "times_", "before_")
    mixed = mixed_rows(docs.select("doc_id", "source", "text"), ["doc_id"]).groupBy("src", "key", "tie").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows_"))
    mixed = save(mixed.filter("copies > 0").select(F.col("src").alias(s2), F.col("key").alias(k2), F.col("tie").alias(t2), "copies", "rows_"), "mix-copies")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias(s1), F.col("doc_id").cast("long").alias(k1), F.xxhash64(F.col("text").cast("string")).alias(t1))

    def with_copies(part: DataFrame) -> DataFrame:
        right = F.broadcast(part) if small(part, 80) else part
        return keyed.join(right, (keyed[t1] == right[t2]) & keyed[k1].eqNullSafe(right[k2]) & keyed[s1].eqNullSafe(right[s2]))

    once = save(mixed.filter("rows_ = 1"), "mix-once")
    out = with_copies(once).select("row", "copies")
    more = save(mixed.filter("rows_ > 1"), "mix-more")
    if more.head(1):
        each = with_copies(more).groupBy("row", s1, k1, t1, "copies", "rows_").agg(F.count("*").alias(times))
        ahead = W.partitionBy(s1, k1, t1).orderBy(F.xxhash64("row"), "row").rowsBetween(W.unboundedPreceding, -1)
        each = each.withColumn(before, F.coalesce(F.sum(times).over(ahead), F.lit(0)))
        upto = lambda n: F.floor(n * F.col("copies") / F.col("rows_"))
        out = out.unionByName(each.select("row", (upto(F.col(before) + F.col(times)) - upto(F.col(before))).cast("long").alias("copies")))
    return _copied(out, number).select(*[F.col("row")[c].alias(c) for c in docs.columns], number)
