"""Importance resampling towards a target distribution, over hashed word n-grams of a position table.

Words are exploded with their positions; ``lead()`` over a document's positions puts
the following words beside each, so every order is one concatenation.  Features are
hashed to buckets, counted over all documents and over the target, and the log ratio
of the two smoothed distributions is a bucket's gain.  A document's weight is the sum
of its features' gains; with Gumbel noise from a hash of its id, the highest scores
are a draw without replacement in proportion to exp(weight).

Documents are read twice, and nothing but bucket counts and one row per document is
shuffled while single words are the features.  Longer orders shuffle the position
table once, cut into blocks of ``BLOCK`` positions that overlap by what the longest
order looks ahead, so a very long document is many groups.  Ranks come from a range
partitioning by score: rows within a range, ranges by their counts.

Cases: a null or empty text has no features and weight 0; a null doc_id is noise of
an empty id and comes last among ties; repeated rows count each in the statistics,
are weighed once and drawn each; columns of docs other than the id and the text are
not read; an empty table of documents gives an empty result, an empty target the
gains of the smoothing alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quittance.llm.common import save, small

#: Words before A-Z are lower-cased: digits, ASCII letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS = 10_000
BLOCK = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(word: Column) -> Column:
    """Only A-Z lower-cased."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def position_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, tie (hash of the text), pos, word: a row per word, and one with nulls for a text without words."""
    words = F.regexp_extract_all(F.col(text).cast("string"), F.lit(WORD), F.lit(0))
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("tie"), F.posexplode_outer(words).alias("pos", "word"))
    return d.withColumn("word", ascii_lower(F.col("word")))


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")


def features(docs: DataFrame, orders: Sequence[int] = (1,), buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc, tie, bucket, times, words, rows: a row per feature, and one with a null bucket for a position without.

    times is the number of equal rows of docs that the feature stands for; words and rows
    are times on one row of each word and of each document, and 0 on the others.
    """
    if not orders or min(orders) < 1 or max(orders) > block:
        raise ValueError(f"orders must lie between 1 and {block}")
    d = position_table(docs, doc_id, text)
    if set(orders) == {1}:
        d = d.select("doc", "tie", "pos", F.lit(0).alias("nth"), F.col("word").alias("gram"), F.lit(1).cast("long").alias("times"))
    else:
        reach = max(orders) - 1
        own = F.floor(F.col("pos") / block)
        blocks = F.when((F.col("pos") % block < reach) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
        d = d.withColumn("block", F.explode(blocks)).groupBy("doc", "tie", "block", "pos", "word").agg(F.count("*").alias("times"))
        following = W.partitionBy("doc", "tie", "block").orderBy("pos")
        d = d.withColumns({f"next{k}": F.lead("word", k).over(following) for k in range(1, reach + 1)}).filter(F.col("block").eqNullSafe(own))
        run = [F.col("word"), *[F.col(f"next{k}") for k in range(1, reach + 1)]]
        grams = F.array(*[F.when(run[k - 1].isNotNull(), F.concat_ws(" ", *run[:k])) for k in sorted(set(orders))])
        d = d.select("doc", "tie", "pos", "times", F.posexplode_outer(F.filter(grams, lambda g: g.isNotNull())).alias("nth", "gram"))
    leads = F.coalesce(F.col("nth") == 0, F.lit(True))
    return d.select(
        "doc", "tie", bucket_of(F.col("gram"), buckets).alias("bucket"), "times",
        F.when(leads & F.col("pos").isNotNull(), F.col("times")).otherwise(0).alias("words"), F.when(leads & F.coalesce(F.col("pos") == 0, F.lit(True)), F.col("times")).otherwise(0).alias("rows"),
    )


def counts(feats: DataFrame, name: str) -> tuple[DataFrame, int]:
    """bucket, n as a written table, one row a bucket at most; and the sum of n."""
    d = save(feats.filter("bucket is not null").groupBy("bucket").agg(F.sum("times").alias("n")), name)
    return d, d.agg(F.sum("n")).first()[0] or 0


def gains(docs: DataFrame, target: DataFrame, orders: Sequence[int] = (1,), buckets: int = BUCKETS, **columns) -> DataFrame:
    """bucket, gain of every bucket that docs use: log ratio of target to documents, in thousandths rounded down.  target needs a text only."""
    raw, all_raw = counts(features(docs, orders, buckets, **columns), "importance-documents")
    named = {"doc_id": "nth", "text": "text"}
    wanted, all_wanted = counts(features(target.select(F.lit(0).alias("nth"), F.col(columns.get("text", "text")).alias("text")), orders, buckets, **named), "importance-target")
    d = raw.join(wanted.select("bucket", F.col("n").alias("t")), "bucket", "left")
    ratio = (F.coalesce("t", F.lit(0)) + F.lit(1.0)) * F.lit(all_raw + float(buckets)) / ((F.col("n") + F.lit(1.0)) * F.lit(all_wanted + float(buckets)))
    return save(d.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain")), "importance-gains")


def gumbel(doc: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, rounded down, from the hash of the id: the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def weights(docs: DataFrame, target: DataFrame, orders: Sequence[int] = (1,), buckets: int = BUCKETS, **columns) -> DataFrame:
    """doc, tie, n_words, n_features, weight: a row per row of docs."""
    gain = gains(docs, target, orders, buckets, **columns)
    d = features(docs, orders, buckets, **columns)
    if small(gain, 16):
        gain = F.broadcast(gain)
    else:  # a document's equal features first, so that a frequent one is as many rows as there are documents with it
        d = d.groupBy("doc", "tie", "bucket").agg(*[F.sum(c).alias(c) for c in ("times", "words", "rows")])
    d = d.join(gain, "bucket", "left").groupBy("doc", "tie").agg(
        F.sum("rows").alias("rows"), F.sum("words").alias("words"), F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.col("times"))), F.lit(0)).alias("used"), F.coalesce(F.sum(F.col("times") * F.col("gain")), F.lit(0)).alias("all")
    )
    each = {"n_words": "words", "n_features": "used", "weight": "all"}
    d = d.select("doc", "tie", *[F.expr(f"{c} div rows").alias(name) for name, c in each.items()], "rows")
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows", "copy")


def ranked(scored: DataFrame, parts: int) -> DataFrame:
    """scored(doc, tie, score) with rank from 1: highest score first, then the smaller doc, null last.

    Rows are dealt out by range; only the number of rows of each range is summed in one place.
    """
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last(), F.col("tie")]
    d = save(scored.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "importance-order")
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = d.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    d = d.repartition(parts, "part").withColumn("in_part", F.row_number().over(W.partitionBy("part").orderBy(*order)))
    return d.join(F.broadcast(sizes), "part").withColumn("rank", (F.col("before") + F.col("in_part")).cast("long")).drop("part", "before", "in_part")


def resample(docs: DataFrame, target: DataFrame, orders: Sequence[int] = (1,), buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: str = "2024", **columns) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; rank is null for rows that are not drawn.

    Of the rows with least_words words or more, percent in a hundred (rounded down) are drawn.
    """
    spark = docs.sparkSession
    d = weights(docs, target, orders, buckets, **columns)
    d = save(d.withColumn("score", F.col("weight") + gumbel(F.col("doc"), seed)), "importance-scores")
    enough = F.col("n_words") >= least_words
    drawn = d.filter(enough).count() * percent // 100
    out = ranked(d.filter(enough), int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(d.filter(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of docs, whole, by id (rows that share an id go together)."""
    ids = resample(docs, target, doc_id=doc_id, **options).filter("rank is not null").select(F.col("doc_id").alias("drawn_")).distinct()
    return docs.join(ids, F.col(doc_id).cast("long").eqNullSafe(F.col("drawn_")), "left_semi")
