"""Who sent a payment: by id, by exact name, by similar name."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quittance.functions.similar import similar_in_block, similarity_above
from quittance.functions.text import SHORTEST_NEEDLE, canonical_of, is_ascii
from quittance.plans.scratch import some, written

#: A gram that more texts have is compared in blocks of so many of them.
HEAVY, BLOCK = 512, 512


def _all_ascii(df: DataFrame, name: str) -> bool:
    return not some(df.filter(~is_ascii(F.col(name))))


def ledger_names(invoices: DataFrame, stored: bool = False) -> DataFrame:
    """(name_key, customer_id): canonical names and their customer; null if several customers share one."""
    # each spelling once, by a hash: the count keeps Spark from sorting all invoices by name for min and max
    spelled = invoices.groupBy("customer_name", "customer_id").count().filter("count > 0")
    keyed = spelled.select(canonical_of(F.col("customer_name"), stored and _all_ascii(invoices, "customer_name")).alias("name_key"), "customer_id").filter("name_key <> ''")
    found = keyed.groupBy("name_key").agg(F.min("customer_id").alias("lo"), F.max("customer_id").alias("hi"))
    return found.select("name_key", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("customer_id"))


def _apart(key: Column) -> Column:
    """A key that may be null or empty, or one of the row's own: rows without a key meet nothing and do not gather in one task."""
    return F.when(key != "", key).otherwise(F.concat(F.lit("\x00"), F.col("id").cast("string")))


def with_known_id(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """payments with by_id, their own customer id if the ledger knows it."""
    if not some(payments.filter("customer_id <> ''")):
        return payments.withColumn("by_id", F.lit(None).cast(invoices.schema["customer_id"].dataType))
    known = invoices.select(F.col("customer_id").alias("by_id")).filter("by_id <> ''").distinct()
    return payments.join(known, _apart(payments["customer_id"].cast("string")) == F.col("by_id").cast("string"), "left")


def with_known_name(payments: DataFrame, names: DataFrame, stored: bool = False) -> DataFrame:
    """payments with by_name, the one customer whose name is exactly their counterparty."""
    known = names.filter("customer_id is not null").select(F.col("name_key").alias("_name"), F.col("customer_id").alias("by_name"))
    return payments.withColumn("_key", canonical_of(F.col("counterparty"), stored and _all_ascii(payments, "counterparty"))).join(known, _apart(F.col("_key")) == F.col("_name"), "left").drop("_key", "_name")


def by_id(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """(id, customer_id) of payments whose own customer id the ledger knows."""
    return with_known_id(payments, invoices).filter("by_id is not null").select("id", F.col("by_id").alias("customer_id"))


def by_name(payments: DataFrame, names: DataFrame) -> DataFrame:
    """(id, customer_id) of payments whose counterparty is exactly one customer's name."""
    return with_known_name(payments, names).filter("by_name is not null").select("id", F.col("by_name").alias("customer_id"))


def least_common(n: int, w: int, least: int) -> int:
    """Characters in order that a needle of n and a window of w share if their similarity is least."""
    return -(-least * (n + w) // 200)


def signature(n: int, least: int) -> tuple[int, int, int]:
    """(q, take, shift) for needles of n characters.

    Of any take of its q-grams, one stands unchanged in a window whose similarity is least or more,
    and at most shift places off.  A character that the window lacks breaks q of them at most, one
    that it has besides breaks q - 1.  Longer grams are rarer, so the longest are taken of which at
    most half are needed.
    """
    edits = [(n - c, w - c) for w in range(1, n + 1) if (c := least_common(n, w, least)) <= w]
    lost = {q: max(q * gone + (q - 1) * more for gone, more in edits) for q in (4, 3, 2, 1)}
    q = next((q for q in (4, 3, 2) if 2 * (lost[q] + 1) <= n - q + 1), 1)
    return q, lost[q] + 1, max(gone for gone, _ in edits)


def grams(text: Column, q: Column) -> Column:
    """Array of (gram, pos) of a text."""
    cut = F.transform(F.sequence(F.lit(0), F.length(text) - q), lambda i: F.struct(F.substring(text, i + 1, q).alias("gram"), i.alias("pos")))
    return F.when(F.length(text) >= q, cut)


def _best_in_block(least: int, needle_is_key: bool, every: bool):
    """Arrow function: similar pairs of a block of needles and a block of hays; of each key the best only, unless every pair is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for needles, hays in zip(b.column("needles").to_pylist(), b.column("hays").to_pylist(), strict=True):
                pairs = [(needles[i], hays[j], s) if needle_is_key else (hays[j], needles[i], s) for i, j, s in similar_in_block(needles, hays, least)]
                if not every:
                    best: dict[str, tuple[int, str]] = {}
                    for key, name, s in pairs:
                        best[key] = min(best.get(key, (0, "")), (-s, name))
                    pairs = [(key, name, -s) for key, (s, name) in best.items()]
                columns = zip(*pairs, strict=True) if pairs else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], ["key", "name_key", "score"])

    return run


def _one_way(needles: DataFrame, hays: DataFrame, least: int, needle_is_key: bool, every: bool, heavy: int, block: int) -> DataFrame:
    """(key, name_key, score) of pairs whose needle (text) is no longer than the hay (text) and whose similarity is least or more."""
    spark = needles.sparkSession
    lengths = [r[0] for r in needles.select(F.length("text")).distinct().collect()]
    if not lengths:
        return spark.createDataFrame([], "key string, name_key string, score int")
    known = {n: signature(n, least) for n in lengths}
    shapes = spark.createDataFrame([(n, *x) for n, x in known.items()], "n int, q int, take int, shift int")
    widths = F.array(*[F.lit(q) for q in sorted({q for q, _, _ in known.values()})])
    held = hays.select("text", F.length("text").alias("m"), F.explode(widths).alias("w")).filter("m >= w")
    held = written(held.select(F.col("text").alias("hay"), "m", F.explode(grams(F.col("text"), F.col("w"))).alias("g")).select("hay", "m", "g.gram", "g.pos"), "name-grams")
    often = written(held.groupBy("gram").agg(F.count_distinct("hay").alias("often")), "gram-counts")
    cut = needles.withColumn("n", F.length("text")).join(F.broadcast(shapes), "n")
    cut = cut.select("text", "n", "take", "shift", F.explode(grams(F.col("text"), F.col("q"))).alias("g")).select("text", "n", "take", "shift", "g.gram", "g.pos")
    cut = cut.join(often, "gram", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    rare = cut.groupBy("text", "n", "take", "shift").agg(F.array_sort(F.collect_list(F.struct("often", "gram", "pos"))).alias("all"))
    asked = written(rare.select("text", "n", "shift", F.explode(F.slice("all", F.lit(1), F.col("take"))).alias("x")).select("text", "n", "shift", "x.often", "x.gram", "x.pos").filter("often > 0"), "rare-grams")

    near = (held["m"] >= F.col("n")) & held["pos"].between(asked["pos"] - F.col("shift"), asked["pos"] + held["m"] - F.col("n") + F.col("shift"))
    few = asked.filter(F.col("often") <= heavy).join(held, (asked["gram"] == held["gram"]) & near).select(F.col("text").alias("needle"), "hay")
    few = few.withColumn("score", similarity_above(least)("hay", "needle")).filter(F.col("score") >= least)
    few = few.select(*[F.col(c).alias(name) for c, name in zip(("needle", "hay") if needle_is_key else ("hay", "needle"), ("key", "name_key"), strict=True)], "score")
    hot = asked.filter(F.col("often") > heavy).select("gram", "text", "often").distinct()
    if not hot.head(1):
        return few

    def blocks(df: DataFrame, text: str, often: str, name: str) -> DataFrame:
        dealt = F.pmod(F.xxhash64(text), F.ceil(F.col(often) / block))
        return df.withColumn(f"{name}_nth", dealt).groupBy("gram", f"{name}_nth").agg(F.sort_array(F.collect_list(text)).alias(name))

    n = hot.groupBy("gram").agg(F.count("*").alias("askers"), F.first("often").alias("often"))
    left = blocks(hot.select("gram", "text").join(n, "gram"), "text", "askers", "needles")
    right = blocks(held.select("gram", "hay").join(n, "gram", "left_semi").distinct().join(n, "gram"), "hay", "often", "hays")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = written(left, "needle-blocks").join(written(right, "name-blocks"), "gram").repartition(parts, "gram", "needles_nth", "hays_nth")
    many = met.select("needles", "hays").mapInArrow(_best_in_block(least, needle_is_key, every), "key string, name_key string, score int")
    return few.unionByName(many)


def similar_pairs(asked: DataFrame, names: DataFrame, percent: int, every: bool = True, heavy: int = HEAVY, block: int = BLOCK) -> DataFrame:
    """(key, name_key, customer_id, score) of names whose similarity exceeds percent; not every pair: those that may be a key's best.

    The shorter text's rarest grams, as many as edits can break and one more, are looked up among
    the longer one's at places that the edits allow.  A gram that more than heavy texts have meets
    them in blocks instead: two blocks are one row, whose pairs are compared side by side and
    never become rows themselves.  Keys are distinct on both sides.
    """
    spark, least = asked.sparkSession, percent + 1
    usable = names.filter(f"customer_id is not null and length(name_key) >= {SHORTEST_NEEDLE}")
    if least > 100:
        return spark.createDataFrame([], f"key string, name_key string, customer_id {usable.schema['customer_id'].dataType.simpleString()}, score int")
    keys, known = asked.filter("key <> ''").select(F.col("key").alias("text")), usable.select(F.col("name_key").alias("text"))
    pairs = _one_way(keys, known, least, True, every, heavy, block).unionByName(_one_way(known, keys, least, False, every, heavy, block)).distinct()
    return pairs.join(usable.select("name_key", "customer_id"), "name_key").select("key", "name_key", "customer_id", "score")


def by_similar_name(payments: DataFrame, names: DataFrame, percent: int) -> DataFrame:
    """(id, customer_id): the most similar unambiguous name above percent; ties go to the smallest name.

    Names are looked for with few edits first: long grams are rare, and a key that has a name
    above a step has its best name there, so only the others go on to the next step.
    """
    keyed = payments.select("id", canonical_of(F.col("counterparty")).alias("key")).filter("key <> ''")
    asked, found = written(keyed.select("key").distinct(), "asked-names"), None
    if not asked.head(1):
        return payments.sparkSession.createDataFrame([], f"id {payments.schema['id'].dataType.simpleString()}, customer_id {names.schema['customer_id'].dataType.simpleString()}")
    names = written(names, "ledger-names")
    for least in sorted({max(percent, 97), max(percent, 93), percent}, reverse=True):
        pairs = similar_pairs(asked, names, least, every=False)
        best = written(pairs.groupBy("key").agg(F.min_by("customer_id", F.struct(-F.col("score"), F.col("name_key"))).alias("customer_id")), "similar-names")
        found = best if found is None else found.unionByName(best)
        if least > percent:
            asked = written(asked.join(best, "key", "left_anti"), "asked-names")
            if not asked.head(1):
                break
    return keyed.join(found, "key").select("id", "customer_id")


def resolve(payments: DataFrame, invoices: DataFrame, percent: int, fuzzy: bool = True, stored: bool = False) -> DataFrame:
    """payments with resolved, the customer they come from or null; with fuzzy a written table or a projection of one.

    stored says that both sides are tables, which can be looked at before: names go through Python only if one is not ASCII.
    """
    names = ledger_names(invoices, stored)
    out = with_known_name(with_known_id(payments, invoices), names, stored)
    if not fuzzy:
        return out.withColumn("resolved", F.coalesce("by_id", "by_name")).drop("by_id", "by_name")
    out = written(out, "known")
    rest = out.filter("by_id is null and by_name is null and counterparty <> ''").select("id", "counterparty")
    if not some(rest):
        return out.withColumn("resolved", F.coalesce("by_id", "by_name")).drop("by_id", "by_name")
    alike = by_similar_name(rest, names, percent).withColumnRenamed("customer_id", "alike")
    return written(out.join(alike, "id", "left").withColumn("resolved", F.coalesce("by_id", "by_name", "alike")).drop("by_id", "by_name", "alike"), "resolved")
