"""A ledger and a statement derived from star-schema orders and customers, by key arithmetic only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quittance.functions.money import MONEY


def padded(key: Column, least: int) -> Column:
    """A key of least digits or more: lpad alone would cut longer ones."""
    return F.when(F.length(key) < least, F.lpad(key, least, "0")).otherwise(key)


def invoices(spark: SparkSession, sf_dir: str, collide: bool = False) -> DataFrame:
    """An invoice per order.  With collide, every seventh has the amount of the customer's invoice before."""
    return _owned(spark, sf_dir, collide).drop("owner")


def _owned(spark: SparkSession, sf_dir: str, collide: bool) -> DataFrame:
    """invoices() with owner, the customer's key, by which the rows are dealt out already where the join dealt them."""
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    d = o.join(c.select("c_custkey", "c_name"), o["o_custkey"] == c["c_custkey"])
    key = F.col("o_orderkey").cast("string")
    out = d.select(
        F.concat(F.lit("i"), F.lpad(key, 9, "0")).alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.concat(F.lit("INV-"), F.year("o_orderdate").cast("string"), F.lit("-"), padded(key, 6)).alias("number"), F.to_date("o_orderdate").alias("issue_date"), F.lit(None).cast("date").alias("due_date"),
        F.col("o_totalprice").cast(MONEY).alias("amount"), F.element_at(F.array(F.lit("EUR"), F.lit("HUF"), F.lit("USD")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("currency"), F.col("o_orderkey").alias("k"), o["o_custkey"].alias("owner"),
    )
    if not collide:
        return out
    before = F.lag("amount").over(W.partitionBy("owner").orderBy("issue_date", "k"))
    return out.withColumn("before", before).withColumn("amount", F.when(F.col("k") % 7 == 0, F.coalesce("before", "amount")).otherwise(F.col("amount"))).drop("before")


def payments(spark: SparkSession, sf_dir: str, collide: bool = False) -> DataFrame:
    """Bank lines in ten shapes by order key: clean, unreferenced, short by a fee, in part, too much, two at once, by a stranger, or none.  With collide, more of them lack a reference."""
    return payments_of(invoices(spark, sf_dir, collide), collide)


def payments_of(i: DataFrame, collide: bool = False) -> DataFrame:
    """The bank lines of payments() for a ledger of invoices()."""
    return statement(_with_lines(i, "customer_id", collide))


def book(spark: SparkSession, sf_dir: str, collide: bool = False) -> DataFrame:
    """invoices() and, in columns that begin with p_, the bank line that each brings (p_id null: none): both sides in one pass."""
    return _with_lines(_owned(spark, sf_dir, collide), "owner", collide).drop("owner")


def statement(lines: DataFrame) -> DataFrame:
    """The bank lines of a book, as payments() has them; further columns p_x of the book are x."""
    first = ("id", "date", "amount", "currency", "reference", "counterparty")
    more = [c[2:] for c in lines.columns if c.startswith("p_") and c[2:] not in first]
    own = lambda c: F.col("currency" if c == "currency" else f"p_{c}").alias(c)
    return lines.filter("p_id is not null").select(*map(own, first), F.lit(None).cast("string").alias("customer_id"), "k", *map(own, more))


def _with_lines(i: DataFrame, owner: str, collide: bool) -> DataFrame:
    mod = F.col("k") % 10
    paid = F.date_add(F.col("issue_date"), (F.col("k") % 40 + 3).cast("int"))
    w = W.partitionBy(owner).orderBy("issue_date", "k")
    d = i.withColumn("date", paid).withColumn("nx", F.lead(F.struct("amount", "number", "issue_date")).over(w))
    merged = (mod == 7) & F.coalesce(F.col("nx.issue_date") <= F.date_add(F.col("date"), 5), F.lit(False))
    amount = (
        F.when(mod == 4, F.col("amount") - F.round(F.col("amount") * F.lit("0.02").cast("decimal(3,2)"), 2)).when(mod == 5, F.round(F.col("amount") * F.lit("0.60").cast("decimal(3,2)"), 2)).when(mod == 6, F.col("amount") + F.lit("25.00").cast("decimal(5,2)"))
        .when(merged, F.col("amount") + F.col("nx.amount")).otherwise(F.col("amount"))
    )
    ref = F.when(mod.isin(1, 3, 4, 5) if collide else mod == 3, "").when(merged, F.concat(F.col("number"), F.lit(" "), F.col("nx.number"))).otherwise(F.col("number"))
    return d.select(
        *i.columns, F.when(mod != 9, F.concat(F.lit("p"), F.lpad(F.col("k").cast("string"), 9, "0"))).alias("p_id"), F.col("date").alias("p_date"), amount.cast(MONEY).alias("p_amount"), ref.alias("p_reference"),
        F.when(mod == 8, "").otherwise(F.col("customer_name")).alias("p_counterparty"),
    )


def single_payments(spark: SparkSession, sf_dir: str, collide: bool = False) -> DataFrame:
    """The latest payment of each named customer and currency: no two compete, so opening balances decide."""
    p = payments(spark, sf_dir, collide).filter("counterparty <> ''")
    w = W.partitionBy("counterparty", "currency").orderBy(F.col("date").desc(), F.col("id").desc())
    return p.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
