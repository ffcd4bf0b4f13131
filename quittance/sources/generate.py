"""Synthetic ledgers with known truth and four kinds of noise, made on the executors.

Every choice is a hash of the seed, the row and the question, so a case of any size is
the same in every run and needs no shared random state.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quittance.functions.money import MONEY
from quittance.sources import ledger

#: Payer names, and references that say nothing.
COMPANIES = ("Kormoran Kft", "Talgrund GmbH", "Wexbury Ltd", "Duna Vas Zrt", "Fenyves Bt", "Aubépine SA", "Rautatie Oy", "Lindehof NV", "Silberhorn AG", "Montesole SpA")
JUNK = ("bank transfer", "for services", "with thanks", "march settlement", "their mark 7719034")


# The kinds of noise and how a label shortens them.
KINDS = {"reference": "ref", "amount": "amt", "structure": "struct", "collision": "coll"}


@dataclass(frozen=True)
class Noise:
    """Chances, 0 to 1, of each kind of mess."""

    reference: float = 0.0
    amount: float = 0.0
    structure: float = 0.0
    collision: float = 0.0

    @property
    def label(self) -> str:
        """What there is of it, in short."""
        there = [f"{short}={chance:.2f}" for kind, short in KINDS.items() if (chance := getattr(self, kind)) > 0]
        return ", ".join(there) if there else "clean"


def noise_at(level: float, *kinds: str) -> Noise:
    """Noise of that level in the kinds named, or in all of them."""
    if strange := set(kinds) - set(KINDS):
        raise ValueError(f"no such kind of noise: {', '.join(sorted(strange))}")
    return replace(Noise(), **dict.fromkeys(kinds or KINDS, level))


@dataclass
class Case:
    invoices: DataFrame
    payments: DataFrame
    truth: DataFrame  # payment_id, invoice_id


def _chance(seed: int, what: str, *row: Column) -> Column:
    """A number in [0, 1) of the seed, the question and the row."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *row), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _pick(seed: int, what: str, n: int, *row: Column) -> Column:
    return F.floor(_chance(seed, what, *row) * n).cast("int")


def generate(spark: SparkSession, seed: int = 0, invoice_count: int = 240, customer_count: int = 10, noise: Noise = Noise()) -> Case:
    """A ledger, a statement that pays it, and which payment was meant for which invoice."""
    k = F.col("k")
    who = _pick(seed, "customer", customer_count, k)
    names = F.array(*map(F.lit, COMPANIES))
    amount = F.round((F.when(_pick(seed, "size", 4, k) == 3, 10).otherwise(1) * (45 + _chance(seed, "amount", k) * 3955)).cast("decimal(20,6)"), 2).cast(MONEY)
    i = spark.range(invoice_count).withColumnRenamed("id", "k").withColumn("c", who).withColumn("own", amount)
    i = i.withColumn("issue_date", F.date_add(F.lit("2026-01-05").cast("date"), _pick(seed, "day", 90, k)))
    before = W.partitionBy("c").orderBy("k")
    again = _chance(seed, "collision", k) < noise.collision
    i = i.withColumn("amount", F.when(again, F.coalesce(F.lag("own").over(before), F.col("own"))).otherwise(F.col("own")))
    i = i.select(
        F.concat(F.lit("i"), F.lpad(k.cast("string"), 9, "0")).alias("id"), F.concat(F.lit("c"), F.col("c").cast("string")).alias("customer_id"),
        F.concat(F.element_at(names, F.col("c") % len(COMPANIES) + 1), F.when(F.col("c") >= len(COMPANIES), F.concat(F.lit(" "), F.floor(F.col("c") / len(COMPANIES)).cast("string"))).otherwise("")).alias("customer_name"),
        F.concat(F.lit("INV-2026-"), F.lpad(k.cast("string"), 4, "0")).alias("number"), "issue_date", F.lit(None).cast("date").alias("due_date"), "amount", F.lit("EUR").alias("currency"), k.alias("k"), "c",
    )
    # Fixed values from here on: shares of split payments, sizes of fees and of what is paid too much, forms of mistyped numbers.
    # groups: a chain of merges starts where the chance says so and takes one or two more invoices of the customer
    roll = _chance(seed, "structure", k)
    order = W.partitionBy("c").orderBy("k")
    place = F.row_number().over(order) - 1
    # slots of three invoices: in a merged slot two or all three are paid at once
    g = i.withColumn("slot", F.floor(place / 3)).withColumn("nth", place % 3)
    lead = F.first("k").over(W.partitionBy("c", "slot").orderBy("k"))
    g = g.withColumn("lead", lead)
    merged = _chance(seed, "structure", F.col("lead")) < noise.structure / 2
    size = 2 + _pick(seed, "merge", 2, F.col("lead"))
    g = g.withColumn("grp", F.when(merged & (F.col("nth") < size), F.col("lead")).otherwise(k))
    split = ~merged & (roll >= noise.structure / 2) & (roll < noise.structure)
    share = F.element_at(F.array(*[F.lit(x) for x in (500, 600, 667)]), _pick(seed, "share", 3, k) + 1)
    g = g.withColumn("parts", F.when(split, F.array(share, 1000 - share)).otherwise(F.array(F.lit(1000))))
    lines = g.groupBy("grp", "c").agg(
        F.sum("amount").alias("sum"), F.max("issue_date").alias("issued"), F.array_sort(F.collect_list(F.struct("k", "id", "number"))).alias("members"), F.first("customer_name").alias("counterparty"), F.min_by("parts", "k").alias("parts")
    )
    lines = lines.select("*", F.posexplode("parts").alias("part", "thousandths"))
    row = (F.col("grp"), F.col("part"))
    paid = F.round(F.col("sum") * F.col("thousandths") / 1000, 2)
    style = _pick(seed, "amount-style", 4, *row)
    off = (
        F.when(style < 2, -F.round(paid * (F.lit(0.004) + _chance(seed, "rate", *row) * 0.025).cast("decimal(8,6)"), 2))
        .when(style == 2, -F.element_at(F.array(*[F.lit(x).cast("decimal(4,2)") for x in ("0.01", "0.02", "0.05")]), _pick(seed, "cents", 3, *row) + 1))
        .otherwise(F.round((0.5 + _chance(seed, "over", *row) * 39.5).cast("decimal(8,4)"), 2))
    )
    final = F.when(_chance(seed, "amount-noise", *row) < noise.amount, paid + off).otherwise(paid).cast(MONEY)
    dirty = _chance(seed, "reference-noise", *row) < noise.reference
    reference = F.array_join(F.transform("members", lambda m: F.when(dirty, _corrupt(m["number"], m["k"], seed, F.col("part"))).otherwise(m["number"])), " ")
    pid = F.concat(F.lit("p"), F.lpad(F.col("grp").cast("string"), 9, "0"), F.lit("-"), F.col("part").cast("string"))
    day = F.date_add(F.col("issued"), 3 + _pick(seed, "delay", 42, *row))
    made = lines.select(pid.alias("id"), day.alias("date"), final.alias("amount"), F.lit("EUR").alias("currency"), reference.alias("reference"), "counterparty", F.lit(None).cast("string").alias("customer_id"), "members").filter("amount > 0")
    truth = made.select(F.col("id").alias("payment_id"), F.explode("members").alias("m")).select("payment_id", F.col("m.id").alias("invoice_id"))
    return Case(i.drop("k", "c"), made.drop("members"), truth)


def _corrupt(number: Column, k: Column, seed: int, part: Column) -> Column:
    """What a person might have typed for an invoice number."""
    style = F.pmod(F.xxhash64(F.lit(seed), F.lit("typing"), k, part), F.lit(8))
    year, seq = F.substring(number, 5, 4), F.substring_index(number, "-", -1)
    bare = seq.cast("long").cast("string")
    last = F.right(seq, F.lit(1)).cast("int")
    junk = F.element_at(F.array(*map(F.lit, JUNK)), (F.pmod(F.xxhash64(F.lit(seed), F.lit("junk"), k), F.lit(len(JUNK))) + 1).cast("int"))
    return (
        F.when(style == 0, F.concat(year, F.lit("/"), seq)).when(style == 1, F.concat(seq, F.lit("/"), year)).when(style == 2, F.concat(F.lit("#"), bare)).when(style == 3, F.substring(number, 1, 11))
        .when(style == 4, F.concat(F.lit("INV-"), year, F.lit("-"), F.left(seq, F.length(seq) - 1), ((last + 1) % 10).cast("string"))).when(style == 5, F.concat(F.lit("szamla "), bare)).otherwise(junk)
    )


def truth_rows(case: Case) -> DataFrame:
    """payment_id, invoice_ids (sorted, parted by spaces)."""
    return case.truth.groupBy("payment_id").agg(F.array_join(F.array_sort(F.collect_set("invoice_id")), " ").alias("invoice_ids"))


def write_case(case: Case, folder: str) -> list[str]:
    """invoices.csv, bank.csv and truth.csv of a case under folder, each a folder of parts with a header."""
    paths = [f"{folder.rstrip('/')}/{n}" for n in ("invoices.csv", "bank.csv", "truth.csv")]
    ledger.write_invoices(case.invoices, paths[0])
    ledger.write_payments(case.payments, paths[1])
    truth_rows(case).write.mode("overwrite").csv(paths[2], header=True)
    return paths


def sample(spark: SparkSession) -> Case:
    """A small case to try the library with: 60 invoices, a little of every noise."""
    return generate(spark, seed=20, invoice_count=60, noise=noise_at(0.1))
