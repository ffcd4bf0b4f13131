"""Which invoices a payment may touch, and which of them its reference names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quittance.functions.money import cents, fee_tolerance
from quittance.functions.similar import similarity_above
from quittance.functions.text import invoice_token_of, is_plain, plain_core, plain_number, plain_refs, refs_of
from quittance.plans.policy import Policy
from quittance.plans.scratch import some, written


def with_token(invoices: DataFrame, stored: bool = False) -> DataFrame:
    """invoices with seq and year of their own number; of a stored table, without Python unless a number asks for it.

    core, if it is there, is what text.with_core() read of the number, and goes.
    """
    number = F.col("number")
    if "core" in invoices.columns:
        if some(invoices.filter("core is null")):
            return with_token(invoices.drop("core"))
        seq, year = plain_number(F.col("core"))
        return invoices.withColumns({"seq": seq, "year": year}).drop("core")
    if stored and not some(invoices.filter(~is_plain(number))):
        seq, year = plain_number(F.col("_core"))
        return invoices.withColumn("_core", plain_core(number)).withColumns({"seq": seq, "year": year}).drop("_core")
    return invoices.withColumn("_t", invoice_token_of(F.col("number"))).withColumn("seq", F.col("_t.seq")).withColumn("year", F.col("_t.year")).drop("_t")


def with_refs(payments: DataFrame, stored: bool = False) -> DataFrame:
    """payments with tokens, the identifiers of their reference; of a stored table, only the references that ask for it go through Python.

    core, if it is there, is what text.with_core() read of the reference, and goes.
    """
    text = F.col("reference")
    if "core" in payments.columns:
        plain = payments.filter("core is not null").withColumn("tokens", plain_refs(text, F.col("core"))).drop("core")
        return plain.unionByName(with_refs(payments.filter("core is null").drop("core")))
    if stored:
        plain = payments.filter(is_plain(text)).withColumn("_core", plain_core(text)).withColumn("tokens", plain_refs(text, F.col("_core"))).drop("_core")
        return plain.unionByName(with_refs(payments.filter(~is_plain(text))))
    return payments.withColumn("tokens", refs_of(F.col("reference")))


def in_window(issue: Column, paid: Column, policy: Policy) -> Column:
    return issue.between(F.date_sub(paid, policy.date_window_days_after), F.date_add(paid, policy.date_window_days_before))


def _invoice_side(invoices: DataFrame) -> DataFrame:
    return invoices.select(
        F.col("id").alias("invoice_id"), F.col("customer_id").alias("owner"), F.col("number"), F.col("issue_date"), F.col("amount").alias("balance"), F.col("currency").alias("invoice_currency"),
        *[c for c in ("seq", "year") if c in invoices.columns],
    )


def _payment_side(payments: DataFrame) -> DataFrame:
    return payments.select(F.col("id").alias("payment_id"), F.col("date").alias("paid"), F.col("amount"), F.col("currency"), *[c for c in ("resolved", "reference", "tokens") if c in payments.columns])


def by_customer(payments: DataFrame, invoices: DataFrame, policy: Policy, how: str = "inner") -> DataFrame:
    """Pairs of a resolved payment with its customer's invoices of the same currency in the window; how may be left, for a row of payments without any."""
    p, i = _payment_side(payments.filter("resolved is not null")), _invoice_side(invoices)
    return p.join(i, (p["resolved"] == i["owner"]) & (p["currency"] == i["invoice_currency"]) & in_window(i["issue_date"], p["paid"], policy), how)


def by_token(payments: DataFrame, invoices: DataFrame, policy: Policy, how: str = "inner") -> DataFrame:
    """Pairs of an unresolved payment with the invoices that its reference names; how may be left, for a row of payments without any."""
    return _by_token(payments, invoices, policy, how).dropDuplicates(["payment_id", "invoice_id"])


def _by_token(payments: DataFrame, invoices: DataFrame, policy: Policy, how: str) -> DataFrame:
    """Pairs of by_token(), one for each token that names the invoice."""
    p = _payment_side(payments.filter("resolved is null" if how == "left" else "resolved is null and size(tokens) > 0"))
    p = p.withColumn("asked", (F.explode_outer if how == "left" else F.explode)("tokens"))
    i = _invoice_side(invoices.filter("seq is not null"))
    year = F.col("asked.year").isNull() | i["year"].isNull() | (F.col("asked.year") == i["year"])
    found = p.join(i, (F.col("asked.seq") == i["seq"]) & (p["currency"] == i["invoice_currency"]) & year & in_window(i["issue_date"], p["paid"], policy), how)
    return found.drop("asked")


def by_currency(payments: DataFrame, invoices: DataFrame, policy: Policy) -> DataFrame:
    """Pairs of every payment with all invoices of its currency in the window, customers ignored.

    Days of payments are cut into stretches of an eighth of the window, and an invoice goes to each
    stretch that it may be paid in, nine or ten: rows meet by currency and stretch, never by currency alone.
    """
    return _met(_payment_side(payments), _invoice_side(invoices), policy)


def _met(p: DataFrame, i: DataFrame, policy: Policy) -> DataFrame:
    step = max(1, (policy.date_window_days_after + policy.date_window_days_before + 1) // 8)
    stretch = lambda day: F.floor(_day(day) / step)
    first, last = stretch(F.date_sub("issue_date", policy.date_window_days_before)), stretch(F.date_add("issue_date", policy.date_window_days_after))
    p = p.withColumn("stretch", stretch(F.col("paid")))
    i = i.withColumn("stretch", F.explode(F.sequence(first, last)))
    # few rows make many pairs: by their size Spark would leave all of them to one task
    tasks = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * p.sparkSession.sparkContext.defaultParallelism)
    p, i = p.repartition(tasks, "currency", "stretch"), i.repartition(tasks, "invoice_currency", "stretch")
    met = (p["currency"] == i["invoice_currency"]) & (p["stretch"] == i["stretch"]) & in_window(i["issue_date"], p["paid"], policy)
    return p.join(i, met).drop("stretch")


def by_currency_classes(payments: DataFrame, invoices: DataFrame, policy: Policy) -> DataFrame:
    """(kind, id, of, links): the pairs of by_currency without writing each of them.

    Payments of one currency and day may touch the same invoices, and invoices of one currency and
    day are touched by the same payments, so either are a class, named by its smallest id.  A row
    'pair' links the payment class id with the invoice class of and stands for links pairs; a row
    'payment' or 'invoice' says that id is of that class and has links pairs itself.  Class pairs
    are bounded by the days, the rest by the rows.
    """

    def classes(df: DataFrame, day: str, name: str) -> DataFrame:
        return df.groupBy("currency", day).agg(F.min("id").alias(f"{name}_class"), F.count("*").alias(f"{name}s"))

    def members(df: DataFrame, known: DataFrame, day: str, name: str, other: str) -> DataFrame:
        links = met.groupBy(f"{name}_class").agg(F.sum(f"{other}s").alias("links"))
        known = known.join(links, f"{name}_class", "left").select(F.col("currency").alias("c"), F.col(day).alias("d"), F.col(f"{name}_class").alias("of"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
        return df.join(known, F.col("currency").eqNullSafe(F.col("c")) & F.col(day).eqNullSafe(F.col("d"))).select(F.lit(name).alias("kind"), "id", "of", "links")

    p, i = written(classes(payments, "date", "payment"), "payment-classes"), written(classes(invoices, "issue_date", "invoice"), "invoice-classes")
    met = written(_met(p.withColumnRenamed("date", "paid"), i.withColumnRenamed("currency", "invoice_currency"), policy).select("payment_class", "payments", "invoice_class", "invoices"), "class-pairs")
    linked = met.select(F.lit("pair").alias("kind"), F.col("payment_class").alias("id"), F.col("invoice_class").alias("of"), (F.col("payments") * F.col("invoices")).alias("links"))
    return linked.unionByName(members(payments, p, "date", "payment", "invoice")).unionByName(members(invoices, i, "issue_date", "invoice", "payment"))


def eligible(payments: DataFrame, invoices: DataFrame, policy: Policy) -> DataFrame:
    """All pairs at opening balances; payments need resolved and tokens, invoices seq and year."""
    if not policy.require_customer_match:
        return by_currency(payments, invoices, policy)
    return by_customer(payments, invoices, policy).unionByName(by_token(payments, invoices, policy))


def token_hit() -> Column:
    """Whether the tokens of a pair's payment name its invoice; the usual one token without a lambda."""
    meets = lambda t: (t["seq"] == F.col("seq")) & (t["year"].isNull() | F.col("year").isNull() | (t["year"] == F.col("year")))
    one = F.when(F.size("tokens") == 1, meets(F.get("tokens", F.lit(0)))).otherwise(F.exists("tokens", meets))
    return F.coalesce(F.col("seq").isNotNull() & one, F.lit(False))


#: A customer with more invoices of one currency is crowded.
MOST = 500


def considered(payments: DataFrame, invoices: DataFrame, policy: Policy) -> list[tuple[DataFrame, tuple[str, ...]]]:
    """[(rows, keys)]: every payment of the stored sides with each invoice it may touch.

    A row is a payment, and met lists its invoices as (tie, invoice_id, cents, tolerance, hit) in the
    order of the policy: a customer's invoices of one currency are one row that its payments meet, so
    pairs are neither dealt out nor sorted.  keys are columns by which the rows are dealt out.
    Payments of crowded customers, whose list would be carried by each of them, and of nobody known
    come as pairs, with item, or null if there is none.  hit is exact evidence.
    """
    if not policy.require_customer_match:
        met = by_currency(payments, invoices, policy).select("payment_id", "invoice_id", "issue_date", "balance", "seq", "year")
        return [(_weighed(_payment_side(payments).join(met, "payment_id", "left"), policy), ())]
    accounts = written(_accounts(invoices, policy), "accounts")
    crowded = accounts.filter("own is null").select(F.col("owner").alias("resolved"), "currency")
    out, known = [], payments.filter("resolved is not null")
    if some(crowded):
        apart = F.broadcast(crowded)  # at most a row for each MOST invoices
        out.append((_weighed(by_customer(known.join(apart, ["resolved", "currency"], "left_semi"), invoices, policy, "left"), policy), ()))
        known = known.join(apart, ["resolved", "currency"], "left_anti")
    p, i = _payment_side(known), accounts.withColumnRenamed("currency", "invoice_currency")
    d = p.join(i, (p["resolved"] == i["owner"]) & (p["currency"] == i["invoice_currency"]), "left")
    d = d.withColumns({"_first": _day(F.date_sub("paid", policy.date_window_days_after)), "_last": _day(F.date_add("paid", policy.date_window_days_before)), "_one": F.when(F.size("tokens") == 1, F.get("tokens", F.lit(0)))})
    inside = F.filter("own", lambda x: (x["day"] >= F.col("_first")) & (x["day"] <= F.col("_last")))
    meets = lambda t, x: (t["seq"] == x["seq"]) & (t["year"].isNull() | x["year"].isNull() | (t["year"] == x["year"]))
    hit = lambda x: F.coalesce(F.when(F.col("_one").isNotNull(), meets(F.col("_one"), x)).otherwise(F.exists("tokens", lambda t: meets(t, x))), F.lit(False))
    met = F.transform(inside, lambda x: F.struct(x["tie"].alias("tie"), x["invoice_id"].alias("invoice_id"), x["cents"].alias("cents"), x["tolerance"].alias("tolerance"), hit(x).alias("hit")))
    rows = d.select("payment_id", "resolved", "currency", "amount", F.lit(True).alias("customer"), F.coalesce(met, F.array()).alias("met"))
    return [(rows, ("resolved", "currency")), *out, (_weighed(_by_token(payments, invoices, policy, "left"), policy), ())]


def _day(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def _owed(policy: Policy) -> list[Column]:
    """tie, by which invoices are ordered, invoice_id, cents and tolerance, the largest shortfall that is a fee."""
    day, size = _day(F.col("issue_date")).cast("long"), cents(F.col("balance"))
    tie = {"oldest_first": day, "newest_first": -day, "largest_first": -size, "smallest_first": size}[policy.tie_break]
    return [tie.alias("tie"), F.col("invoice_id"), size.alias("cents"), cents(fee_tolerance(F.col("balance"), policy)).alias("tolerance")]


def _accounts(invoices: DataFrame, policy: Policy) -> DataFrame:
    """(owner, currency, own): the invoices of each customer and currency in the order of the policy; own is null where they are crowded."""
    i = _invoice_side(invoices).filter("owner is not null and invoice_currency is not null and issue_date is not null")
    i = i.select("owner", F.col("invoice_currency").alias("currency"), F.struct(*_owed(policy), _day(F.col("issue_date")).alias("day"), "seq", "year").alias("item"))
    d = i.groupBy("owner", "currency").agg(F.collect_list("item").alias("own"))
    return d.select("owner", "currency", F.when(F.size("own") <= MOST, F.sort_array("own")).alias("own"))


def _weighed(met: DataFrame, policy: Policy) -> DataFrame:
    item = F.when(F.col("invoice_id").isNotNull(), F.struct(*_owed(policy), token_hit().alias("hit")))
    return met.select("payment_id", "amount", F.col("resolved").isNotNull().alias("customer"), item.alias("item"))


def exact_evidence(pairs: DataFrame) -> DataFrame:
    """pairs with token_hit, and any_hit, whether the payment names any of its pairs exactly."""
    return pairs.withColumn("token_hit", token_hit()).withColumn("any_hit", F.bool_or("token_hit").over(W.partitionBy("payment_id")))


def evidence(pairs: DataFrame, policy: Policy, fuzzy: bool = True) -> DataFrame:
    """pairs with hit: named exactly or, if the payment names none exactly, closely enough."""
    d = exact_evidence(pairs)
    if not fuzzy:
        return d.withColumn("hit", F.col("token_hit"))
    rest = d.filter("not any_hit and reference <> ''").select("payment_id", "invoice_id", "number", "reference")
    close = rest.withColumn("close", similarity_above(policy.fuzzy_ref_threshold)("number", "reference") >= policy.fuzzy_ref_threshold).filter("close").select("payment_id", "invoice_id", "close")
    return d.join(close, ["payment_id", "invoice_id"], "left").withColumn("hit", F.col("token_hit") | F.coalesce("close", F.lit(False))).drop("close")
