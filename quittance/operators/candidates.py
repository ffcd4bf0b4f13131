"""Explanations of payments at opening balances, as sets: singles, combinations, scores, ranks, decisions.

This is the whole decision for payments that share no invoice with another payment;
the ordered fold (plans.fold) takes the rest.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quittance.functions.confidence import ALL_NAMED, BASE, BUDGET_SPENT, CEILING, CUSTOMER_KNOWN, NOTHING_FITS, SOLE, TIED, TOO_LOW, UNIQUE, filled, headline_of, points_of
from quittance.functions.money import MONEY, cents, fee_tolerance, from_cents
from quittance.functions.subsets import find_subsets, some_add_up
from quittance.plans.policy import Policy
from quittance.plans.scratch import written

#: pairs need payment_id, paid, amount, invoice_id, issue_date, balance, hit, customer (bool).


def tie_key(policy: Policy) -> Column:
    """Order of invoices under the policy, ascending, before their ids."""
    day = F.datediff(F.col("issue_date"), F.lit("1970-01-01")).cast("decimal(20,2)")
    size = F.col("balance").cast("decimal(20,2)")
    return {"oldest_first": day, "newest_first": -day, "largest_first": -size, "smallest_first": size}[policy.tie_break]


def with_counts(pairs: DataFrame, policy: Policy, keys: tuple[str, ...] = ()) -> DataFrame:
    """pairs with shortfall, tolerance (of a shortfall), and per payment how many are eligible, exact, within tolerance.

    A payment without any has a pair whose invoice is null.  keys are columns by which whole
    payments are dealt out already.
    """
    d = pairs.withColumn("shortfall", (F.col("balance") - F.col("amount")).cast(MONEY)).withColumn("tolerance", F.when(F.col("shortfall") > 0, fee_tolerance(F.col("balance"), policy)))
    w = W.partitionBy(*keys, "payment_id")
    return d.select(
        "*",
        F.count("invoice_id").over(w).alias("eligible"),
        F.count_if(F.col("shortfall") == 0).over(w).alias("exact_count"),
        F.count_if((F.col("shortfall") > 0) & (F.col("shortfall") <= F.col("tolerance"))).over(w).alias("near_count"),
    )


def _single_strategy(policy: Policy) -> Column:
    short, supported = F.col("shortfall"), F.col("hit") | (F.col("eligible") == 1)
    strategy = F.when(short == 0, "exact_single").when((short > 0) & (short <= F.col("tolerance")), "fee_tolerance")
    if policy.allow_partial:
        strategy = strategy.when((short > F.col("tolerance")) & supported, "partial")
    if policy.allow_overpayment:
        strategy = strategy.when((short < 0) & supported, "overpayment")
    return strategy


def _single(policy: Policy) -> dict[str, Column]:
    """The columns of a candidate that is one pair, whose strategy is known."""
    short, kind = F.col("shortfall"), F.col("strategy")
    return {
        "strategy": kind, "invoice_ids": F.col("invoice_id"), "n": F.lit(1), "named": F.col("hit").cast("int"), "customer": F.col("customer"),
        "unique": ((kind == "exact_single") & (F.col("exact_count") == 1)) | ((kind == "fee_tolerance") & (F.col("near_count") == 1)),
        "sole": F.col("eligible") == 1, "allocated": F.when(kind == "overpayment", F.col("balance")).otherwise(F.col("amount")).cast(MONEY), "fee": F.when(kind == "fee_tolerance", short).otherwise(F.lit(0)).cast(MONEY),
        "residual": F.when(kind == "overpayment", -short).otherwise(F.lit(0)).cast(MONEY), "tolerance": F.when(kind == "fee_tolerance", F.col("tolerance")).otherwise(F.lit(0)).cast(MONEY), "tie": tie_key(policy),
    }


def singles(counted: DataFrame, policy: Policy) -> DataFrame:
    """One candidate per pair that a single invoice explains."""
    d = counted.withColumn("strategy", _single_strategy(policy)).filter("strategy is not null")
    return d.select("payment_id", *[c.alias(name) for name, c in _single(policy).items()])


def _searched_whole(policy: Policy) -> bool:
    """Whether the budget suffices for every sum of the widest search: a step adds one invoice to a sum or skips it."""
    n = policy.max_combination_candidates
    return policy.search_node_budget >= sum(math.comb(n, k) for k in range(1, policy.max_combination_size + 1))


def ranked_width(counted: DataFrame, policy: Policy) -> DataFrame:
    """The pairs a combination may use: named first, then by the tie-break, up to the width; pos counts from 1."""
    order = W.partitionBy("payment_id").orderBy(F.col("hit").desc(), F.col("tie"), F.col("invoice_id"))
    d = counted.filter("eligible >= 2").withColumn("tie", tie_key(policy))
    if _searched_whole(policy):  # an invoice that is in no sum only costs its search time, unless it takes the place of another
        d = d.filter((F.col("eligible") > policy.max_combination_candidates) | (F.col("balance") < widest_total(F.col("amount"), policy)))
    return d.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= policy.max_combination_candidates)


def widest_total(amount: Column, policy: Policy) -> Column:
    """Largest total whose shortfall against amount could still be a fee."""
    pct = F.floor((amount * 100).cast("decimal(20,0)") / F.lit(1 - policy.fee_tolerance_pct)).cast("decimal(20,0)") / 100
    upper = F.greatest(pct, amount + F.lit(policy.fee_tolerance_abs))
    return F.least(upper, amount + F.lit(policy.fee_tolerance_cap)) if policy.fee_tolerance_cap is not None else upper


def search(width: DataFrame, policy: Policy) -> DataFrame:
    """payment_id, amount, customer, items, picks, cut of the payments that sums of invoices may explain: a written table.

    picks are the subsets of 2 to max_combination_size pairs whose balances sum up to the amount or, if
    there are none, to at most a fee more; cut says that the search ran out of its budget.  A payment's
    pairs, at most max_combination_candidates, are one row; its subsets are searched depth first in a
    kernel over batches of rows, and the first max_combinations_returned stay.  The pairs are dealt by
    payment already, so this adds no exchange.
    """
    item = F.struct(F.col("pos"), F.col("invoice_id"), cents(F.col("balance")).alias("cents"), F.col("hit"), F.col("tie"))
    one = width.groupBy("payment_id").agg(F.first("amount").alias("amount"), F.first("customer").alias("customer"), F.sort_array(F.collect_list(item)).alias("items"))
    owed = F.transform("items", lambda x: x["cents"])
    enough = F.aggregate(owed, F.lit(0).cast("long"), lambda a, x: a + x) >= cents(F.col("amount"))
    if _searched_whole(policy):
        enough = enough & (F.size("items") >= 2)
    return written(_searched(one.filter(enough), policy), "subset-sums")


def _searched(one: DataFrame, policy: Policy) -> DataFrame:
    """Rows of payment, amount and items with picks and cut, where there are any."""
    owed = F.transform("items", lambda x: x["cents"])
    one = one.select("*", owed.alias("owed"), cents(F.col("amount")).alias("least"), cents(widest_total(F.col("amount"), policy)).alias("most"))
    bounds = {"most": policy.max_combination_size, "budget": policy.search_node_budget, "results": policy.max_combinations_returned}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            picks, cuts = [], []
            for owed, least, most in zip(*(b.column(c).to_pylist() for c in ("owed", "least", "most")), strict=True):
                found, cut = _picks(owed, least, most, bounds)
                picks.append(found)
                cuts.append(cut)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(picks, pa.list_(pa.list_(pa.int32()))), pa.array(cuts, pa.bool_())], [*b.schema.names, "picks", "cut"])

    schema = T.StructType([*one.schema.fields, T.StructField("picks", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("cut", T.BooleanType())])
    return one.mapInArrow(run, schema).filter("cut or size(picks) > 0").drop("owed", "least", "most")


def sums(searched: DataFrame) -> DataFrame:
    """The subsets that a search found, a row each, with their items and total, how many their payment has, and cut."""
    each = searched.select("payment_id", "amount", "customer", "items", "cut", F.size("picks").cast("long").alias("found"), F.explode("picks").alias("pick"))
    each = each.select("payment_id", "amount", "customer", "cut", "found", F.transform("pick", lambda k: F.get(F.col("items"), k)).alias("items"))
    total = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["cents"])
    return each.withColumn("total", from_cents(total).cast("decimal(20,2)"))


def apportioned(amount: Column, weights: Column) -> Column:
    """Array of parts of amount (cents) in proportion to weights (cents): largest remainders first."""
    whole = F.aggregate(weights, F.lit(0).cast("decimal(38,0)"), lambda a, w: (a + w.cast("decimal(20,0)")).cast("decimal(38,0)"))
    product = lambda w: (amount.cast("decimal(18,0)") * w.cast("decimal(18,0)")).cast("decimal(38,0)")
    floors = F.transform(weights, lambda w: F.floor(product(w) / whole).cast("long"))
    remainder = lambda w: (product(w) % whole).cast("decimal(38,0)")
    order = F.array_sort(F.transform(weights, lambda w, i: F.struct((-remainder(w)).alias("r"), (-w).alias("w"), i.alias("i"))))
    spare = amount - F.aggregate(floors, F.lit(0).cast("long"), lambda a, x: a + x)
    lucky = F.transform(F.slice(order, F.lit(1), F.greatest(spare, F.lit(0)).cast("int")), lambda s: s["i"])
    return F.transform(floors, lambda x, i: x + F.when(F.array_contains(lucky, i), 1).otherwise(0))


def combinations(searched: DataFrame, policy: Policy) -> DataFrame:
    """Candidates of several invoices: exact sums or, for payments without any, sums within the fee tolerance.  A search that was cut proves none unique."""
    d = sums(searched)
    d = d.withColumn("fee", (F.col("total") - F.col("amount")).cast(MONEY)).withColumn("tolerance", fee_tolerance(F.col("total"), policy))
    weights = F.transform("items", lambda x: x["cents"])
    d = d.withColumn("fees", F.when(F.col("fee") > 0, apportioned(cents(F.col("fee")), weights)).otherwise(F.transform("items", lambda x: F.lit(0).cast("long"))))
    d = d.filter((F.col("fee") <= F.col("tolerance")) & ~F.exists(F.arrays_zip("items", "fees"), lambda z: z["fees"] >= z["items"]["cents"]))
    named = F.size(F.filter("items", lambda x: x["hit"]))
    return d.select(
        "payment_id", F.lit("combination").alias("strategy"), F.array_join(F.transform("items", lambda x: x["invoice_id"]), "+").alias("invoice_ids"), F.size("items").alias("n"), named.alias("named"), "customer",
        ((F.col("found") == 1) & ~F.col("cut")).alias("unique"), F.lit(False).alias("sole"), F.col("amount").cast(MONEY).alias("allocated"), "fee", F.lit(0).cast(MONEY).alias("residual"),
        F.when(F.col("fee") > 0, F.col("tolerance")).otherwise(F.lit(0)).cast(MONEY).alias("tolerance"), F.array_min(F.transform("items", lambda x: F.struct(x["tie"].alias("tie"), x["invoice_id"].alias("id"))))["tie"].alias("tie"),
        F.col("items"), F.col("fees"),
    )


def explained(met: list[tuple[DataFrame, tuple[str, ...]]], policy: Policy, best: bool = True) -> DataFrame:
    """Ranked candidates with parts, of all payments; with best, only those that share the payment's best confidence.  A payment without any has a row whose strategy is null.

    met are the payments of pairs.considered(), a row each with the invoices it may touch, or pairs and
    the keys by which they are dealt out.  Whatever is counted, searched or ranked of a payment is made
    in its row, so nothing is written, dealt out or sorted again.  parts are (invoice_id, amount, fee) of
    what a candidate moves.
    """
    d = functools.reduce(DataFrame.unionByName, [_ranked_singles(d, policy, keys, best) for d, keys in met])
    if policy.allow_combinations:
        # to Python go only the invoices of payments that ask for a search
        d = d.withColumn("_sought", _searcher(policy)(F.transform("items", lambda x: x["cents"]), F.when(F.col("items").isNotNull(), F.col("due")), F.when(F.col("items").isNotNull(), F.col("most"))))
        d = d.withColumn("cut", F.coalesce(F.col("_sought.cut"), F.lit(False)))
        d = d.withColumn("_picks", F.col("_sought.picks"))
        again = F.sort_array(F.concat("cands", _sums_of(F.col("items"), F.col("_picks"), policy)))
        d = d.withColumn("cands", F.when(F.size("_picks") > 0, again).otherwise(F.col("cands")))
        d = d.withColumn("cands", _best_of("cands")) if best else d
    else:
        d = d.withColumn("cut", F.lit(False))
    lead = F.get("cands", F.lit(0))["less"]
    tied = F.when(F.size("cands") < 2, F.size("cands")).otherwise(F.size(F.filter("cands", lambda x: x["less"] == lead)))
    # all that is told of a payment goes through the array: a filter on it must not be pushed below, into every step above
    rows = F.when(F.size("cands") == 0, F.array(F.lit(None).cast(d.schema["cands"].dataType.elementType))).otherwise(F.col("cands"))
    d = d.withColumn("tied", tied).select("payment_id", F.col("amount").alias("came"), F.posexplode(F.transform(rows, lambda x: F.struct(x.alias("x"), F.col("tied").alias("tied"), F.col("cut").alias("cut"), (-lead).alias("top")))).alias("pos", "y"))
    d = d.select("payment_id", "came", "pos", "y.*")
    money = lambda name: F.when(F.col("x").isNotNull(), from_cents(F.col(f"x.{name}"))).alias(name)
    d = d.select("payment_id", "came", "x.strategy", "x.invoice_ids", "x.n", "x.named", money("allocated"), money("fee"), money("residual"), (-F.col("x.less")).alias("points"), (F.col("pos") + 1).alias("rank"), "top", "tied", "cut", F.col("x.parts").alias("_parts"))
    one = F.array(F.struct(F.col("invoice_ids").alias("invoice_id"), F.col("allocated").alias("amount"), F.col("fee").alias("fee")))
    several = F.transform("_parts", lambda z: F.struct(z["invoice_id"].alias("invoice_id"), from_cents(z["amount"]).alias("amount"), from_cents(z["fee"]).alias("fee")))
    return d.withColumn("parts", F.when(F.col("_parts").isNull(), one).otherwise(several)).drop("_parts")


def _ranked_singles(met: DataFrame, policy: Policy, keys: tuple[str, ...], best: bool) -> DataFrame:
    """payment_id, amount, due, most, customer, eligible, cands, its singles in their order, and items, the invoices to search for sums, or null."""
    if "met" not in met.columns:
        met = _gathered(met, keys)
    d = met.select("payment_id", "amount", "customer", "met", cents(F.col("amount")).alias("due"), F.size("met").alias("eligible"))
    d = d.withColumn("most", F.when(F.col("eligible") > 1, cents(widest_total(F.col("amount"), policy))))
    short = lambda x: x["cents"] - F.col("due")
    exact = lambda x: x["cents"] == F.col("due")
    near = lambda x: (short(x) > 0) & (short(x) <= x["tolerance"])
    d = d.select("*", F.size(F.filter("met", exact)).alias("exacts"), F.size(F.filter("met", near)).alias("nears"))
    sole = F.col("eligible") == 1
    # what singles of a kind have in common is reckoned once a payment
    yes = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    common = yes(F.col("customer"), CUSTOMER_KNOWN) + yes(sole, SOLE)
    d = d.withColumns({"_exact": common + BASE["exact_single"] + yes(F.col("exacts") == 1, UNIQUE), "_partial": common + BASE["partial"], "_over": common + BASE["overpayment"]})

    def kind(x: Column) -> Column:
        supported = x["hit"] | (F.col("eligible") == 1)
        k = F.when(exact(x), "exact_single").when(near(x), "fee_tolerance")
        if policy.allow_partial:
            k = k.when((short(x) > 0) & supported, "partial")
        return k.when((short(x) < 0) & supported, "overpayment") if policy.allow_overpayment else k

    def single(z: Column) -> Column:
        k, x = z["kind"], z["x"]
        fee, over = k == "fee_tolerance", k == "overpayment"
        plain = F.when(k == "exact_single", F.col("_exact")).when(k == "partial", F.col("_partial")).otherwise(F.col("_over")) + F.when(x["hit"], F.lit(ALL_NAMED)).otherwise(F.lit(0))
        named = x["hit"].cast("int")
        paid = points_of(k, F.lit(1), named, F.col("customer"), F.col("nears") == 1, F.col("eligible") == 1, short(x).cast("decimal(18,0)"), x["tolerance"].cast("decimal(18,0)"))
        none = F.lit(0).cast("long")
        return _candidate(F.when(fee, paid).otherwise(F.least(plain, F.lit(CEILING))), F.lit(1), x["tie"], x["invoice_id"], k, named, F.when(over, x["cents"]).otherwise(F.col("due")), F.when(fee, short(x)).otherwise(none), F.when(over, -short(x)).otherwise(none), F.lit(None).cast(_PARTS))

    kinds = F.filter(F.transform("met", lambda x: F.struct(kind(x).alias("kind"), x.alias("x"))), lambda z: z["kind"].isNotNull())
    d = d.withColumn("_kinds", kinds).withColumn("cands", F.sort_array(F.transform("_kinds", single)))
    d = d.withColumn("cands", _best_of("cands")) if best else d
    items = F.lit(None)
    if policy.allow_combinations:
        whole, width = _searched_whole(policy), policy.max_combination_candidates
        used = F.col("met")
        if whole:  # an invoice that is in no sum only costs its search time, unless it takes the place of another
            used = F.when(F.col("eligible") > width, used).otherwise(F.filter(used, lambda x: x["cents"] < F.col("most")))
        ordered = F.concat(F.filter("_used", lambda x: x["hit"]), F.filter("_used", lambda x: ~x["hit"]))  # met is in the order of the tie-break
        d = d.withColumn("_used", F.when(F.col("eligible") > 1, used)).withColumn("_items", F.when(F.size("_used") > 1, F.slice(ordered, 1, width)))
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
        d = d.withColumn("_owed", F.transform("_items", lambda x: x["cents"]))
        owed, due = F.col("_owed"), F.col("due")
        enough = total(owed) >= due
        if whole:  # the largest reach the amount, and the two smallest stay below the most
            high, low = F.slice(F.sort_array(owed, False), 1, policy.max_combination_size), F.slice(F.sort_array(owed), 1, 2)
            enough = enough & (total(low) <= F.col("most")) & (total(high) >= due)
        items = F.when(F.col("_items").isNotNull() & enough, F.col("_items"))
    return d.withColumn("items", items.cast(_ITEMS)).select("payment_id", "amount", "due", "most", "customer", "eligible", "cands", "items")


#: An invoice that a payment may touch, as pairs.considered() lists it, and what a sum moves.
_ITEMS = "array<struct<tie:bigint,invoice_id:string,cents:bigint,tolerance:bigint,hit:boolean>>"
_PARTS = "array<struct<invoice_id:string,amount:bigint,fee:bigint>>"


def _gathered(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A row per payment with met, each of its invoices once and in order, of pairs with item, null for none."""
    return pairs.groupBy(*keys, "payment_id").agg(F.first("amount").alias("amount"), F.first("customer").alias("customer"), F.sort_array(F.collect_set("item")).cast(_ITEMS).alias("met"))


def _candidate(points: Column, n: Column, tie: Column, ids: Column, strategy: Column, named: Column, allocated: Column, fee: Column, residual: Column, parts: Column) -> Column:
    """A candidate in cents; candidates sort as they rank."""
    return F.struct((-points).cast("int").alias("less"), n.alias("n"), tie.alias("tie"), ids.alias("invoice_ids"), strategy.alias("strategy"), named.alias("named"), allocated.alias("allocated"), fee.alias("fee"), residual.alias("residual"), parts.alias("parts"))


def _best_of(name: str) -> Column:
    """The candidates of a sorted column that are as good as the first."""
    return F.when(F.size(name) > 1, F.filter(name, lambda x: x["less"] == F.get(name, F.lit(0))["less"])).otherwise(F.col(name))


def _searcher(policy: Policy):
    """Arrow function of (owed, least, most): which of the invoices add up, and whether the search was cut; null for null."""
    bounds = {"most": policy.max_combination_size, "budget": policy.search_node_budget, "results": policy.max_combinations_returned}
    whole, kind = _searched_whole(policy), T.StructType([T.StructField("picks", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("cut", T.BooleanType())])

    @F.arrow_udf(kind)
    def sought(owed: pa.Array, least: pa.Array, most: pa.Array) -> pa.Array:
        asked = pc.indices_nonzero(pc.is_valid(owed))
        rows, lows, highs = (c.take(asked).to_pylist() for c in (owed, least, most))
        worth = some_add_up(rows, lows, highs, policy.max_combination_size) if whole else [True] * len(rows)
        out: list[dict | None] = [None] * len(owed)
        for at, row, low, high, yes in zip(asked.to_pylist(), rows, lows, highs, worth, strict=True):
            if yes:
                picks, cut = _picks(row, low, high, bounds)
                if picks or cut:
                    out[at] = {"picks": picks, "cut": cut}
        return pa.array(out, to_arrow_type(kind))

    return sought


def _picks(owed: list[int], least: int, most: int, bounds: dict[str, int]) -> tuple[list[tuple[int, ...]], bool]:
    """Exact sums or, if there are none, those up to most; and whether a search was cut."""
    found, cut = find_subsets(owed, least, least, **bounds)
    if not found:
        found, more = find_subsets(owed, least, most, **bounds)
        cut = cut or more
    return found, cut


def _sums_of(items: Column, picks: Column, policy: Policy) -> Column:
    """The candidates of combinations(), in the row of their payment, as _candidate()."""
    total = lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x["cents"])
    owed = lambda s: F.transform(s, lambda x: x["cents"])
    none = F.lit(0).cast("long")
    each = F.transform(F.transform(picks, lambda p: F.transform(p, lambda k: F.get(items, k))), lambda s: F.struct(s.alias("s"), total(s).alias("total")))
    each = F.transform(each, lambda z: F.struct(z["s"].alias("s"), (z["total"] - F.col("due")).alias("fee"), cents(fee_tolerance(from_cents(z["total"]), policy)).alias("tolerance")))
    each = F.filter(each, lambda z: z["fee"] <= z["tolerance"])
    each = F.transform(each, lambda z: F.struct(z["s"].alias("s"), z["fee"].alias("fee"), F.when(z["fee"] > 0, z["tolerance"]).otherwise(none).alias("tolerance"), F.when(z["fee"] > 0, apportioned(z["fee"], owed(z["s"]))).otherwise(F.transform(z["s"], lambda x: none)).alias("fees")))
    each = F.filter(each, lambda z: ~F.exists(F.arrays_zip(owed(z["s"]).alias("cents"), z["fees"].alias("fees")), lambda y: y["fees"] >= y["cents"]))

    def candidate(z: Column) -> Column:
        s, n, wide = z["s"], F.size(z["s"]), lambda c: c.cast("decimal(18,0)")
        named, strategy = F.size(F.filter(s, lambda x: x["hit"])), F.lit("combination")
        points = points_of(strategy, n, named, F.col("customer"), (F.size(picks) == 1) & ~F.col("cut"), F.lit(False), wide(z["fee"]), wide(z["tolerance"]))
        parts = F.transform(s, lambda x, i: F.struct(x["invoice_id"].alias("invoice_id"), (x["cents"] - F.get(z["fees"], i)).alias("amount"), F.get(z["fees"], i).alias("fee")))
        return _candidate(points, n, F.array_min(F.transform(s, lambda x: x["tie"])), F.array_join(F.transform(s, lambda x: x["invoice_id"]), "+"), strategy, named, F.col("due"), z["fee"], none, parts.cast(_PARTS))

    return F.transform(each, candidate)


def told(candidates: DataFrame) -> DataFrame:
    """Candidates with points and their confidence and headline."""
    confidence = (F.col("points").cast("decimal(10,4)") / 10000).cast("decimal(5,4)")
    return candidates.withColumn("confidence", confidence).withColumn("headline", headline_of(F.col("strategy"), F.col("n"), F.col("named")))


def decide(ranks: DataFrame, policy: Policy) -> DataFrame:
    """A row per payment of explained and ranked candidates: status, review reason and message, what was applied with its parts, and whether the search was cut."""
    d = told(ranks.filter("rank = 1"))
    ambiguous = (F.col("tied") > 1) if policy.ambiguity_policy == "review" else F.lit(False)
    low = F.col("points") < F.lit(policy.threshold_points)
    why = F.when(F.col("strategy").isNull() & F.col("cut"), "search_truncated").when(F.col("strategy").isNull(), "no_candidate").when(ambiguous, "ambiguous").when(low, "below_threshold")
    d = d.withColumn("review_reason", why)
    applied = F.col("review_reason").isNull()
    status = F.when(F.col("strategy").isNull(), "unmatched").when(~applied, "review").when(F.col("residual") > 0, "partially_matched").otherwise("matched")
    reason, confidence = F.col("review_reason"), F.col("confidence")
    message = (
        F.when(reason == "no_candidate", NOTHING_FITS)
        .when(reason == "search_truncated", BUDGET_SPENT)
        .when(reason == "ambiguous", filled(TIED, n=F.col("tied"), confidence=confidence))
        .when(reason == "below_threshold", filled(TOO_LOW, confidence=confidence, threshold=F.lit(str(policy.confidence_threshold)), reason=F.col("headline")))
    )
    kept = lambda c: F.when(applied, F.col(c))
    used = F.when(applied, F.col("allocated")).otherwise(F.lit(0))
    return d.select(
        "payment_id", status.alias("status"), "review_reason", message.alias("message"), kept("strategy").alias("strategy"), kept("invoice_ids").alias("invoice_ids"), kept("confidence").alias("confidence"),
        used.cast(MONEY).alias("allocated"), F.when(applied, F.col("fee")).otherwise(F.lit(0)).cast(MONEY).alias("fee"), (F.col("came") - used).cast(MONEY).alias("left_over"),
        F.coalesce(F.col("tied"), F.lit(0)).cast("long").alias("tied"), F.col("cut").alias("search_truncated"), kept("parts").alias("parts"),
    )


def applied_parts(decided: DataFrame) -> DataFrame:
    """(payment_id, invoice_id, amount, fee) of the decisions that move money; a sum's parts are its invoices' balances less their shares of the fee."""
    return decided.filter("strategy is not null").select("payment_id", F.inline("parts"))


__all__ = ["applied_parts", "apportioned", "combinations", "decide", "explained", "from_cents", "ranked_width", "search", "singles", "sums", "tie_key", "told", "with_counts"]
