"""Churn mart on the driver tables.

Mapping: subscriptions = ``orders`` (customer ``o_custkey``, start
``o_orderdate``, payment type ``o_orderstatus``, formula id
``o_orderpriority``); formula = five rows (type, duration in months), and a
subscription ends 30 days per month of its formula after its start;
deliveries = ``lineitem`` (0..n per subscription, delivery date
``l_shipdate``, class ``l_returnflag``) with the delivered product from
``part``; complaints = ``events`` (``user_id``, ``event_type``, date ``ts``);
region = ``nation`` + ``region``.

As-of rule: a training mart takes subscriptions that *ended*, deliveries that
were *made* and complaints *filed* up to the cut; a scoring mart those from
the day after it.  Complaints carry dates of their own period, so their cut is
a parameter of its own.  A subscription without deliveries in the period stays
(left join); one without a known formula does not (inner join).

Plan shape: the reference builds five aggregates over the same joined
table and joins them back; here all of them (totals, four pivots, last/first
dates) are ONE ``groupBy(customer)`` over the fan-out join, so the join runs
once and there is one shuffle on the customer key.  Complaints are a second
small aggregate; the base customer table is the third input.  Every output
column has its own name ``<agg>_<column>_<value>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import agg_expr, pivot_aggs
from ..operators.columns import decimals_to_double, money
from ..operators.encode import dummy_columns
from ..operators.filters import as_of
from ..sources.sql import rows_to_frame

# as-of date mapped onto the driver tables
AS_OF = "1998-08-31"
# Fixed value (as in the reference): days without a subscription that make a churner.
CHURN_DAYS = 180
PRODUCTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PAYMENTS = ["F", "O", "P"]
FORMULAS = ["F", "O"]
YEARS = [1995, 1996, 1997, 1998]
# formula id -> (type, duration in months)
FORMULA = {"1-URGENT": ("F", 1), "2-HIGH": ("F", 2), "3-MEDIUM": ("O", 3), "4-NOT SPECIFIED": ("O", 6), "5-LOW": ("F", 12)}
DAYS_PER_MONTH = 30
# the complaints' own period: the training cut
COMPLAINTS_AS_OF = "2024-01-15"
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


SCORING_FROM = "1998-09-01"
COMPLAINTS_FROM = "2024-01-16"
# day the scoring mart is labelled at: the last end date there can be
SCORING_AS_OF = "2002-07-27"
SCORING_YEARS = [1997, 1998, 1999, 2000, 2001]


def formulas(spark: SparkSession) -> DataFrame:
    return rows_to_frame(spark, [(k, *v) for k, v in FORMULA.items()],
                         "formula_id string, formula_type string, duration int")


def subscriptions(orders: DataFrame, before: str | None = None, after: str | None = None) -> DataFrame:
    """Subscriptions with their formula that ended up to ``before`` and not before ``after``."""
    if before is not None:
        # what ended by the cut started by it: this part of the rule reaches the scan
        orders = as_of(orders, "o_orderdate", before=before)
    o = orders.select(
        F.col("o_orderkey").alias("subscription_id"), F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("start_date"), F.col("o_orderstatus").alias("payment_type"),
        F.col("o_orderpriority").alias("formula_id"))
    s = o.join(formulas(orders.sparkSession), "formula_id").withColumn(
        "end_date", F.date_add("start_date", F.col("duration") * DAYS_PER_MONTH))
    return as_of(s, "end_date", before=before, after=after)


def subscription_lines(orders: DataFrame, lineitem: DataFrame, part: DataFrame,
                       before: str | None = AS_OF, after: str | None = None) -> DataFrame:
    """Subscriptions of the period with their formula (inner) and the
    deliveries of the period (left, fan-out), the reference's ``table1``."""
    li = as_of(lineitem, "l_shipdate", before=before, after=after).where(F.col("l_returnflag").isNotNull()).select(
        F.col("l_orderkey").alias("subscription_id"), "l_partkey", F.to_date("l_shipdate").alias("delivery_date"),
        F.col("l_quantity").alias("meals"), money("l_extendedprice").alias("price"),
        money("l_discount").alias("discount"))
    p = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("product"))
    return subscriptions(orders, before, after).join(li.join(p, "l_partkey", "left"), "subscription_id", "left")


def subscription_features(t: DataFrame, as_of_date: str = AS_OF,
                          years: list[int] | None = None) -> DataFrame:
    """Totals, product/payment/year/formula pivots and the churn label in
    one aggregate per customer."""
    t = t.where(F.col("customer_id").isNotNull()).withColumn("start_year", F.year("start_date"))
    days = F.datediff("end_date", "start_date")
    # 8-digit values summed as decimals: the mean is exact and order-free
    months = F.months_between("end_date", "start_date", roundOff=True).cast("decimal(18,8)")
    totals = [
        F.count("subscription_id").alias("n_subscription_rows"),
        F.round(agg_expr("mean", days), 6).alias("avg_days_subscription"),
        F.round(agg_expr("mean", months), 6).alias("avg_months_subscription"),
        F.sum("meals").alias("sum_meals"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        agg_expr("mean", "price").alias("avg_price"), F.sum("price").alias("sum_price"),
        F.min("discount").alias("min_discount"), F.max("discount").alias("max_discount"),
        F.sum("discount").alias("sum_discount"),
        F.max("end_date").alias("last_end"), F.min("start_date").alias("first_start"),
    ]
    prod = pivot_aggs("product", PRODUCTS, [("sum", "meals", "sum_meals"), ("sum", "price", "sum_price")])
    pay = pivot_aggs("payment_type", PAYMENTS, [("sum", "price", "sum_price_pay"),
                                                ("sum", "discount", "sum_discount_pay")])
    yr = pivot_aggs("start_year", years or YEARS, [("count", "subscription_id", "n_subscriptions")])
    form = pivot_aggs("formula_type", FORMULAS, [("count", "formula_type", "n_formula"),
                                                 ("sum", "duration", "sum_duration"),
                                                 ("mean", "duration", "avg_duration")])
    g = t.groupBy("customer_id").agg(*totals, *prod, *pay, *yr, *form)
    d = F.datediff(F.to_date(F.lit(as_of_date)), "last_end")
    return g.select("*", d.alias("days_without_sub"),
                    F.datediff("last_end", "first_start").alias("customer_lifetime"),
                    F.when(d > CHURN_DAYS, 1).otherwise(0).alias("label"))


def complaint_features(events: DataFrame, before: str | None = COMPLAINTS_AS_OF,
                       after: str | None = None) -> DataFrame:
    """Complaints of the period by type; the date of ``ts`` counts."""
    e = as_of(events, "ts", before=before, after=after).where(F.col("user_id").isNotNull()).select(
        F.col("user_id").alias("customer_id"), "event_type", "event_id")
    return e.groupBy("customer_id").agg(
        *pivot_aggs("event_type", EVENT_TYPES, [("count", "event_id", "n_complaints")]))


def customer_base(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")) \
        .select("n_nationkey", F.col("r_name").alias("region"))
    c = customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("n_nationkey"))
    return c.join(geo, "n_nationkey", "left").select(
        "customer_id", *dummy_columns("region", REGIONS, "region"))


def churn_mart(orders: DataFrame, lineitem: DataFrame, part: DataFrame, events: DataFrame,
               customer: DataFrame, nation: DataFrame, region: DataFrame,
               as_of_date: str = AS_OF, after: str | None = None,
               years: list[int] | None = None, complaints_as_of: str = COMPLAINTS_AS_OF,
               complaints_after: str = COMPLAINTS_FROM) -> DataFrame:
    """One row per customer with subscriptions that ended up to ``as_of_date``
    (training; with ``after`` None), or that ended from ``after`` on (scoring:
    everything since the training cut, labelled at ``as_of_date``); numeric
    nulls filled with 0; money columns as double."""
    if years is None and after is not None:
        years = list(range(int(after[:4]) - 1, int(as_of_date[:4]) + 1))
    before = as_of_date if after is None else None
    subs = subscription_features(subscription_lines(orders, lineitem, part, before, after),
                                 as_of_date, years)
    complaints = complaint_features(events, complaints_as_of if after is None else None,
                                    None if after is None else complaints_after)
    m = subs.join(customer_base(customer, nation, region), "customer_id", "left") \
        .join(complaints, "customer_id", "left")
    return decimals_to_double(m).na.fill(0)
