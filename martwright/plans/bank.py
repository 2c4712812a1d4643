"""Bank data mart on the driver tables.

Mapping: clients/accounts = ``customer`` (``account_id = c_custkey``,
district = nation); transactions = ``lineitem`` joined to ``orders``
(account = ``o_custkey``, date = ``l_shipdate``, amount =
``l_extendedprice``) with bank codes derived from order/line attributes;
standing orders = ``orders`` (amount ``o_totalprice``, symbol from the
priority).

Plan shape: transactions are joined to orders once (sort-merge on the
order key, AQE splits a skewed key), then every transaction feature is a
partial aggregate keyed by account; the account-level frames join on the
same key, so the chain adds no exchange beyond the base's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import decode_birth_number, parse_compact_ts
from ..functions.recode import (LOAN_STATUS, ORDER_K_SYMBOL, ORDER_K_SYMBOL_DEFAULT, TRANS_K_SYMBOL,
                                TRANS_K_SYMBOL_DEFAULT, TRANS_OPERATION, TRANS_OPERATION_DEFAULT,
                                TRANS_TYPE, TRANS_TYPE_DEFAULT, recode)
from ..operators.aggregate import (agg_expr, group_mean, pivot_aggs, pivot_mean_of_groups,
                                   safe_name)
from ..operators.columns import money
from ..operators.encode import dummy_columns
from ..operators.joins import build_mart

EVAL_DATE = "2002-01-01"

# raw bank codes derived from TPC-H attributes
TYPE_CODE = {"F": "PRIJEM", "O": "VYDAJ"}
OPERATION_CODE = {"1-URGENT": "VYBER KARTOU", "2-HIGH": "VKLAD", "3-MEDIUM": "PREVOD Z UCTU",
                  "4-NOT SPECIFIED": "VYBER"}
K_SYMBOL_CODE = {"A": "POJISTNE", "N": "SIPO", "R": "UVER"}
ORDER_SYMBOL_CODE = {"1-URGENT": "POJISTNE", "2-HIGH": "SIPO", "3-MEDIUM": "LEASING", "4-NOT SPECIFIED": "UVER"}

OPERATIONS = sorted(set(TRANS_OPERATION.values()) | {TRANS_OPERATION_DEFAULT})
K_SYMBOLS = sorted(set(TRANS_K_SYMBOL.values()) | {TRANS_K_SYMBOL_DEFAULT})
ORDER_SYMBOLS = sorted(set(ORDER_K_SYMBOL.values()) | {ORDER_K_SYMBOL_DEFAULT})
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
LOAN_LABELS = sorted(LOAN_STATUS.values())
FEMALE_SEGMENTS = ["FURNITURE", "HOUSEHOLD"]
BIRTH_EVAL_YEAR = 1999


def transactions(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Decoded transactions: account, date, type, operation, k_symbol, amount."""
    j = lineitem.select("l_orderkey", "l_shipdate", "l_extendedprice", "l_returnflag") \
        .join(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
              F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.col("o_custkey").alias("account_id"),
        F.to_date("l_shipdate").alias("date"),
        recode(recode("o_orderstatus", TYPE_CODE), TRANS_TYPE, TRANS_TYPE_DEFAULT).alias("type"),
        recode(recode("o_orderpriority", OPERATION_CODE), TRANS_OPERATION,
               TRANS_OPERATION_DEFAULT).alias("operation"),
        recode(recode("l_returnflag", K_SYMBOL_CODE), TRANS_K_SYMBOL,
               TRANS_K_SYMBOL_DEFAULT).alias("k_symbol"),
        money("l_extendedprice").alias("amount"))


def trans_by_operation(trans: DataFrame) -> DataFrame:
    """Pivot on operation of the (operation, k_symbol) group values: the
    mean over k_symbol groups, as the reference's default pivot did."""
    p = pivot_mean_of_groups(trans, "account_id", "operation", "k_symbol", "amount",
                             values=OPERATIONS, combine="mean")
    return p.select("account_id", *[F.col(c).cast("double").alias(f"op_{c}")
                                    for c in p.columns if c != "account_id"])


def trans_groups(trans: DataFrame) -> DataFrame:
    """Step 1 of every transaction feature: one partial aggregate per
    ``(account, operation, k_symbol)``.  All account-level features below
    are derived from these group rows, so the transaction join and scan run
    once."""
    return (trans.where(F.col("account_id").isNotNull())
            .groupBy("account_id", "operation", "k_symbol")
            .agg(F.count(F.lit(1)).alias("_rows"), F.count("amount").alias("_n"),
                 F.sum("amount").alias("_s"), agg_expr("mean", "amount").alias("_m"),
                 F.min("date").alias("_first"), F.max("date").alias("_last")))


def trans_features(groups: DataFrame, eval_date: str = EVAL_DATE) -> DataFrame:
    """Step 2, one aggregate per account over the group rows: totals, the
    operation pivot as the mean over k_symbol groups (the reference's
    default pivot), the k_symbol pivot (counts, sums, means), and the card
    issue time (latest transaction day as ``YYMMDD HH:MM:SS`` text, decoded
    with the century prefix)."""
    op = pivot_aggs("operation", OPERATIONS, [("mean", "_n", "op_count"), ("mean", "_s", "op_sum"),
                                              ("mean", group_mean(), "op_mean")])
    ks = []
    for v in K_SYMBOLS:
        hit = F.col("k_symbol") == F.lit(v)
        n, sm = F.sum(F.when(hit, F.col("_n"))), F.sum(F.when(hit, F.col("_s")))
        ks += [n.alias(f"ks_count_{safe_name(v)}"), sm.cast("double").alias(f"ks_sum_{safe_name(v)}"),
               F.try_divide(sm.cast("double"), n.cast("double")).alias(f"ks_mean_{safe_name(v)}")]
    g = groups.groupBy("account_id").agg(
        F.min("_first").alias("first_trans"), F.max("_last").alias("last_trans"),
        F.sum("_rows").alias("total_trans"), F.sum("_s").cast("double").alias("total_sum_trans"),
        F.try_divide(F.sum("_s").cast("double"), F.sum("_n").cast("double")).alias("mean_all_trans"),
        *op, *ks)
    issued = parse_compact_ts(F.date_format("last_trans", "yyMMdd HH:mm:ss"))
    eval_d = F.to_date(F.lit(eval_date))
    return g.select(*[F.col(c).cast("double").alias(c) if c.startswith("op_") else F.col(c)
                      for c in g.columns],
                    F.datediff(eval_d, "last_trans").alias("days_since_last_trans"),
                    F.datediff(eval_d, F.to_date(issued)).alias("card_age_days"))


#: more than four times the days since 1970 of any order
LOAN_SPAN = 1 << 18


def segment_features(customer: DataFrame, orders: DataFrame, eval_date: str = EVAL_DATE) -> DataFrame:
    """What the segmentation takes beside the mart: ``account_id, avg_salary`` (mean
    balance of the client's district), ``days_since_acc_creation`` (since the first
    order), ``total_nbr_orders, average_all_orders``."""
    salary = customer.groupBy("c_nationkey").agg(
        (F.sum(money("c_acctbal")) / F.count("c_acctbal")).cast("double").alias("avg_salary"))
    made = orders.where(F.col("o_custkey").isNotNull()).groupBy("o_custkey").agg(
        F.datediff(F.to_date(F.lit(eval_date)), F.to_date(F.min("o_orderdate"))).alias("days_since_acc_creation"),
        F.count(F.lit(1)).alias("total_nbr_orders"),
        (F.sum(money("o_totalprice")) / F.count("o_totalprice")).cast("double").alias("average_all_orders"))
    return (customer.join(salary, "c_nationkey", "left").join(made, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(F.col("c_custkey").alias("account_id"), "avg_salary", "days_since_acc_creation", "total_nbr_orders", "average_all_orders"))


def order_features(orders: DataFrame, eval_date: str = EVAL_DATE) -> DataFrame:
    """One aggregate per account over orders: standing-order sums per
    symbol, the loan (the account's largest order: A-D status recoded and
    expanded to dummies, days since start) and the first order date."""
    # loan = (start day, status code) of the largest order (ties: the latest, then the
    # last status), packed with the price in cents into one integer, so the arg-max
    # is a maximum in a fixed-width hash aggregate
    codes = ["A", "B", "C", "D"]
    code_idx = (F.when(F.col("o_orderstatus") == "F",
                       F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0))
                .when(F.col("o_orderstatus") == "O", 2).otherwise(3))
    epoch = F.to_date(F.lit("1970-01-01"))
    packed = F.datediff(F.to_date("o_orderdate"), epoch) * 4 + code_idx
    o = orders.where(F.col("o_custkey").isNotNull()).select(
        F.col("o_custkey").alias("account_id"), "o_totalprice", "o_orderdate",
        recode(recode("o_orderpriority", ORDER_SYMBOL_CODE), ORDER_K_SYMBOL,
               ORDER_K_SYMBOL_DEFAULT).alias("k_symbol"),
        money("o_totalprice").alias("amount"), (F.round(F.col("o_totalprice") * 100).cast("long") * LOAN_SPAN + packed).alias("_loan"))
    g = o.groupBy("account_id").agg(
        *pivot_aggs("k_symbol", ORDER_SYMBOLS, [("sum", "amount", "order_sum")]),
        F.pmod(F.max("_loan"), F.lit(LOAN_SPAN)).alias("_loan"), F.min("o_orderdate").alias("first_order"))
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("_loan") % 4 + 1).cast("int"))
    start = F.date_add(epoch, F.floor(F.col("_loan") / 4).cast("int"))
    status = recode(code, LOAN_STATUS)
    g = g.select("*", status.alias("loan_status"),
                 F.datediff(F.to_date(F.lit(eval_date)), start).alias("loan_days"))
    return g.select("account_id", *[F.col(f"order_sum_{safe_name(v)}").cast("double").alias(
        f"order_sum_{safe_name(v)}") for v in ORDER_SYMBOLS], "first_order", "loan_days",
        *dummy_columns("loan_status", LOAN_LABELS, "loan", drop_first=False))


def birth_features(segment: str = "segment", first_order: str = "first_order") -> list:
    """Birth number per client (first order day as ``YYMMDD``, month + 50
    for the 'female' segments) decoded to age, age group and a sex dummy."""
    bn = (F.date_format(first_order, "yyMMdd").cast("int") +
          F.when(F.col(segment).isin(FEMALE_SEGMENTS), 5000).otherwise(0))
    d = decode_birth_number(bn, eval_year=BIRTH_EVAL_YEAR)
    return [d["age"].alias("age"), d["age_group"].alias("age_group"),
            F.when(d["sex"] == "M", 1).otherwise(0).alias("sex_M")]


def clients(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Client base with district (nation) and region dummies.  ``nation``
    and ``region`` are fixed 25- and 5-row dimensions."""
    geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")) \
        .select(F.col("n_nationkey").alias("district_id"), F.col("r_name").alias("region"))
    c = customer.select(F.col("c_custkey").alias("account_id"),
                        F.col("c_nationkey").alias("district_id"),
                        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    c = c.join(geo, "district_id", "left")
    return c.select("account_id", "district_id", "balance", "segment",
                    *dummy_columns("region", REGIONS, "region", drop_first=False))


def bank_mart(customer: DataFrame, nation: DataFrame, region: DataFrame,
              lineitem: DataFrame, orders: DataFrame, eval_date: str = EVAL_DATE) -> DataFrame:
    """One row per client/account.  Inputs are scanned once each: the
    transaction join feeds one two-step aggregate, orders one aggregate,
    and the three keyed frames are left-joined on the account."""
    trans = transactions(lineitem, orders)
    base = clients(customer, nation, region)
    m = build_mart(base, [(trans_features(trans_groups(trans), eval_date), "account_id"),
                          (order_features(orders, eval_date), "account_id")], fill=None)
    m = m.select("*", *birth_features()).drop("segment", "first_order")
    return m.na.fill(0)
