"""Donor reactivation mart on the driver tables.

Mapping: donors = ``customer``; gifts = ``orders`` (``o_custkey``,
``o_orderdate``, ``o_totalprice``); campaign response = orders in
``[cutoff, campaign_end)``; gender = ``c_mktsegment``; a dirty zip code is
derived from ``c_acctbal``.

Plan shape: ONE scan of orders up to the campaign end (the range is pushed
to parquet) and ONE aggregate per donor computing every gift feature
(windows, calendar, quarters, recency; each conditional on the cutoff) and
the campaign amount together, then one left join onto the donor table.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recode import PROVINCE_BREAKS, REGION_BREAKS, ZIP_DEFAULT, province, region
from ..functions.text import clean_zip
from ..operators.aggregate import (calendar_aggs, calendar_post, recency_aggs,
                                   window_sum_aggs, years_before)
from ..operators.columns import money
from ..operators.encode import dummy_columns

# dates mapped onto the driver tables (orders run 1995-01-01 .. 2001-08-01)
CUTOFF = "2000-01-01"
CAMPAIGN_END = "2001-01-01"
# Fixed values (as in the reference): lower bound of the widest window,
# trailing window lengths in years, campaign amount above which a donor
# counts as a responder.
SINCE = "1995-01-17"
WINDOW_YEARS = (1, 3, 5, 10)
LABEL_THRESHOLD = 35
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PROVINCES = sorted({lab for _, lab in PROVINCE_BREAKS} | {ZIP_DEFAULT})
REGIONS = sorted({lab for _, lab in REGION_BREAKS} | {ZIP_DEFAULT})


#: orders in thousands stand for gifts, so that amounts lie on both sides of the label threshold
GIFT_SCALE = "0.001"


def gifts_from_orders(orders: DataFrame) -> DataFrame:
    scale = F.lit(GIFT_SCALE).cast("decimal(4,3)")
    return orders.select(F.col("o_custkey").alias("donor_id"),
                         F.col("o_orderdate").alias("date"),
                         (money("o_totalprice") * scale).alias("amount"))


def dirty_zip(customer: DataFrame) -> DataFrame:
    """Donor table with a zip code as dirty as the reference's."""
    z = F.floor(F.abs(F.col("c_acctbal")) * 1.5).cast("int").cast("string")
    zip_ = (F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None).cast("string"))
            .when((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_nationkey") == 1), F.lit("SW6 3PS"))
            .otherwise(F.when(F.length(z) < 4, F.lpad(z, 4, " ")).otherwise(z)))
    return customer.select(F.col("c_custkey").alias("donor_id"),
                           F.col("c_mktsegment").alias("gender"), zip_.alias("zipcode"))


def gift_and_campaign_features(gifts: DataFrame, cutoff: str = CUTOFF,
                               campaign_end: str = CAMPAIGN_END, since: str = SINCE,
                               window_years=WINDOW_YEARS) -> DataFrame:
    """Gift features (before ``cutoff``) and the campaign amount (from
    ``cutoff`` to ``campaign_end``) in ONE scan and ONE aggregate per donor.

    Every gift feature is conditional on ``date < cutoff`` and the campaign
    sum on the campaign period, so both periods share the shuffle; gift
    features are then nulled for donors outside the widest window (the
    reference's join base), exactly as the separate aggregates did.
    """
    windows = {**years_before(cutoff, window_years), "amt_all": since}
    first_year = _dt.date.fromisoformat(since).year
    last_year = (_dt.date.fromisoformat(cutoff) - _dt.timedelta(days=1)).year
    years = list(range(first_year, last_year + 1))
    d, hi = F.col("date"), F.to_date(F.lit(cutoff))
    before = F.when(d < hi, F.col("amount"))
    scoped = gifts.where(F.col("donor_id").isNotNull() & (d < F.to_date(F.lit(campaign_end))))
    g = scoped.withColumn("_gift", before).groupBy("donor_id").agg(
        *window_sum_aggs("date", "amount", cutoff, windows),
        *calendar_aggs("date", "_gift", years),
        *recency_aggs("date", cutoff),
        F.sum(F.when(d >= hi, F.col("amount"))).alias("campaign_amount"))
    in_base = F.col("amt_all").isNotNull()
    gift_cols = [F.col(w) for w in windows] + calendar_post(years, keep_months=False) + \
        [F.datediff(hi, F.col("last_date")).alias("recency_days")]
    return g.select("donor_id", "campaign_amount", *gift_cols, in_base.alias("_in_base"))


def donor_mart(customer: DataFrame, orders: DataFrame, cutoff: str = CUTOFF,
               campaign_end: str = CAMPAIGN_END, since: str = SINCE,
               threshold: float = LABEL_THRESHOLD) -> DataFrame:
    """One row per donor of the campaign (every customer), features filled 0.

    Plan: one aggregate over the orders up to the campaign end (gift and
    campaign features together), one left join onto the donor table.
    """
    gifts = gifts_from_orders(orders)
    donors = dirty_zip(customer)
    feats = gift_and_campaign_features(gifts, cutoff, campaign_end, since)
    gift_names = [c for c in feats.columns if c not in ("donor_id", "campaign_amount", "_in_base")]
    feats = feats.select("donor_id", "campaign_amount",
                         *[F.when(F.col("_in_base"), F.col(c)).alias(c) for c in gift_names])
    m = donors.join(feats, "donor_id", "left")
    zipc = clean_zip("zipcode")
    m = m.select("*", zipc.alias("zip_int"))
    m = m.select("*",
                 F.when(F.col("campaign_amount") > threshold, 1).otherwise(0).alias("label"),
                 province("zip_int").alias("province"), region("zip_int").alias("region"))
    m = m.select("*", *dummy_columns("gender", SEGMENTS, "gender", drop_first=True),
                 *dummy_columns("province", PROVINCES, "province", drop_first=True),
                 *dummy_columns("region", REGIONS, "region", drop_first=True))
    m = m.drop("gender", "zipcode", "province", "region")
    num = [f.name for f in m.schema.fields if f.name != "donor_id"]
    m = m.select("donor_id", *[F.col(c).cast("double").alias(c) if c.startswith("amt_") or c in
                               ("campaign_amount", "Q1", "Q2", "Q3", "Q4") else F.col(c) for c in num])
    return m.na.fill(0)
