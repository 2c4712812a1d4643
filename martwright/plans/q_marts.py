"""Mart queries (donor, bank, churn) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.recode import PROVINCE_BREAKS, REGION_BREAKS
from ..operators.aggregate import recency_lifetime, trailing_window_sums, years_before
from ..operators.columns import decimals_to_double
from . import donor as D
from .catalog import query, tables


# ---------------------------------------------------------------------------
# SQL helpers for the oracles
# ---------------------------------------------------------------------------

def _sql_ranges(col: str, breaks, first_lower, default) -> str:
    parts = []
    for i, (upper, label) in enumerate(breaks):
        cond = f"{col} < {upper}"
        if i == 0:
            cond = f"{col} >= {first_lower} AND {cond}"
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + f" ELSE '{default}' END"


def _sql_dummies(col: str, values, prefix: str, drop_first: bool) -> list[str]:
    from ..operators.aggregate import safe_name
    vals = sorted(values)[1:] if drop_first else sorted(values)
    return [f"CAST(COALESCE({col} = '{v}', FALSE) AS INTEGER) AS {prefix}_{safe_name(v)}"
            for v in vals]


_WIN = {**years_before(D.CUTOFF, D.WINDOW_YEARS), "amt_all": D.SINCE}


def _donor_sql(cutoff: str = D.CUTOFF, campaign_end: str = D.CAMPAIGN_END, since: str = D.SINCE) -> str:
    import datetime as _dt
    _WIN = {**years_before(cutoff, D.WINDOW_YEARS), "amt_all": since}
    _YEARS = list(range(_dt.date.fromisoformat(since).year,
                        (_dt.date.fromisoformat(cutoff) - _dt.timedelta(days=1)).year + 1))
    win = ",\n      ".join(
        f"SUM(CASE WHEN d > DATE '{lo}' AND d < DATE '{cutoff}' THEN a END) AS {n}"
        for n, lo in _WIN.items())
    yrs = ",\n      ".join(f"SUM(CASE WHEN year(d) = {y} THEN a END) AS y{y}" for y in _YEARS)
    mons = ",\n      ".join(f"SUM(CASE WHEN month(d) = {m} THEN a END) AS m{m}" for m in range(1, 13))
    freq = " + ".join(f"CAST(COALESCE(y{y}, 0) > 0 AS INTEGER)" for y in _YEARS)
    quarters = ",\n    ".join(
        f"CAST(COALESCE(m{a},0) + COALESCE(m{a+1},0) + COALESCE(m{a+2},0) AS DOUBLE) AS Q{q}"
        for q, a in ((1, 1), (2, 4), (3, 7), (4, 10)))
    prov = _sql_ranges("zip_int", PROVINCE_BREAKS, 1000, "Missing")
    reg = _sql_ranges("zip_int", REGION_BREAKS, 1000, "Missing")
    dums = ",\n  ".join(_sql_dummies("gender", D.SEGMENTS, "gender", True)
                        + _sql_dummies("province", D.PROVINCES, "province", True)
                        + _sql_dummies("region", D.REGIONS, "region", True))
    amt_cols = ",\n  ".join(f"COALESCE(CAST({n} AS DOUBLE), 0) AS {n}" for n in _WIN)
    return f"""
WITH g AS (
  SELECT o_custkey AS donor_id, o_orderdate AS d, CAST(o_totalprice AS DECIMAL(18,2)) * CAST('0.001' AS DECIMAL(4,3)) AS a
  FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate < DATE '{cutoff}'),
f0 AS (
  SELECT donor_id,
      {win},
      {yrs},
      {mons},
      CAST(MAX(d) AS DATE) AS last_date
  FROM g GROUP BY donor_id),
f AS (
  SELECT donor_id, {", ".join(_WIN)},
    {freq} AS frequency_gifts,
    {quarters},
    CAST(date_diff('day', last_date, DATE '{cutoff}') AS INTEGER) AS recency_days
  FROM f0 WHERE amt_all IS NOT NULL),
camp AS (
  SELECT o_custkey AS donor_id, SUM(CAST(o_totalprice AS DECIMAL(18,2)) * CAST('0.001' AS DECIMAL(4,3))) AS campaign_amount
  FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate >= DATE '{cutoff}'
    AND o_orderdate < DATE '{campaign_end}'
  GROUP BY o_custkey),
z AS (
  SELECT c_custkey AS donor_id, c_mktsegment AS gender,
    CASE WHEN c_mktsegment = 'BUILDING' THEN NULL
         WHEN c_mktsegment = 'MACHINERY' AND c_nationkey = 1 THEN 'SW6 3PS'
         ELSE (CASE WHEN length(zs) < 4 THEN lpad(zs, 4, ' ') ELSE zs END) END AS zipcode
  FROM (SELECT *, CAST(CAST(floor(abs(c_acctbal) * 1.5) AS INTEGER) AS VARCHAR) AS zs FROM customer)),
m AS (
  SELECT z.donor_id, z.gender, camp.campaign_amount, f.*  EXCLUDE (donor_id),
    COALESCE(TRY_CAST(replace(replace(z.zipcode, 'SW6 3PS', '0'), ' ', '0') AS INTEGER), 0) AS zip_int
  FROM z LEFT JOIN camp ON z.donor_id = camp.donor_id LEFT JOIN f ON z.donor_id = f.donor_id),
m2 AS (
  SELECT *, CASE WHEN campaign_amount > {D.LABEL_THRESHOLD} THEN 1 ELSE 0 END AS label,
    {prov} AS province, {reg} AS region FROM m)
SELECT donor_id,
  COALESCE(CAST(campaign_amount AS DOUBLE), 0) AS campaign_amount,
  {amt_cols},
  COALESCE(frequency_gifts, 0) AS frequency_gifts,
  COALESCE(Q1, 0) AS Q1, COALESCE(Q2, 0) AS Q2, COALESCE(Q3, 0) AS Q3, COALESCE(Q4, 0) AS Q4,
  COALESCE(recency_days, 0) AS recency_days, zip_int, label,
  {dums}
FROM m2
"""


@query("mart_donor", _donor_sql())
def mart_donor(spark, sf):
    customer, orders = tables(spark, sf, "customer", "orders")
    return D.donor_mart(customer, orders)


# the same builder one year later: the reference's second campaign (test mart)
_TEST_CUTOFF, _TEST_END = "2001-01-01", "2002-01-01"


@query("mart_donor_next_campaign", _donor_sql(_TEST_CUTOFF, _TEST_END))
def mart_donor_next_campaign(spark, sf):
    customer, orders = tables(spark, sf, "customer", "orders")
    return D.donor_mart(customer, orders, cutoff=_TEST_CUTOFF, campaign_end=_TEST_END)


@query("trailing_window_sums", f"""
SELECT o_custkey AS donor_id,
  {", ".join(f"CAST(SUM(CASE WHEN o_orderdate > DATE '{lo}' THEN CAST(o_totalprice AS DECIMAL(18,2)) * CAST('0.001' AS DECIMAL(4,3)) END) AS DOUBLE) AS {n}" for n, lo in _WIN.items())}
FROM orders
WHERE o_custkey IS NOT NULL AND o_orderdate > DATE '{min(_WIN.values())}' AND o_orderdate < DATE '{D.CUTOFF}'
GROUP BY o_custkey
HAVING amt_all IS NOT NULL
""")
def q_trailing_window_sums(spark, sf):
    (orders,) = tables(spark, sf, "orders")
    gifts = D.gifts_from_orders(orders)
    return decimals_to_double(trailing_window_sums(gifts, "donor_id", "date", "amount",
                                                   D.CUTOFF, _WIN, base_window="amt_all"))


@query("recency_lifetime", f"""
SELECT o_custkey AS donor_id, CAST(MIN(o_orderdate) AS DATE) AS first_date,
  CAST(MAX(o_orderdate) AS DATE) AS last_date,
  CAST(date_diff('day', CAST(MAX(o_orderdate) AS DATE), DATE '{D.CUTOFF}') AS INTEGER) AS recency_days,
  CAST(date_diff('day', CAST(MIN(o_orderdate) AS DATE), CAST(MAX(o_orderdate) AS DATE)) AS INTEGER) AS lifetime_days
FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate < DATE '{D.CUTOFF}'
GROUP BY o_custkey
""")
def q_recency_lifetime(spark, sf):
    (orders,) = tables(spark, sf, "orders")
    gifts = D.gifts_from_orders(orders)
    return recency_lifetime(gifts, "donor_id", "date", D.CUTOFF, cutoff=D.CUTOFF)


# ---------------------------------------------------------------------------
# bank mart
# ---------------------------------------------------------------------------

from ..operators.aggregate import safe_name  # noqa: E402
from . import bank as BK  # noqa: E402
from . import churn as CH  # noqa: E402


def _bank_sql() -> str:
    from .q_agg import _pivot_mean_sql, _trans_sql
    ks = []
    for v in BK.K_SYMBOLS:
        c = f"k_symbol = '{v}'"
        n = safe_name(v)
        ks += [f"COUNT(CASE WHEN {c} THEN amount END) AS ks_count_{n}",
               f"CAST(SUM(CASE WHEN {c} THEN amount END) AS DOUBLE) AS ks_sum_{n}",
               f"CAST(SUM(CASE WHEN {c} THEN amount END) AS DOUBLE) / COUNT(CASE WHEN {c} THEN amount END) AS ks_mean_{n}"]
    from ..functions.recode import ORDER_K_SYMBOL, ORDER_K_SYMBOL_DEFAULT
    from .q_agg import _case
    osym = _case(_case("o_orderpriority", BK.ORDER_SYMBOL_CODE), ORDER_K_SYMBOL, repr(ORDER_K_SYMBOL_DEFAULT))
    ords = [f"CAST(SUM(CASE WHEN ks = '{v}' THEN a END) AS DOUBLE) AS order_sum_{safe_name(v)}"
            for v in BK.ORDER_SYMBOLS]
    op_cols = [f"op_{a}_{safe_name(v)}" for v in BK.OPERATIONS for a in ("count", "sum", "mean")]
    ks_cols = [f"ks_{a}_{safe_name(v)}" for v in BK.K_SYMBOLS for a in ("count", "sum", "mean")]
    ord_cols = [f"order_sum_{safe_name(v)}" for v in BK.ORDER_SYMBOLS]
    from ..functions.recode import LOAN_STATUS
    loan_cols = [f"loan_{safe_name(v)}" for v in BK.LOAN_LABELS]
    fill = ",\n  ".join(f"COALESCE({c}, 0) AS {c}" for c in
                        ["total_trans", "total_sum_trans", "mean_all_trans", "days_since_last_trans"]
                        + op_cols + ks_cols + ord_cols + ["loan_days"] + loan_cols
                        + ["card_age_days", "age", "age_group", "sex_M"])
    loan_case = "CASE " + " ".join(f"WHEN code = '{k}' THEN '{v}'" for k, v in LOAN_STATUS.items()) + " END"
    loan_dums = ", ".join(f"CAST(COALESCE({loan_case} = '{v}', FALSE) AS INTEGER) AS loan_{safe_name(v)}"
                          for v in BK.LOAN_LABELS)
    regs = ", ".join(_sql_dummies("r_name", BK.REGIONS, "region", False))
    return f"""
WITH t AS ({_trans_sql()}),
tot AS (SELECT account_id, MIN(date) AS first_trans, MAX(date) AS last_trans, COUNT(*) AS total_trans,
          CAST(SUM(amount) AS DOUBLE) AS total_sum_trans,
          CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS mean_all_trans,
          CAST(date_diff('day', MAX(date), DATE '{BK.EVAL_DATE}') AS INTEGER) AS days_since_last_trans
        FROM t WHERE account_id IS NOT NULL GROUP BY account_id),
op AS ({_pivot_mean_sql()}),
ks AS (SELECT account_id, {", ".join(ks)} FROM t GROUP BY account_id),
ord AS (SELECT account_id, {", ".join(ords)}
        FROM (SELECT o_custkey AS account_id, {osym} AS ks, CAST(o_totalprice AS DECIMAL(18,2)) AS a
              FROM orders WHERE o_custkey IS NOT NULL) GROUP BY account_id),
base AS (SELECT c.c_custkey AS account_id, c.c_nationkey AS district_id, c.c_acctbal AS balance, {regs}
         FROM customer c LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) g
           ON c.c_nationkey = g.n_nationkey),
loan AS (SELECT account_id, CAST(date_diff('day', CAST(start AS DATE), DATE '{BK.EVAL_DATE}') AS INTEGER) AS loan_days,
                {loan_dums}
         FROM (SELECT o_custkey AS account_id,
                 arg_max(code, (o_totalprice, CAST(o_orderdate AS DATE), code)) AS code,
                 arg_max(o_orderdate, (o_totalprice, CAST(o_orderdate AS DATE), code)) AS start
               FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN (CASE WHEN o_orderpriority = '5-LOW' THEN 'B' ELSE 'A' END)
                                    WHEN o_orderstatus = 'O' THEN 'C' ELSE 'D' END AS code FROM orders)
               WHERE o_custkey IS NOT NULL GROUP BY o_custkey)),
card AS (SELECT account_id, CAST(date_diff('day', CAST(strptime('19' || strftime(MAX(date), '%y%m%d') || ' 00:00:00',
                '%Y%m%d %H:%M:%S') AS DATE), DATE '{BK.EVAL_DATE}') AS INTEGER) AS card_age_days
         FROM t WHERE account_id IS NOT NULL GROUP BY account_id),
birth AS (SELECT account_id, {BK.BIRTH_EVAL_YEAR} - (1900 + yy) AS age,
            CAST(floor(({BK.BIRTH_EVAL_YEAR} - (1900 + yy)) / 10) * 10 AS INTEGER) AS age_group,
            CAST(NOT (mm > 50) AS INTEGER) AS sex_M
          FROM (SELECT account_id, CAST(substr(s, 1, 2) AS INTEGER) AS yy, CAST(substr(s, 3, 2) AS INTEGER) AS mm
                FROM (SELECT c.c_custkey AS account_id,
                        lpad(CAST(CAST(strftime(f.first, '%y%m%d') AS INTEGER)
                             + CASE WHEN c.c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 5000 ELSE 0 END AS VARCHAR), 6, '0') AS s
                      FROM customer c LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS first FROM orders
                                                 WHERE o_custkey IS NOT NULL GROUP BY o_custkey) f
                        ON c.c_custkey = f.o_custkey)))
SELECT base.*, tot.first_trans, tot.last_trans,
  {fill}
FROM base LEFT JOIN tot USING (account_id) LEFT JOIN op USING (account_id)
  LEFT JOIN ks USING (account_id) LEFT JOIN ord USING (account_id)
  LEFT JOIN loan USING (account_id) LEFT JOIN card USING (account_id) LEFT JOIN birth USING (account_id)
"""


def _round_op_means(df):
    return df.select(*[F.round(c, 6).alias(c) if c.startswith("op_mean_") else F.col(c)
                       for c in df.columns])


@query("mart_bank", _bank_sql())
def mart_bank(spark, sf):
    customer, nation, region, lineitem, orders = tables(
        spark, sf, "customer", "nation", "region", "lineitem", "orders")
    return _round_op_means(BK.bank_mart(customer, nation, region, lineitem, orders))


# ---------------------------------------------------------------------------
# churn mart
# ---------------------------------------------------------------------------

# Oracle of the churn mart, written from the rules of the original job: three
# dated tables cut on their own dates, deliveries left-joined, formula inner-joined.
_CHURN_PERIOD = {
    "train": {"sub": "end_date <= DATE '1998-08-31'", "delivery": "CAST(l_shipdate AS DATE) <= DATE '1998-08-31'",
              "complaint": "CAST(ts AS DATE) <= DATE '2024-01-15'", "last_day": "1998-08-31"},
    "score": {"sub": "end_date >= DATE '1998-09-01'", "delivery": "CAST(l_shipdate AS DATE) >= DATE '1998-09-01'",
              "complaint": "CAST(ts AS DATE) >= DATE '2024-01-16'", "last_day": "2002-07-27"},
}


def _churn_sql(period: str = "train", years=None) -> str:
    years = years or CH.YEARS
    cut = _CHURN_PERIOD[period]
    as_of = cut["last_day"]
    def piv(col, values, specs):
        out = []
        for v in values:
            cond = f"{col} = {v!r}" if isinstance(v, str) else f"{col} = {v}"
            for fn, c, alias in specs:
                name = f"{alias}_{safe_name(v)}"
                if fn == "sum":
                    e = f"SUM(CASE WHEN {cond} THEN {c} END)"
                elif fn == "count":
                    e = f"COUNT(CASE WHEN {cond} THEN {c} END)"
                else:
                    e = (f"CAST(SUM(CASE WHEN {cond} THEN {c} END) AS DOUBLE) / "
                         f"NULLIF(COUNT(CASE WHEN {cond} THEN {c} END), 0)")
                out.append((name, e))
        return out
    pivots = (piv("product", CH.PRODUCTS, [("sum", "meals", "sum_meals"), ("sum", "price", "sum_price")])
              + piv("payment_type", CH.PAYMENTS, [("sum", "price", "sum_price_pay"),
                                                  ("sum", "discount", "sum_discount_pay")])
              + piv("start_year", years, [("count", "subscription_id", "n_subscriptions")])
              + piv("formula_type", CH.FORMULAS, [("count", "formula_type", "n_formula"),
                                                  ("sum", "duration", "sum_duration"),
                                                  ("mean", "duration", "avg_duration")]))
    ev = piv("event_type", CH.EVENT_TYPES, [("count", "event_id", "n_complaints")])
    regs = ", ".join(_sql_dummies("r_name", CH.REGIONS, "region", False))
    totals = [
        ("n_subscription_rows", "COUNT(subscription_id)"),
        ("avg_days_subscription", "round(CAST(SUM(date_diff('day', start_date, end_date)) AS DOUBLE) / COUNT(date_diff('day', start_date, end_date)), 6)"),
        ("avg_months_subscription", f"round(CAST(SUM(CAST({_mb_sql('end_date', 'start_date')} AS DECIMAL(18,8))) AS DOUBLE) / COUNT(end_date), 6)"),
        ("sum_meals", "SUM(meals)"), ("min_price", "MIN(price)"), ("max_price", "MAX(price)"),
        ("avg_price", "CAST(SUM(price) AS DOUBLE) / COUNT(price)"), ("sum_price", "SUM(price)"),
        ("min_discount", "MIN(discount)"), ("max_discount", "MAX(discount)"),
        ("sum_discount", "SUM(discount)"),
    ]
    num = [n for n, _ in totals] + [n for n, _ in pivots]
    def _fill(n):
        if n == "n_subscription_rows" or n.startswith(("n_subscriptions", "n_formula")):
            return f"COALESCE({n}, 0) AS {n}"
        if n.startswith("sum_duration"):  # integer sums stay integral (bigint)
            return f"COALESCE(CAST({n} AS BIGINT), 0) AS {n}"
        return f"COALESCE(CAST({n} AS DOUBLE), 0) AS {n}"
    casted = ",\n  ".join(_fill(n) for n in num)
    return f"""
WITH formula(formula_id, formula_type, duration) AS (VALUES
  ('1-URGENT', 'F', 1), ('2-HIGH', 'F', 2), ('3-MEDIUM', 'O', 3), ('4-NOT SPECIFIED', 'O', 6), ('5-LOW', 'F', 12)),
subscriptions AS (
  SELECT * FROM (
    SELECT o_orderkey AS subscription_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS start_date,
           o_orderstatus AS payment_type, formula_type, duration,
           CAST(CAST(o_orderdate AS DATE) + CAST(30 * duration AS INTEGER) AS DATE) AS end_date
    FROM orders JOIN formula ON o_orderpriority = formula_id)
  WHERE {cut["sub"]}),
delivery AS (
  SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount FROM lineitem
  WHERE {cut["delivery"]} AND l_returnflag IS NOT NULL),
t AS (
  SELECT s.*, year(start_date) AS start_year, l_quantity AS meals,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_discount AS DECIMAL(18,2)) AS discount,
         p_type AS product
  FROM subscriptions s LEFT JOIN delivery ON subscription_id = l_orderkey LEFT JOIN part ON l_partkey = p_partkey
  WHERE customer_id IS NOT NULL),
g AS (
  SELECT customer_id, {", ".join(f"{e} AS {n}" for n, e in totals + pivots)},
    MAX(end_date) AS last_end, MIN(start_date) AS first_start
  FROM t GROUP BY customer_id),
ev AS (SELECT user_id AS customer_id, {", ".join(f"{e} AS {n}" for n, e in ev)}
       FROM events WHERE user_id IS NOT NULL AND {cut["complaint"]} GROUP BY user_id),
base AS (SELECT c.c_custkey AS customer_id, {regs}
         FROM customer c LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) gg
           ON c.c_nationkey = gg.n_nationkey)
SELECT g.customer_id,
  {casted},
  last_end, first_start,
  CAST(date_diff('day', last_end, DATE '{as_of}') AS INTEGER) AS days_without_sub,
  CAST(date_diff('day', first_start, last_end) AS INTEGER) AS customer_lifetime,
  CASE WHEN date_diff('day', last_end, DATE '{as_of}') > {CH.CHURN_DAYS} THEN 1 ELSE 0 END AS label,
  {", ".join(f"COALESCE(region_{safe_name(r)}, 0) AS region_{safe_name(r)}" for r in CH.REGIONS)},
  {", ".join(f"COALESCE({n}, 0) AS {n}" for n, _ in ev)}
FROM g LEFT JOIN base USING (customer_id) LEFT JOIN ev USING (customer_id)
"""


def _mb_sql(a: str, b: str) -> str:
    return (f"round((year({a}) - year({b})) * 12 + month({a}) - month({b}) + CASE WHEN day({a}) = day({b}) "
            f"OR ({a} = last_day({a}) AND {b} = last_day({b})) THEN 0 ELSE (day({a}) - day({b})) / 31.0 END, 8)")


@query("mart_churn", _churn_sql())
def mart_churn(spark, sf):
    o, li, p, ev, c, n, r = tables(spark, sf, "orders", "lineitem", "part", "events", "customer",
                                   "nation", "region")
    return CH.churn_mart(o, li, p, ev, c, n, r)


@query("mart_churn_scoring", _churn_sql("score", CH.SCORING_YEARS))
def mart_churn_scoring(spark, sf):
    """The scoring mart: what ended, was delivered and filed after the
    training cut, labelled at the last day (one builder, two calls)."""
    o, li, p, ev, c, n, r = tables(spark, sf, "orders", "lineitem", "part", "events", "customer",
                                   "nation", "region")
    return CH.churn_mart(o, li, p, ev, c, n, r, as_of_date=CH.SCORING_AS_OF,
                         after=CH.SCORING_FROM, years=CH.SCORING_YEARS)
