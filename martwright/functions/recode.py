"""Code -> label recoding as native expressions (no Python row functions).

Each reference lookup was a chain of ``if x == code: return label`` applied
per row; here a dict becomes one CASE expression that stays inside
whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_INTEGRAL = {"tinyint", "byte", "smallint", "short", "int", "integer", "bigint", "long"}
# every string an integral cast can accept: optional blanks/controls, sign,
# digits, an optional fractional part (truncated by the cast), blanks
_INT_LIKE = r"^[\x00-\x20]*[+-]?[0-9]*\.?[0-9]*[\x00-\x20]*$"


def try_cast_str(c, to: str) -> Column:
    """``try_cast`` of a string column; for integral targets a cheap pattern
    test first sends strings that cannot parse straight to null (same
    result, and it avoids the cast's slow failure path on text codes)."""
    c = _col(c)
    if to.lower() not in _INTEGRAL:
        return c.try_cast(to)
    return F.when(c.rlike(_INT_LIKE), c.try_cast(to)).otherwise(F.lit(None).cast(to))


def recode(c, mapping: Mapping, default=None) -> Column:
    """Map codes to labels; unmatched codes and null take ``default``."""
    c = _col(c)
    expr = None
    for code, label in mapping.items():
        cond = c.isNull() if code is None else (c == F.lit(code))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def recode_passthrough(c, mapping: Mapping, cast: str | None = None) -> Column:
    """Map listed codes, leave every other value unchanged (``replace``).

    With ``cast`` the unmatched values are cast too, using ``try_cast`` so an
    unmatched non-numeric code becomes null instead of failing the job.
    """
    c = _col(c)
    expr = None
    for code, label in mapping.items():
        cond = c == F.lit(code)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return c if cast is None else try_cast_str(c.cast("string"), cast)
    if cast is None:
        return expr.otherwise(c)
    return expr.otherwise(try_cast_str(c.cast("string"), cast)).try_cast(cast)


def bucket_ranges(c, breaks: Sequence[tuple], default=None,
                  first_lower: float | None = None) -> Column:
    """Ordered range labels: the first ``(upper, label)`` with ``c < upper`` wins.

    ``first_lower`` adds a lower bound to the first range only, reproducing
    rules such as ``1000 <= z < 1300 -> A; z < 1500 -> B`` where values below
    the first lower bound fall through to the *second* range.  Null input
    takes ``default``.
    """
    c = _col(c)
    expr = None
    for i, (upper, label) in enumerate(breaks):
        cond = c < F.lit(upper)
        if i == 0 and first_lower is not None:
            cond = (c >= F.lit(first_lower)) & cond
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def flag(cond: Column) -> Column:
    """0/1 integer flag; a null condition gives 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


# ---------------------------------------------------------------------------
# Code tables and zip ranges that must equal the reference's
# so that labels and dummy column names match.  Stated in the reference's
# order; the defaults are the reference's catch-all labels.
# ---------------------------------------------------------------------------
TRANS_TYPE = {"PRIJEM": "Credit", "VYDAJ": "Withdrawl"}
TRANS_TYPE_DEFAULT = "Withdrawl"

TRANS_OPERATION = {
    "VYBER KARTOU": "Credit_card_withdrawl",
    "VKLAD": "Credit_in_cash",
    "PREVOD Z UCTU": "Collect_other_bank",
    "VYBER": "Cash_withdrawl",
    "PREVOD NA UCET": "Remit_other_bank",
}
TRANS_OPERATION_DEFAULT = "Other_Operations"

TRANS_K_SYMBOL = {
    "POJISTNE": "Insurance_Payment",
    "SLUZBY": "Statement_Payment",
    "UROK": "Credited_Interest",
    "SANKC. UROK": "Sanction_Interest",
    "SIPO": "Household",
    "DUCHOD": "Old_Age_Pension",
    "UVER": "Loan_Payment",
}
TRANS_K_SYMBOL_DEFAULT = "Other_Payments"

ACCOUNT_FREQUENCY = {"POPLATEK MESICNE": "Monthly_Issuance",
                     "POPLATEK TYDNE": "Weekly_Issuance"}
ACCOUNT_FREQUENCY_DEFAULT = "After_trans_Issuance"

ORDER_K_SYMBOL = {"POJISTNE": "Insurance_payment", "SIPO": "Household_Payment",
                  "LEASING": "leasing", "UVER": "Loan_Payment"}
ORDER_K_SYMBOL_DEFAULT = "Other_Order_Payment"

LOAN_STATUS = {"A": "Finished_Paid", "B": "Finished_NotPaid",
               "C": "Running_Okay", "D": "Running_InDebt"}

LANGUAGE = {"N": 0, "F": 1}

# zip code -> province; the first range also has the lower bound 1000
PROVINCE_BREAKS = [
    (1300, "Brussels"), (1500, "Walloon Brabant"), (2000, "Flemish Brabant"),
    (3000, "Antwerp"), (3500, "Flemish Brabant"), (4000, "Limburg"),
    (5000, "Liege"), (6000, "Namur"), (6600, "Hainaut"), (7000, "Luxembourg"),
    (8000, "Hainaut"), (9000, "West Flanders"), (10000, "East Flanders"),
]
# zip code -> region; same bounds, first range again from 1000
REGION_BREAKS = [
    (1300, "Brussels"), (1500, "Wallonia"), (2000, "Flanders"), (3000, "Flanders"),
    (3500, "Flanders"), (4000, "Flanders"), (5000, "Wallonia"), (6000, "Wallonia"),
    (6600, "Wallonia"), (7000, "Wallonia"), (8000, "Wallonia"), (9000, "Flanders"),
    (10000, "Flanders"),
]
ZIP_FIRST_LOWER = 1000
ZIP_DEFAULT = "Missing"


def province(zip_col) -> Column:
    return bucket_ranges(zip_col, PROVINCE_BREAKS, ZIP_DEFAULT, ZIP_FIRST_LOWER)


def region(zip_col) -> Column:
    return bucket_ranges(zip_col, REGION_BREAKS, ZIP_DEFAULT, ZIP_FIRST_LOWER)
