"""Date decoding and date arithmetic as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .recode import _col


def _six_digits(c) -> Column:
    """Up to six digits, leading zeros restored; anything else (longer text,
    other characters) is null, never a prefix of it."""
    s = _col(c).cast("string")
    return F.when(s.rlike("^[0-9]{1,6}$"), F.lpad(s, 6, "0"))


def parse_yymmdd(c, century: str = "19") -> Column:
    """``YYMMDD`` integer (leading zero may be lost) -> date, century prefixed.

    Spark's two-digit-year rule would map ``930101`` to 2093, so the century
    is always spelled out.  Unparsable values give null.
    """
    s = _six_digits(c)
    return F.try_to_date(F.concat(F.lit(century), s), "yyyyMMdd")


def parse_compact_ts(c, century: str = "19") -> Column:
    """``YYMMDD HH:MM:SS`` string -> timestamp without time zone; text of
    another shape gives null instead of failing the job."""
    x = _col(c)
    well_formed = x.rlike(r"^[0-9]{6} [0-9]{2}:[0-9]{2}:[0-9]{2}$")

    def part(pos, n=2):
        return F.substring(x, pos, n).cast("int")
    ts = F.try_make_timestamp_ntz(F.lit(int(century) * 100) + part(1), part(3), part(5),
                                  part(8), part(11), part(14).cast("decimal(8,6)"))
    return F.when(well_formed, ts)


def days_between(end, start) -> Column:
    """Whole days ``end - start`` (either may be a column or a date string)."""
    end = F.to_date(F.lit(end)) if isinstance(end, str) and "-" in end else _col(end)
    start = F.to_date(F.lit(start)) if isinstance(start, str) and "-" in start else _col(start)
    return F.datediff(end, start)


def months_between(end, start) -> Column:
    """Fractional months on a 31-day basis, rounded to 8 digits (Spark rule)."""
    return F.months_between(_col(end), _col(start), roundOff=True)


def decode_birth_number(c, eval_year: int = 1999, century: int = 1900) -> dict:
    """Decode a ``YYMMDD`` birth number where women have month + 50.

    Returns a dict of named expressions: ``birth_year``, ``birth_month``,
    ``birth_day``, ``sex`` ('F' when month > 50, else 'M'; null when the
    number is null), ``age`` (at
    ``eval_year``) and ``age_group`` (decade: ``age // 10 * 10``).
    """
    s = _six_digits(c)
    yy = F.substring(s, 1, 2).try_cast("int")
    mm = F.substring(s, 3, 2).try_cast("int")
    dd = F.substring(s, 5, 2).try_cast("int")
    year = (F.lit(century) + yy)
    female = mm > F.lit(50)
    month = F.when(female, mm - F.lit(50)).otherwise(mm)
    age = F.lit(eval_year) - year
    return {
        "birth_year": year,
        "birth_month": month,
        "birth_day": dd,
        "sex": F.when(female, F.lit("F")).when(mm.isNotNull(), F.lit("M")),
        "age": age,
        "age_group": F.floor(age / F.lit(10)).cast("int") * F.lit(10),
    }


def relative_date(keyword, anchor) -> Column:
    """``today`` / ``yesterday`` / ``tomorrow`` relative to ``anchor``.

    The anchor is passed in (no hidden clock), so reruns are reproducible;
    any other keyword gives null.
    """
    kw = F.lower(F.trim(_col(keyword)))
    a = _col(anchor)
    return (F.when(kw == "today", a)
            .when(kw == "yesterday", F.date_add(a, -1))
            .when(kw == "tomorrow", F.date_add(a, 1)))
