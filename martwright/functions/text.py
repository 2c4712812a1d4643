"""String cleaning and templating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .recode import _col, try_cast_str


def clean_int_code(c, replacements: Sequence[tuple[str, str]], fill: int = 0,
                   to: str = "int") -> Column:
    """Literal substring replacements in order, null -> ``fill``, then integer.

    Unparsable leftovers become ``fill`` too (``try_cast``), rather than
    failing the whole job as an ANSI cast would.
    """
    s = _col(c).cast("string")
    for old, new in replacements:
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.coalesce(try_cast_str(s, to), F.lit(fill).cast(to))


# The dirty zip tokens replaced by '0', in the reference's order.
ZIP_REPLACEMENTS = [("SW6 3PS", "0"), (" ", "0")]


def clean_zip(c) -> Column:
    return clean_int_code(c, ZIP_REPLACEMENTS, fill=0)


def url_template(prefix: str, value: Column, suffix: str = "") -> Column:
    """``prefix + value + suffix`` (e.g. a dated market-data URL)."""
    return F.concat(F.lit(prefix), value.cast("string"), F.lit(suffix))


# The market-data URL around the delivery date.
MARKET_URL_PREFIX = ("https://www.epexspot.com/en/market-data?market_area=DE"
                     "&trading_date=&delivery_date=")
MARKET_URL_SUFFIX = ("&underlying_year=&modality=Continuous&sub_modality="
                     "&product=60&data_mode=table&period=")


def market_url(date_col) -> Column:
    return url_template(MARKET_URL_PREFIX,
                        F.date_format(_col(date_col), "yyyy-MM-dd"),
                        MARKET_URL_SUFFIX)
