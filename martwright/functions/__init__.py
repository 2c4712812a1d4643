"""Column expressions: recoding, date decoding, flags, cleaning, vectors."""

from .dates import (days_between, decode_birth_number, months_between,
                    parse_compact_ts, parse_yymmdd, relative_date)
from .recode import (bucket_ranges, flag, province, recode, recode_passthrough,
                     region)
from .text import clean_int_code, clean_zip, market_url, url_template
from .vectors import vector_element

__all__ = ["days_between", "decode_birth_number", "months_between",
           "parse_compact_ts", "parse_yymmdd", "relative_date", "bucket_ranges",
           "flag", "province", "recode", "recode_passthrough", "region",
           "clean_int_code", "clean_zip", "market_url", "url_template",
           "vector_element"]
