"""CSV scans that set aside what does not parse.

Every line ends up in one of two tables: the rows that fit the declared schema, and
the rejects with the line as it stood and the reason (``short`` or ``long``: another number
of fields; ``type``: a field that is not of its column's type).  The parsed file is pinned
once, so both tables and their counts describe the same read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import cut_lineage

CORRUPT = "_rejected_line"


def read_csv_checked(spark: SparkSession, path: str, schema: StructType, sep: str = ",", header: bool = True,
                     timestamp_format: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, rejects ``line, reason``) of CSV files; empty fields are null,
    not rejects; a quote inside quotes is doubled."""
    if CORRUPT in schema.fieldNames():
        raise ValueError(f"the schema must not hold {CORRUPT}")
    r = (spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE").option("nullValue", "").option("escape", '"')
         .option("columnNameOfCorruptRecord", CORRUPT))
    if timestamp_format:
        r = r.option("timestampFormat", timestamp_format).option("timestampNTZFormat", timestamp_format)
    seen = cut_lineage(r.schema(StructType([*schema.fields, StructField(CORRUPT, StringType())])).csv(path))
    fields = F.size(F.split(F.regexp_replace(CORRUPT, '"([^"]|"")*"', ""), "\\Q" + sep + "\\E", -1))
    reason = F.when(fields < len(schema.fields), "short").when(fields > len(schema.fields), "long").otherwise("type")
    good = seen.where(F.col(CORRUPT).isNull()).select(*[F.col(f"`{c}`") for c in schema.fieldNames()])
    return good, seen.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), reason.alias("reason"))


def reject_counts(rejects: DataFrame) -> DataFrame:
    """``reason, n``."""
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
