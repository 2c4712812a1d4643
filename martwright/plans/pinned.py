"""Results that several queries of a session read, pinned once.

A result is kept by the session, its name and the state of the files it is made
of (path, length, time of change), so a changed table is read anew.  A few
results are kept at a time, each as a reliable checkpoint in the shared folder.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage

MOST = 8
_KEPT: OrderedDict[tuple, DataFrame] = OrderedDict()


def _state(spark: SparkSession, files: Sequence[str]) -> tuple:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for f in sorted(files):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((f, status.getLen(), status.getModificationTime()))
    return tuple(out)


def once(spark: SparkSession, name: str, sources: Sequence[DataFrame], build: Callable[[], DataFrame]) -> DataFrame:
    """The pinned result of ``build()``, made once for these sources."""
    key = (spark.sparkContext.applicationId, name, _state(spark, {f for s in sources for f in s.inputFiles()}))
    if key not in _KEPT:
        _KEPT[key] = cut_lineage(build())
        while len(_KEPT) > MOST:
            _KEPT.popitem(last=False)
    _KEPT.move_to_end(key)
    return _KEPT[key]
