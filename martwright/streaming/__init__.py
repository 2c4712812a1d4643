"""Streaming.

The reference reads finite files only: no stream sources, watermarks,
windows over event time or state exist in it, so nothing is built here (see
README).  Every mart builder is a pure ``DataFrame -> DataFrame`` function,
so it can be applied per micro-batch through ``foreachBatch`` when a caller
needs incremental refreshes.
"""
