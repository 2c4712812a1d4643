"""Operators for preparing training corpora on Spark.

One module per operator; ``queries`` registers the thin ``opN_*`` queries the
driver runs.  Nothing else in the library imports this package.
"""
