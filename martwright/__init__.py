"""martwright: customer-analytics marts, features and model evaluation on Spark.

Sub-packages
------------
sources    reading/writing tables, SQL over named frames, web-table extraction
functions  column expressions (recoding, date decoding, flags, cleaning)
operators  DataFrame -> DataFrame operators (profile, aggregate, pivot, join,
           encode, sample, evaluate, train, segment)
plans      end-to-end mart compositions and the query catalogue
streaming  (the reference has no streaming; see README)
"""

__version__ = "0.1.0"
