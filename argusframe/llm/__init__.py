"""Training-data operators: search, language models, tokenizing, deduplication and filters.

Nothing outside this package imports it. Shared conventions:

* Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.
* A null text counts as an empty one. Columns an operator does not name are ignored, so tables
  may carry any others.
* Python runs inside tasks over Arrow batches, in pieces of bounded size; Spark partitions,
  shuffles and aggregates everything between them.
"""
