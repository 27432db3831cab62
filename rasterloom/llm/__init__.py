"""Training-data operators for very large text corpora.

Nothing outside this package imports it.  ``registry`` gathers the queries.
"""
