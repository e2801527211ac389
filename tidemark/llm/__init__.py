"""Training-data operators: text statistics, filtering, deduplication, mixing, search and tokenisation.

Nothing outside this package imports it.  ``registry`` holds the registered queries.
"""
