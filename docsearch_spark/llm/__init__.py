"""Training-data operators: language ID, dedup, decontamination, tokenising, sharding.

Each module holds one operator with a general interface plus the thin registered
query that applies it to its whole table. ``registry`` lists the queries.
"""
