"""Rows and helpers of the training-data tests."""

EDGE_ROWS = [
    # doc_id, text, lang, source
    (0, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (1, "The quick brown fox  jumps over the lazy dog near the old river bank today. ", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \t\n", None, "b"),
    (5, "word", "en", "b"),
    (6, "!!! ### 123", "en", "b"),
    (7, "é" * 3 + "ß 日本語 naïve space\x1cfs", "fr", "b"),
    (8, "ab " * 6000, "en", "c"),
    (9, "x" * 20000, "en", "c"),
    (10, "same words here and there again and again until the very end of it all", "en", "c"),
    (11, "same words here and there again and again until the very end of it all", "en", "c"),
]


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
