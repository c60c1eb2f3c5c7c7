"""Column-level building blocks."""

from docsearch_spark.functions.text import (  # noqa: F401
    CITATION_PATTERN, TOKEN_PATTERN, WS_CLASS, hash_bucket, is_blank,
    normalize_ws, or_empty, py_strip, tokens, uuid_from,
)
from docsearch_spark.functions.vectors import (  # noqa: F401
    cosine_distance, cosine_similarity, dot, l2_distance, l2_normalize, norm,
    score_from_distance,
)
