"""Print explain("formatted") of headline queries (plan review).

Usage: python scripts/show_plans.py [sf_dir] [key ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docsearch_spark.plans import catalog  # noqa: E402
from docsearch_spark.session import get_spark  # noqa: E402

DEFAULT = ["chunk_fixed", "embed_texts", "text_topk", "topk_batch", "eval_metrics", "replace_by_document"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or DEFAULT
    spark = get_spark("docsearch_plans")
    for key in keys:
        print(f"===== {key} =====")
        catalog.QUERIES[key](spark, sf_dir).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
