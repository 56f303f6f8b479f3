"""Print the formatted physical plan of registered queries (default: the headline ones).

usage: python tools/show_plans.py [sf_dir] [name ...]
Fitting steps run (they write model tables); the printed plan is the returned DataFrame's.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.plans.queries import QUERIES  # noqa: E402
from tessera.session import build_session  # noqa: E402

DEFAULT = ["boc_embed", "tfidf_embed", "hashed_embed", "knn_topk", "throttle_by_key"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or DEFAULT
    spark = build_session()
    for name in names:
        print(f"===== {name} =====")
        QUERIES[name](spark, sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
