"""Print the formatted physical plan of registered queries.

Usage: python tools/explain.py [--sf /root/testdata/sf0.01] name [name ...]
(k-NN queries checkpoint their inputs while the plan is built, so those jobs run.)
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from factlens.plans.catalog import queries  # noqa: E402
from factlens.session import get_spark  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    spark = get_spark("explain")
    qs = queries()
    for name in a.names:
        print(f"==== {name}")
        qs[name](spark, a.sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
