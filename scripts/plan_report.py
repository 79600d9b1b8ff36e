"""Summarise the (initial, adaptive) physical plans of registered queries: shuffle exchanges,
broadcasts chosen by Spark, file scans and their read schemas, and Python stages.

usage: python scripts/plan_report.py [sf_dir] [name ...]   (default: the bench's headline queries)
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bundlescan.plans.queries import REGISTRY  # noqa: E402
from bundlescan.session import get_spark  # noqa: E402

HEADLINE = ["security_patterns", "urls", "redact_secrets", "findings", "bundle_report", "finding_counts",
            "cache_lookup", "embed_text", "expand_archives"]


def summary(df) -> dict:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    txt = buf.getvalue()
    tree = txt.split("\n\n(1)")[0]
    return {
        "exchanges": len(re.findall(r"\bExchange\b", tree)),
        "reused_exchanges": len(re.findall(r"ReusedExchange", tree)),
        "scans": len(re.findall(r"Scan parquet", tree)),
        "broadcasts": len(re.findall(r"BroadcastExchange", tree)),
        "python_stages": len(re.findall(r"MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython", tree)),
        "read_schemas": sorted(set(re.findall(r"ReadSchema: (.*)", txt))),
    }


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or HEADLINE
    spark = get_spark("local[8]", **{"spark.sql.shuffle.partitions": "8"})
    for name in names:
        s = summary(REGISTRY[name][0](spark, sf))
        print(f"{name}: exchanges={s['exchanges']} reused={s['reused_exchanges']} scans={s['scans']} "
              f"broadcasts={s['broadcasts']} python_stages={s['python_stages']}")
        for r in s["read_schemas"]:
            print(f"    ReadSchema {r[:150]}")


if __name__ == "__main__":
    main()
