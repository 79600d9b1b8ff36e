"""Bench: headline scan queries on $BENCH_SF_DIR (default /root/testdata/sf0.1).

Runs each query to completion through the ``noop`` sink (full execution, nothing
collected), one warm-up then the median of $BENCH_RUNS runs (default 3). Prints one JSON
line: total seconds over the headline queries, per-query medians, text volume and
throughput, the whole-file gate gain, the same scans over text without planted indicators, and a
fixed yardstick.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from bundlescan.operators import indicators as IND  # noqa: E402
from bundlescan.operators import lines as L  # noqa: E402
from bundlescan.plans import scan as SCAN  # noqa: E402
from bundlescan.plans.queries import REGISTRY  # noqa: E402
from bundlescan.session import get_spark  # noqa: E402
from bundlescan.sources.corpus import scan_text  # noqa: E402
from bundlescan.sources.fixtures import corpus_files  # noqa: E402


def run(build) -> float:
    """Seconds to build (including any eager checkpoint) and fully execute one query."""
    t = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def clean_text(spark, sf_dir: str):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(F.col("source").alias("bundle_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
                       F.lit(".py").alias("suffix"), "text").repartition(n, "bundle_id", "path")


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(max(8, int(cpus) * 2)),
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
    })
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")

    st = scan_text(spark, sf_dir)
    text_bytes, n_files = st.select(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    text_mb = (text_bytes or 0) / 1e6

    headline = {
        "security_patterns": lambda: REGISTRY["security_patterns"][0](spark, sf_dir),
        "set_extractors": lambda: IND.indicator_rows(IND.file_indicators(scan_text(spark, sf_dir))),
        "redact_secrets": lambda: REGISTRY["redact_secrets"][0](spark, sf_dir),
        "findings_all_keys": lambda: SCAN.findings(SCAN.S.entries(corpus_files(spark, sf_dir))),
        "bundle_report": lambda: REGISTRY["bundle_report"][0](spark, sf_dir),
        "finding_counts": lambda: REGISTRY["finding_counts"][0](spark, sf_dir),
    }
    extra = {
        "security_patterns_no_gate": lambda: L.detector_hits(scan_text(spark, sf_dir), whole_file_gate=False),
        # documents as they are, which hold hardly any indicator
        "security_patterns_clean": lambda: L.detector_hits(clean_text(spark, sf_dir)),
        "set_extractors_clean": lambda: IND.indicator_rows(IND.file_indicators(clean_text(spark, sf_dir))),
        # a fixed piece of work, to tell a slower machine from slower code
        "yardstick": lambda: spark.range(0, 4_000_000, 1, 64).select(F.sha2(F.repeat(F.col("id").cast("string"), 8), 256).alias("h")).agg(F.max("h")),
    }
    medians = {}
    for name, build in {**headline, **extra}.items():
        run(build)  # warm-up
        medians[name] = round(statistics.median(run(build) for _ in range(runs)), 3)

    total = round(sum(medians[k] for k in headline), 3)
    sp = medians["security_patterns"]
    out = {
        "metric": "headline_scan_total",
        "value": total,
        "unit": "sec",
        "queries": {k: medians[k] for k in headline},
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
        "spark": spark.version,
        "text_mb": round(text_mb, 2),
        "files": n_files,
        "security_patterns_mb_per_s": round(text_mb / sp, 2) if sp else None,
        "set_extractors_mb_per_s": round(text_mb / medians["set_extractors"], 2) if medians["set_extractors"] else None,
        "redact_mb_per_s": round(text_mb / medians["redact_secrets"], 2) if medians["redact_secrets"] else None,
        "security_patterns_no_gate_sec": medians["security_patterns_no_gate"],
        "clean_sec": {k: medians[k] for k in ("security_patterns_clean", "set_extractors_clean")},
        "yardstick_sec": medians["yardstick"],
        "gate_gain": round(medians["security_patterns_no_gate"] / sp, 2) if sp else None,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
