"""Headline-query benchmark: prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set).  Every query is run to
completion with the ``noop`` sink (full computation, nothing collected).
An untimed warm-up runs two queries on sf0.001 first (BENCH_WARMUP=0 disables it).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "rhyme_rate_by_lang",
    "evaluate_documents",
    "evaluation_report",
    "rhyme_tags",
    "syllable_count",
    "clean_text",
    "markup",
    "word_budget",
    "char_vocab",
    "pack_blocks",
    "next_token_pairs",
    "doc_perplexity",
    "top_p",
    "pretokenize",
    "bpe_pairs",
    "chat_template",
    "page_verses",
    "best_step",
    "throughput",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    from versify.plans.catalog import QUERIES
    from versify.session import local_session

    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    # Untimed JVM warm-up on the smallest scale factor (code paths get JIT-compiled
    # once; every timed query below still runs in full on BENCH_SF_DIR).
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.environ.get("BENCH_WARMUP", "1") == "1" and os.path.isdir(warm_dir):
        for name in ("rhyme_rate_by_lang", "evaluate_documents"):
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        t0 = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001
            errors[name] = str(e).splitlines()[0][:200]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": int(cpus) if cpus.isdigit() else cpus,
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
