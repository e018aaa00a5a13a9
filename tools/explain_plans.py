"""Write the physical-plan skeleton of selected queries to docs/PLANS.md.

usage: python tools/explain_plans.py [sf_dir] [name ...]
Keeps the lines that matter for scale: scans (ReadSchema, PushedFilters),
exchanges (shuffles), joins, windows, aggregates and generators.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from versify.plans.catalog import QUERIES  # noqa: E402
from versify.session import local_session  # noqa: E402

DEFAULT = ["evaluate_documents", "rhyme_rate_by_lang", "word_budget", "pack_blocks", "next_token_pairs",
           "best_step", "bpe_pairs", "page_verses"]
KEEP = re.compile(r"(FileScan|Exchange|BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|Window|HashAggregate|Generate|InMemoryTableScan|Scan ExistingRDD)")


def _indent(line: str) -> int:
    m = re.search(r"[A-Za-z*(]", line)
    return m.start() if m else len(line)


def skeleton(plan: str) -> list[str]:
    """Keep the interesting operators; drop the bodies of cached relations
    (Spark prints a cached plan again under every scan of the cache)."""
    out = []
    cached_at = None
    for line in plan.split("\n"):
        ind = _indent(line)
        if cached_at is not None:
            if ind > cached_at:
                continue
            cached_at = None
        if "InMemoryRelation" in line:
            cached_at = ind
            continue
        if KEEP.search(line):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\]", "Location: ...", line)
            out.append(line.rstrip()[:220])
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or DEFAULT
    spark = local_session()
    parts = ["# Physical plan skeletons", "", f"Generated by `tools/explain_plans.py` on `{sf_dir}` (local session, AQE on).",
             "Only scans, exchanges (shuffles), joins, windows, aggregates and generators are kept; bodies of cached",
             "relations are dropped (they were computed once, by an earlier job).",
             "`shuffle exchanges` counts distinct exchange nodes. Branches of a union re-plan identical subplans",
             "(Spark reuses identical exchanges at run time). `SinglePartition` exchanges feed windows over",
             "small tables only: bucket or partition totals and bounded rank sets.", ""]
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = skeleton(plan)
        shuffles = len({l.strip(" :+-|") for l in lines if "Exchange" in l and "Broadcast" not in l})
        parts += [f"## {name}", "", f"shuffle exchanges: {shuffles}", "", "```", *lines, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main()
