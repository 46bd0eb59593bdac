"""Write PLANS.md: the executed (adaptive, final) physical plans of headline queries.

usage: python scripts/show_plans.py [sf_dir]
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from qaflow.plans.catalog import Q  # noqa: E402
from qaflow.session import local_session  # noqa: E402

KEYS = ["topk_must", "topk_must_should", "contexts", "rag_pipeline", "consolidate_simple", "patch_articles",
        "get_article", "eval_log_delete", "redact_documents", "cache_write"]


def compact(plan: str) -> str:
    out = []
    for line in plan.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        out.append(line[:170].rstrip())
    return "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    parts = ["# Executed plans\n",
             f"Final adaptive plans after running each query on `{os.path.basename(sf)}` "
             "(`local[8]`, 8 shuffle partitions); expressions cut at 170 characters. "
             "Regenerate with `python scripts/show_plans.py`.\n"]
    for k in KEYS:
        df = Q[k](spark, sf)
        df.collect()  # run this very plan so the adaptive plan is final
        plan = df._jdf.queryExecution().executedPlan().toString()
        parts.append(f"\n## {k}\n\n{(Q[k].__doc__ or '').strip()}\n\n```\n{compact(plan)}\n```\n")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(parts))


if __name__ == "__main__":
    main()
