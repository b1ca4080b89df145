"""Write the physical plans of the headline queries to docs/PLANS.md.

The inputs are the fixture tables of ``sf_dir`` stored as parquet first, as the
real tables would be, so the plans show the scans of stored tables.  Plans are
the ``explain()`` text before execution (AQE re-plans at run time).

usage: python tools/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortcart.plans.inspect import plan_text  # noqa: E402
from cohortcart.plans.queries import bind  # noqa: E402
from cohortcart.session import build_session, scratch_path  # noqa: E402
from cohortcart.sources import fixtures as FX  # noqa: E402
from cohortcart.sources.tables import load_admissions, load_transactions  # noqa: E402

HEADLINE = ["readmit_rate_condition", "risk_score", "dataset_profile", "country_sales", "rfm_values",
            "rfm_scores", "sales_segments", "risk_results_sorted"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=200)
    root = scratch_path(spark, "plans")
    FX.admissions(spark, sf_dir).repartition(8).write.parquet(f"{root}/admissions")
    FX.transactions(spark, sf_dir).repartition(8).write.parquet(f"{root}/transactions")
    loaders = {"admissions": load_admissions, "transactions": load_transactions}
    out = ["# Physical plans of the headline queries", "",
           "Generated by `tools/dump_plans.py` over the sf0.01 fixture tables stored as parquet, with",
           "`spark.sql.shuffle.partitions=200` and AQE on (AQE re-plans at run time: it coalesces",
           "partitions, may switch joins to broadcast and splits skewed join partitions).",
           "`rfm_scores` and `risk_results_sorted` show what runs over their stored intermediate tables.",
           "The only `Exchange SinglePartition` steps finish global one-row aggregates (the profile's",
           "counts, the segments' total): each carries one partial row per task.", ""]
    for key in HEADLINE:
        df = bind(key, lambda s, src, t: loaders[t](s, f"{src}/{t}"))(spark, root)
        text = plan_text(df).strip().replace(root, "<stored>")
        out += [f"## `{key}`", "", "```", text, "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out))
    print(path)
    spark.stop()


if __name__ == "__main__":
    main()
