"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores. Every query runs over its whole tables into the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = {
    "interval_order": "w03_w04_domain_order",
    "interval_overlap": "j03_topology_and_sites",
    "interval_nearest": "j05_j06_proximity",
    "type_summary": "a01_a07_type_summary",
    "cooccurrence": "a03_type_cooccurrence",
    "pathway_support": "a20_cq03_pathway_support",
    "network": "a25_network_edges",
    "dedup": "a10_dedup_richest",
    "crosstab": "a15_k04_crosstab_top",
    "table_checks": "q_x01_rule_report",
    "id_injection": "j01_inject_ids",
    "enrichment": "m01_w08_fisher_enrichment",
    "bootstrap": "m03_bootstrap_stability",
    "leave_one_out": "m04_leave_one_group_out",
    "matched_control": "m07_matched_control",
    "mantel": "m18_mantel_spearman",
    "agreement": "a31_agreement_summary",
    "overlap_metrics": "u01_category_overlap",
    "transfer_evaluation": "m21_evaluation_summary",
    "shapes": "q25_shape_report",
    "triples": "g09_graph_summary",
    "label_shuffle": "m05_label_shuffle_control",
    "entailment": "g11_entailment_report",
    "transfer_permutation": "m24_permutation_f1",
}

LIMIT = float(os.environ.get("BENCH_LIMIT", "330"))  # seconds after which no further query begins; they are listed as left out


def main() -> None:
    from annospan.plans.registry import QUERIES
    from annospan.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        f"local[{cpus}]", "annospan-bench",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a13_support"](spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM paths
    times, left_out, start = {}, [], time.time()
    for label, name in HEADLINE.items():
        begin = time.time()
        if begin - start > LIMIT:
            left_out.append(label)
            continue
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[label] = round(time.time() - begin, 3)
        print(label, times[label], file=sys.stderr, flush=True)
    result = {
        "metric": "total_wall_clock_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "left_out": left_out, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
