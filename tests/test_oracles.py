"""Registered queries against their SQL on the smallest tables.

ANNOSPAN_ALL=1 runs every query; the default is one of each family.
"""

import os

import pytest

from annospan.plans import registry
from check import compare, connect

SF = "/root/testdata/sf0.001"
DEFAULT = [
    "w01_w02_overlap_groups", "w03_w04_domain_order", "w05_order_edges_representatives", "j03_topology_and_sites", "j04_disorder_status",
    "j05_j06_proximity", "j08_signature_assignment", "j10_insertion", "a03_type_cooccurrence", "a04_order_pairs", "a10_dedup_richest",
    "a25_network_nodes", "k03_top_k_per_group", "p04_records_dropped", "p08_p10_annotations_long", "f06_f07_f08_id_and_label",
    "f33_pretty_texts", "u01_category_overlap", "j24_pair_conservation", "m01_w08_fisher_enrichment", "m07_matched_sample",
    "m16_mann_whitney", "m12_centred_distances", "m18_mantel_membership", "m19_cluster_agreement", "j01_inject_ids", "q_x01_rule_report", "j15_transfer_architecture",
    "m21_evaluate", "m27_stratified_split", "g05_type_triples", "g11_closure", "s08_feature_table", "s09_domain_entries", "s13_read_fasta",
    "s15_cluster_blocks", "t01_incremental_landing",
]
NAMES = sorted(registry.SQL) if os.environ.get("ANNOSPAN_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_belongs_to_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    outcome = compare(registry.QUERIES[name](spark, SF), con, registry.SQL[name])
    assert outcome.startswith("ok"), outcome


@pytest.mark.parametrize("name", ["m11_w10_pca", "u06_missing_terms", "j13_candidate_pairs"])
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
