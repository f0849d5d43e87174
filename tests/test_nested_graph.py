"""Statements kept as one row per subject against plain statements."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from annospan.functions.cells import iri_fragment
from annospan.operators import triples as tp
from annospan.operators.common import union_all

SCHEMA = "occurrence_id string, protein_accession string, domain_type_id string, label string, function_tags string, binding_partner string, protein_kegg_ids string"
ROWS = [
    ("o1", "p1", "t1", "one", "DOF:1 a;b", "DOT:000026 ATP", "hsa:1"),
    ("o2", "p1", "t1", "one", "", "x;x", "hsa:2;hsa:1"),
    ("o2", "p2", "t2", " nan ", None, None, None),  # an id twice, with other statements
    ("o2", "p1", "t1", "one", "", "x;x", "hsa:2;hsa:1"),
    ("o 3", " p1", "t3", "first", "b", "", ""),
    ("o_3", "1p", "t3", "second", "b", "", ""),  # one name for two ids
]


def test_summary_by_subject_counts_repeated_subjects_once(spark):
    occ = spark.createDataFrame(ROWS, SCHEMA)
    plain = union_all([tp.triples_occurrences(occ), tp.triples_proteins(occ), tp.triples_vocabulary(occ)])
    rows = union_all([*tp.nested_occurrences(occ), *tp.nested_proteins(occ), tp.nested(tp.triples_vocabulary(occ))])
    want = {tuple(r) for r in tp.graph_summary(plain).collect()}
    assert {tuple(r) for r in tp.subject_summary(rows).collect()} == want
    assert {tuple(r) for r in tp.unnested(rows).distinct().collect()} == {tuple(r) for r in plain.distinct().collect()}
    assert [tuple(r) for r in tp.subject_summary(rows.limit(0)).collect()] == [("triples", 0)]


def test_some_properties_only(spark):
    occ = spark.createDataFrame(ROWS, SCHEMA)
    only = ["rdf:type", "core:hasBindingTarget"]
    want = tp.triples_occurrences(occ).filter(F.col("p").isin(only)).distinct().collect()
    assert sorted(tp.triples_occurrences(occ, only).distinct().collect()) == sorted(want)


def test_label_of_the_first_occurrence(spark):
    occ = spark.createDataFrame(ROWS, SCHEMA)
    assert {tuple(r) for r in tp.collect_types(occ, "occurrence_id").collect()} == {("t1", "one"), ("t2", None), ("t3", "first")}


def test_subject_is_made_before_the_statements(spark):
    plan = tp.triples_occurrences(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Generate")[0]
    assert "pop:Occ_" not in above  # else it would be made again for every statement


def test_fragments_of_odd_values(spark):
    values = [("a b", "a_b"), ("1-2", "id_1-2"), ("nan", "empty"), ("", "empty"), (None, "empty"), (" x", "x"), ("x\n", "x_"), ("é:1", "__1"), ("٣", "_"), (":a", "_a"), ("-", "-"), ("A", "A")]
    out = spark.createDataFrame([(v,) for v, _ in values], "v string").select("v", iri_fragment("v").alias("f")).collect()
    assert [tuple(r) for r in out] == values


def test_no_occurrence_is_dealt_by_its_type_or_term(spark):
    rows = [(f"o{i}", "rdf:type", "core:DomainOccurrence") for i in range(3)] + [(f"o{i}", "core:occursInProtein", "p") for i in range(3)]
    rows += [(f"o{i}", "core:hasDomainType", "t") for i in range(3)] + [(f"o{i}", "core:hasCharacterisation", f"x{i % 2}") for i in range(3)]
    rows += [("t", "rdfs:label", "T"), ("t", "rdfs:label", "U"), ("x0", "rdfs:label", "Transmembrane"), ("x0", "rdf:type", "core:TopologyContext"), ("o0", "core:hasFunctionalRole", "r"), ("r", "rdfs:label", "scaffold")]
    graph = spark.createDataFrame(rows, "s string, p string, o string")
    out = tp.occurrences_by_context(graph, "transmembrane")
    assert sorted(tuple(r) for r in out.collect()) == [("p", o, "t", n) for o in ("o0", "o2") for n in "TU"]
    assert {r["occ"] for r in tp.occurrences_by_context(graph, "transmembrane", "scaffold").collect()} == {"o0"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(dt" not in plan and "hashpartitioning(x#" not in plan


def test_entailment_is_counted_in_the_rows(spark, monkeypatch):
    """The report wrote and shuffled every statement several times."""
    rng = random.Random(5)
    names = [f"n{i}" for i in range(14)]
    properties = sorted(tp.OBJECT_PROPERTIES)
    schema = tp.triples_schema(spark)
    for words, left in ((62, ()), (5, ("hasDomainOccurrence", "isDomainTypeOfOccurrence"))):
        monkeypatch.setattr(tp, "CLASSES_PER_WORD", words)
        used = [p for p in properties if p not in left]
        graph = [(rng.choice(names), f"core:{rng.choice(used)}", rng.choice(names), rng.choice(["iri"] * 5 + ["string"])) for _ in range(90)]
        graph += [(rng.choice(names), "rdf:type", rng.choice(["core:GOTerm", "core:GOFunctionTerm", "core:Protein", "owl:Nothing", "x"]), "iri") for _ in range(25)]
        graph += [("alone", "core:occursInProtein", "n1", "iri"), ("alone", "core:hasBindingTargetChEBI", "b", "iri"), ("alone", "core:hasBindingTarget", "b", "iri")]
        plain = spark.createDataFrame(graph, "s string, p string, o string, o_type string")
        one = plain.dropDuplicates(["s", "p", "o"]).persist()
        gathered = one.filter("s > 'n2'").groupBy("s").agg(F.collect_list(F.struct("p", "o", "o_type")).alias("statements"))
        rows = gathered.unionByName(tp.nested(one.filter("s <= 'n2'"))).unionByName(tp.nested(one.limit(9)))
        want = sorted(tuple(r) for r in tp.entail(one, schema)[2].collect())
        assert sorted(tuple(r) for r in tp.entailment_counts(rows, schema).collect()) == want
    empty = tp.entailment_counts(rows.limit(0), schema).collect()
    assert {r.n for r in empty} == {0} and len(empty) == 4


def test_statements_of_an_occurrence_are_gathered_without_a_shuffle(spark):
    """Every row was sent to its subject with all its statements."""
    from annospan.plans.triple_queries import by_subject, nested_by_subject

    odd = [*ROWS, ("o9", "p1", "t1", "one", "", "x;DOT:000026 ATP", "")]
    occ = spark.createDataFrame(odd, SCHEMA)
    out = nested_by_subject(occ)
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in by_subject(tp.triples_occurrences(occ)).collect())
    alone = out._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti")
    assert len(alone) == 2 and "Aggregate" not in alone[1]
