"""Shape constraints and graph counts against plain loops."""

import random

from pyspark.sql import functions as F

from annospan.operators import rules, triples

TRIPLES = "s string, p string, o string, o_type string"
SHAPES = (
    "shape_id string, target_class string, property string, min_count int, max_count int, datatype string, "
    "min_value double, max_value double, value_class string"
)


def made_graph() -> list[tuple]:
    rng = random.Random(4)
    out = set()
    for k in range(60):
        for cls in rng.sample(["A", "B", "C"], rng.randint(0, 2)):
            out.add((f"n{k}", "rdf:type", cls, "iri"))
        for _ in range(rng.randint(0, 3)):
            out.add((f"n{k}", "size", rng.choice(["1", "7", "50", "x"]), rng.choice(["integer", "string"])))
            out.add((f"n{k}", "near", f"n{rng.randrange(60)}", "iri"))
    return sorted(out)


def test_shapes_equal_plain_loops(spark):
    graph = made_graph()
    shapes = [
        ("S1", "A", "size", 1, 2, "integer", 2.0, 40.0, None), ("S2", "B", "near", 1, 1, None, None, None, "C"),
        ("S3", "C", "near", None, 2, None, None, None, "A"), ("S4", "A", "near", 0, None, "iri", None, None, None),
        ("S5", "Missing", "size", 1, 1, None, None, None, None),
    ]
    types = {(s, o) for s, p, o, _ in graph if p == "rdf:type"}
    want = set()
    for shape, cls, prop, least, most, datatype, low, high, value_class in shapes:
        for s in {s for s, c in types if c == cls}:
            values = [(o, t) for x, p, o, t in graph if (x, p) == (s, prop)]
            numbers = [float(o) for o, _ in values if o.isdigit()]
            checks = {
                "min_count": least is not None and len(values) < least, "max_count": most is not None and len(values) > most,
                "datatype": datatype is not None and any(t != datatype for _, t in values),
                "range": any(low is not None and n < low or high is not None and n > high for n in numbers),
                "class": value_class is not None and any((o, value_class) not in types for o, _ in values),
            }
            want |= {(shape, s, prop, kind) for kind, bad in checks.items() if bad}
    table, plan = spark.createDataFrame(graph, TRIPLES), spark.createDataFrame(shapes, SHAPES)
    found = rules.shape_violations(table, plan)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and {k for *_, k in want} == {"min_count", "max_count", "datatype", "range", "class"}
    report = {r.shape_id: (r.n_focus, r.n_violations, r.status) for r in rules.shape_report(table, plan, found).collect()}
    for shape, cls, *_ in shapes:
        n, bad = len({s for s, c in types if c == cls}), sum(x[0] == shape for x in want)
        assert report[shape] == (n, bad, "WARN" if n == 0 else "FAIL" if bad else "PASS")


def test_graph_summary_counts_distinct_statements(spark):
    graph = made_graph()
    got = {r.measure: r.n for r in triples.graph_summary(spark.createDataFrame(graph + graph[::2], TRIPLES)).collect()}
    want = {"triples": len({x[:3] for x in graph})}
    for s, p, o, _ in graph:
        if p == "rdf:type":
            want[o] = want.get(o, 0) + 1
    assert got == want
    assert [tuple(r) for r in triples.graph_summary(spark.createDataFrame([], TRIPLES)).collect()] == [("triples", 0)]


def test_judged_rows_are_shuffled_by_subject_and_shape_number_alone(spark):
    """Texts of the shapes stay out of the shuffle; type statements can be values too."""
    graph = spark.createDataFrame([*made_graph(), ("n0", "unused", "x", "iri")], TRIPLES)
    shapes = spark.createDataFrame([("S1", "A", "rdf:type", 0, 1, None, None, None, None), ("S2", "A", "near", 1, None, None, None, None, "C")], SHAPES)
    found = rules.shape_violations(graph, shapes)
    keys = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [s#" in x]
    assert keys and all("__shape" in x.split("]")[0] and "target_class" not in x and "property" not in x for x in keys)
    types = [(s, o) for s, p, o, _ in made_graph() if p == "rdf:type"]
    want = {s for s, c in types if c == "A" and sum(x == s for x, _ in types) > 1}
    assert {r.focus for r in found.collect() if r.shape_id == "S1"} == want != set()


def test_subjects_of_one_row_are_judged_in_it(spark, monkeypatch):
    """Every statement was written and shuffled by its subject."""
    graph = spark.createDataFrame([*made_graph(), *[x for x in made_graph() if x[1] == "size"][::3], ("n1", "near", None, "iri")], TRIPLES)
    shapes = spark.createDataFrame([
        ("S1", "A", "size", 1, 2, "integer", 2.0, 40.0, None), ("S2", "B", "near", 1, 1, None, None, None, "C"), ("S3", "C", "near", None, 2, None, None, None, "Missing"),
        ("S4", "A", "rdf:type", 0, 1, "iri", None, None, None), ("S5", "Missing", "size", 1, 1, None, None, 3.0, None),
    ], SHAPES)
    want = sorted(tuple(r) for r in rules.shape_violations(graph, shapes).collect())
    report = sorted(tuple(r) for r in rules.shape_report(graph, shapes, rules.shape_violations(graph, shapes)).collect())
    whole = graph.filter("s > 'n3'").groupBy("s").agg(F.collect_list(F.struct("p", "o", "o_type")).alias("statements"))
    rows = whole.unionByName(triples.nested(graph.filter("s <= 'n3'")))
    for few in (1000, 2):
        monkeypatch.setattr(rules, "FEW_MEMBERS", few)
        judged = rules.judged_rows(rows, shapes)
        found = rules.judged_violations(judged, shapes)
        assert sorted(tuple(r) for r in found.collect()) == want
        assert sorted(tuple(r) for r in rules.judged_report(judged, shapes, found).collect()) == report
