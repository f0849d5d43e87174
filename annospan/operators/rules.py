"""Declarative table checks.

Row rules are predicate Columns: all of them are evaluated in one pass that
yields the identifiers of the violated rules. Key and cross-table rules are
small plans of their own. Every rule ends in the same shape
``(check_id, row_id, reason)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospan.functions.cells import id_part, id_prefix, missing, namespace_of, safe_float
from annospan.functions.formats import FORMATS
from annospan.operators.common import union_all
from annospan.operators.vocab import known_tokens
from annospan.session import materialise

VIOLATION = "check_id string, row_id string, reason string"
FEW_MEMBERS = 1000  # of a value class that are held by the driver and in the plan

# Namespaces that must not appear in a column.
FORBIDDEN = [
    ("DOP", "function_tags"),
    ("DOP", "binding_partner"),
    ("DOF", "positional_category"),
    ("DOF", "topology_context"),
    ("DOF", "proximity_categories"),
    ("DOF", "copy_number_property"),
    ("DOT", "function_tags"),
    ("DOT", "positional_category"),
    ("DOT", "topology_context"),
    ("DOP", "continuity_category"),
]
# Identifier prefixes a table may use.
KNOWN_PREFIXES = ["INTERPRO", "PFAM", "CDD", "SMART", "NCBIFAM", "PRINTS", "PROFILE", "DOP", "DOF", "DOT", "GO", "CHEBI", "PR", "IPR", "MOD"]


@dataclass(frozen=True)
class RowRule:
    """``violation``: true where the row breaks the rule; ``reason`` may depend on the row."""

    check_id: str
    violation: Column
    reason: Column | str
    severity: str = "FAIL"
    hint: str = ""

    def text(self) -> Column:
        return F.lit(self.reason) if isinstance(self.reason, str) else self.reason


@dataclass
class RuleBook:
    """Registry of rules; plan rules are added with the ``register`` decorator."""

    row_rules: list[RowRule] = field(default_factory=list)
    plan_rules: dict[str, tuple[str, str, Callable[[dict[str, DataFrame]], DataFrame]]] = field(default_factory=dict)

    def add(self, *rules: RowRule) -> RuleBook:
        self.row_rules.extend(rules)
        return self

    def register(self, check_id: str, severity: str = "FAIL", hint: str = ""):
        """Register ``fn(tables) -> (row_id, reason)``."""

        def keep(fn):
            self.plan_rules[check_id] = (severity, hint, fn)
            return fn

        return keep

    def ids(self) -> list[tuple[str, str, str]]:
        rows = [(r.check_id, r.severity, r.hint) for r in self.row_rules]
        return rows + [(k, v[0], v[1]) for k, v in self.plan_rules.items()]


def row_violations(df: DataFrame, row_id: str, rules: Sequence[RowRule]) -> DataFrame:
    """Violations of all row rules in one pass over the table."""
    items = F.array_compact(F.array(*[
        F.when(F.coalesce(r.violation, F.lit(False)), F.struct(F.lit(r.check_id).alias("check_id"), r.text().alias("reason")))
        for r in rules
    ]))
    # explode_outer: a plain explode would evaluate all predicates once more to skip empty arrays
    out = df.select(F.col(row_id).cast("string").alias("row_id"), F.explode_outer(items).alias("v"))
    return out.select("v.check_id", "row_id", "v.reason").filter("check_id is not null")


def run_rules(tables: dict[str, DataFrame], book: RuleBook, table: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """(report, flagged): every rule with its count and status, and all violations."""
    parts = []
    if book.row_rules:
        parts.append(row_violations(tables[table], row_id, book.row_rules))
    for check_id, (_, _, fn) in book.plan_rules.items():
        parts.append(fn(tables).select(F.lit(check_id).alias("check_id"), F.col("row_id").cast("string").alias("row_id"), "reason"))
    flagged = union_all(parts)
    return rule_report(flagged, book.ids(), tables[table].sparkSession), flagged


def rule_report(flagged: DataFrame, rules: Sequence[tuple[str, str, str]], spark) -> DataFrame:
    """One row per rule, those without violations included."""
    listed = spark.createDataFrame(list(rules), "check_id string, severity string, hint string")
    counts = flagged.groupBy("check_id").agg(F.count(F.lit(1)).alias("n_issues"))
    out = listed.join(counts, "check_id", "left").fillna(0, ["n_issues"])
    return out.withColumn("status", F.when(F.col("n_issues") == 0, "PASS").otherwise(F.col("severity")))


def rule_metrics(report: DataFrame) -> DataFrame:
    """(metric, value): rules checked, failing and passing."""
    n = lambda status: F.count(F.when(F.col("status") == status, 1))
    sums = report.agg(F.count(F.lit(1)).alias("n_rules"), n("FAIL").alias("rules_failing"), n("PASS").alias("rules_passing"))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in sums.columns]))
    return sums.select(rows.alias("x")).select("x.*")


def status_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("n_checks"), F.sum("n_issues").alias("n_issues"))


# Row rule builders ---------------------------------------------------------


def blank_key(check_id: str, col: str) -> RowRule:
    return RowRule(check_id, missing(col), f"{col} is blank")


def bad_format(check_id: str, col: str, kind: str, severity: str = "FAIL") -> RowRule:
    value = F.trim(F.col(col).cast("string"))
    return RowRule(check_id, ~missing(col) & ~value.rlike(FORMATS[kind]), f"{col} is not a valid {kind} identifier", severity)


def bad_tokens(check_id: str, cols: dict[str, Column], kind: str, severity: str = "FAIL") -> RowRule:
    """Any token of several columns outside the format (identifier part only)."""
    toks = F.flatten(F.array(*cols.values()))
    bad = F.filter(toks, lambda t: ~id_part(t).rlike(FORMATS[kind]))
    return RowRule(check_id, F.size(bad) > 0, F.concat(F.lit(f"not {kind}: "), F.array_join(bad, ";")), severity)


def namespace_mismatch(check_id: str, id_col: str, namespace_col: str) -> RowRule:
    found = namespace_of(F.col(id_col))
    return RowRule(check_id, found.isNotNull() & (found != F.trim(namespace_col)), "namespace differs from the identifier prefix")


def not_in_list(check_id: str, col: str, allowed: Sequence[str]) -> RowRule:
    return RowRule(check_id, ~missing(col) & ~F.trim(F.col(col)).isin(list(allowed)), f"{col} is not an accepted value")


def prefix_mismatch(check_id: str, id_col: str, db_col: str) -> RowRule:
    return RowRule(
        check_id, ~missing(db_col) & ~F.col(id_col).startswith(F.concat(F.upper(F.trim(db_col)), F.lit(":"))),
        "identifier prefix differs from the source database",
    )


def bad_span(check_id: str, start: str, end: str) -> RowRule:
    """Integer, positive and ordered coordinates; all broken conditions in one reason."""
    s, e = safe_float(start), safe_float(end)
    whole = lambda v: v.isNotNull() & (v == F.floor(v))
    reason = F.concat_ws(
        "; ",
        F.when(~whole(s), f"{start} is not an integer"),
        F.when(~whole(e), f"{end} is not an integer"),
        F.when(s <= 0, f"{start} is not positive"),
        F.when(e <= 0, f"{end} is not positive"),
        F.when(s >= e, f"{start} is not below {end}"),
    )
    return RowRule(check_id, F.coalesce(reason, F.lit("")) != "", reason)


def single_value(check_id: str, cols: dict[str, Column]) -> RowRule:
    reason = F.concat_ws("; ", *[F.when(F.size(t) != 1, f"{c} must hold one value") for c, t in cols.items()])
    return RowRule(check_id, reason != "", reason)


def unknown_prefix(check_id: str, tokens: Column, prefixes: Sequence[str] = KNOWN_PREFIXES) -> RowRule:
    bad = F.filter(tokens, lambda t: id_prefix(t).isNotNull() & ~id_prefix(t).isin(list(prefixes)))
    return RowRule(check_id, F.size(bad) > 0, F.concat(F.lit("unknown prefix: "), F.array_join(bad, ";")), "WARN")


def double_chebi(check_id: str, tokens: Column) -> RowRule:
    bad = F.filter(tokens, lambda t: t.rlike(FORMATS["chebi_double"]))
    return RowRule(check_id, F.size(bad) > 0, "repeated CHEBI prefix", "WARN")


def wrong_column(check_id: str, columns: dict[str, Column], forbidden=FORBIDDEN) -> RowRule:
    """Tokens of a namespace that must not appear in their column."""
    hits = [
        F.when(F.exists(columns[c], lambda t: t.startswith(f"{ns}:")), f"{ns} term in {c}")
        for ns, c in forbidden if c in columns
    ]
    reason = F.concat_ws("; ", *hits)
    return RowRule(check_id, reason != "", reason)


# Plan rule builders --------------------------------------------------------


def duplicate_key(df: DataFrame, key: Sequence[str], row_id: str) -> DataFrame:
    """All members of groups that share a key."""
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*key)
    return df.join(groups, list(key), "left_semi").select(F.col(row_id).alias("row_id"), F.lit("duplicate key").alias("reason"))


def duplicate_row(df: DataFrame, row_id: str, ignore: Sequence[str] = ()) -> DataFrame:
    """Rows equal to another one in all columns but the ignored ones."""
    cols = [c for c in df.columns if c not in (row_id, *ignore)]
    hashed = df.withColumn("__h", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    maybe = hashed.join(hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__h"), "__h", "left_semi")
    groups = maybe.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    cond = [maybe[c].eqNullSafe(groups[c]) for c in cols]
    return maybe.join(groups, cond, "left_semi").select(F.col(row_id).alias("row_id"), F.lit("duplicate row").alias("reason"))


def missing_reference(fact: DataFrame, dim: DataFrame, key: str, row_id: str) -> DataFrame:
    """Rows whose key is absent from the dimension."""
    return fact.filter(~missing(key)).join(dim.select(key).distinct(), key, "left_anti").select(
        F.col(row_id).alias("row_id"), F.concat(F.lit("unknown reference: "), F.col(key).cast("string")).alias("reason")
    )


def outside_vocabulary(tokens: DataFrame, index: DataFrame, row_id: str, namespace: str | None = None) -> DataFrame:
    """Tokens no spelling of which is in their vocabulary (tokens: row_id, term_type, token).

    With ``namespace`` a token of another namespace is reported as such, and an
    identifier of the right namespace is accepted even when it is new.
    """
    # A reason depends on the token alone: it is found once for each, and the few bad tokens are
    # written, so that their size is known and no row is shuffled by its token.
    known = known_tokens(tokens, index).select("term_type", "token", "known")
    if namespace is None:
        bad = F.when(~F.col("known"), F.concat(F.lit("not in vocabulary: "), F.col("token")))
    else:
        ns = namespace_of(id_part("token"))
        own = id_part("token").rlike(f"^{namespace}:\\d+$")
        bad = F.when(ns.isNotNull() & (ns != namespace), F.concat(F.lit("wrong namespace: "), F.col("token"))).when(
            ~F.col("known") & ~own, F.concat(F.lit("unrecognised: "), F.col("token"))
        )
    reasons = materialise(known.withColumn("reason", bad).filter("reason is not null").select("term_type", "token", "reason"), "bad-tokens")
    return tokens.join(reasons, ["term_type", "token"]).select(F.col(row_id).alias("row_id"), "reason")


def foreign_vocabulary(tokens: DataFrame, forbidden: DataFrame, row_id: str) -> DataFrame:
    """Tokens that belong to a vocabulary their column must not use (forbidden: column_name, form)."""
    forms = tokens.withColumn("form", F.lower(F.trim("token")))
    bad = forbidden.select("column_name", F.lower("form").alias("form")).distinct()
    return forms.join(bad, ["column_name", "form"], "left_semi").select(
        F.col(row_id).alias("row_id"), F.concat(F.lit("foreign term: "), F.col("token")).alias("reason")
    )


# Shapes over triples -------------------------------------------------------


def classed_objects(types: DataFrame, shapes: DataFrame) -> DataFrame:
    """(o, value_class, __ok): members of the value classes of the shapes, from (s, target_class) type statements."""
    wanted = shapes.select("value_class").filter("value_class is not null").distinct()
    # Written, so that its size is known before the values are shuffled.
    return materialise(
        types.select(F.col("s").alias("o"), F.col("target_class").alias("value_class")).join(wanted, "value_class", "left_semi")
        .distinct().withColumn("__ok", F.lit(True)), "classes",
    )


def shape_violations(triples: DataFrame, shapes: DataFrame, has_class: DataFrame | None = None) -> DataFrame:
    """Cardinality, datatype, range and class constraints per (class, property).

    shapes: shape_id, target_class, property, min_count, max_count, datatype,
    min_value, max_value, value_class (nulls switch a constraint off).

    Statements that no shape names are left out first. Type statements and plain
    values are met with the shapes in one scan and summed per (subject, shape
    number) before the shuffle, which carries no text but the subject; values are
    joined with the types of their objects only where a shape names a value class.
    A repeated type statement counts once, repeated values count each. ``has_class`` is
    given (``classed_objects``) where ``triples`` are not the whole graph.
    """
    shapes = materialise(shapes.withColumn("__shape", F.monotonically_increasing_id()), "shapes")
    if has_class is None:
        has_class = classed_objects(triples.filter("p = 'rdf:type'").select("s", F.col("o").alias("target_class")), shapes)
    number = F.col("o").try_cast("double")

    def flags(bad_class: Column) -> list[Column]:
        value = F.coalesce("is_value", F.lit(False))
        return [
            "s", "__shape", (~value).alias("focus"), value.cast("int").alias("value"),
            (value & (F.col("o_type") != F.col("datatype"))).alias("bad_type"),
            (value & ((number < F.col("min_value")) | (number > F.col("max_value")))).alias("bad_range"), bad_class.alias("bad_class"),
        ]

    as_focus = shapes.select(F.lit("rdf:type").alias("p"), F.col("target_class").alias("__object"), F.lit(False).alias("is_value"), "__shape", "datatype", "min_value", "max_value")
    as_value = shapes.filter("value_class is null").select(F.col("property").alias("p"), F.lit(None).cast("string").alias("__object"), F.lit(True).alias("is_value"), "__shape", "datatype", "min_value", "max_value")
    uses = materialise(as_focus.unionByName(as_value), "uses")
    met = triples.filter("o is not null").join(uses, "p").filter("__object is null or __object = o")
    plain = met.select(*flags(F.lit(None).cast("boolean")))
    classed = shapes.filter("value_class is not null").select(F.col("property").alias("p"), F.lit(True).alias("is_value"), "__shape", "datatype", "min_value", "max_value", "value_class")
    classed = triples.filter("o is not null").join(classed, "p").join(has_class, ["o", "value_class"], "left").select(*flags(F.col("__ok").isNull()))
    per = plain.unionByName(classed).groupBy("s", "__shape").agg(
        F.max("focus").alias("focus"), F.sum("value").alias("n"), *[F.max(c).alias(c) for c in ("bad_type", "bad_range", "bad_class")],
    ).filter("focus").join(shapes.select("__shape", "shape_id", "property", "min_count", "max_count"), "__shape")
    kinds = F.array_compact(F.array(
        F.when(F.col("n") < F.col("min_count"), "min_count"), F.when(F.col("n") > F.col("max_count"), "max_count"),
        F.when(F.col("bad_type"), "datatype"), F.when(F.col("bad_range"), "range"), F.when(F.col("bad_class"), "class"),
    ))
    return per.select("shape_id", F.col("s").alias("focus"), "property", F.explode(kinds).alias("constraint"))


def shape_report(triples: DataFrame, shapes: DataFrame, violations: DataFrame) -> DataFrame:
    """Focus nodes and violations per shape; a shape without focus nodes is a warning."""
    types = triples.filter("p = 'rdf:type'").select(F.col("o").alias("target_class"), "s")
    types = types.join(shapes.select("target_class").distinct(), "target_class", "left_semi").distinct()
    return _report(types, shapes, violations)


def _report(types: DataFrame, shapes: DataFrame, violations: DataFrame) -> DataFrame:
    """From one row (target_class) per focus node."""
    focus = types.groupBy("target_class").agg(F.count(F.lit(1)).alias("n_focus"))
    bad = violations.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n_violations"))
    out = shapes.select("shape_id", "target_class").join(focus, "target_class", "left").join(bad, "shape_id", "left").fillna(0)
    return out.withColumn(
        "status", F.when(F.col("n_focus") == 0, "WARN").when(F.col("n_violations") == 0, "PASS").otherwise("FAIL")
    )


@dataclass(frozen=True)
class JudgedRows:
    """Rows (s, statements) of subjects of one row, statements of the others, and the members of value classes."""

    alone: DataFrame
    rest: DataFrame
    has_class: DataFrame


def judged_rows(rows: DataFrame, shapes: DataFrame) -> JudgedRows:
    """Prepare (s, statements) rows for ``judged_violations``: subjects of several rows are told by the counts of their digests.

    The rows are written: names cost more to make than to read.
    """
    told = F.filter("statements", lambda x: x["o"].isNotNull())
    marked = materialise(rows.select("s", told.alias("statements"), F.xxhash64("s").alias("__d")), "rows")
    shared = materialise(marked.groupBy("__d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__d", F.lit(True).alias("__shared")), "shared")
    known = marked.join(shared, "__d", "left").drop("__d")
    classes = [r.value_class for r in shapes.select("value_class").distinct().collect() if r.value_class is not None]
    typed = F.filter("statements", lambda x: (x["p"] == "rdf:type") & x["o"].isin(*classes)) if classes else F.filter("statements", lambda x: F.lit(False))
    types = marked.select("s", F.explode_outer(typed).alias("x")).filter("x is not null").select("s", F.col("x.o").alias("target_class"))
    rest = known.filter("__shared").select("s", F.explode("statements").alias("x")).select("s", "x.*")
    return JudgedRows(known.filter("__shared is null").drop("__shared"), materialise(rest, "rest"), classed_objects(types, shapes))


def judged_violations(judged: JudgedRows, shapes: DataFrame) -> DataFrame:
    """The result of ``shape_violations`` from rows: a subject of one row is judged in it, so its statements are not shuffled.

    The driver holds the shapes and, of value classes of at most ``FEW_MEMBERS`` members, the members. Values of larger
    classes are joined with them, statement by statement.
    """
    members: dict[str, list[str]] = {}
    sizes = {r.value_class: r.n for r in judged.has_class.groupBy("value_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [c for c, n in sizes.items() if n <= FEW_MEMBERS]
    for r in judged.has_class.filter(F.col("value_class").isin(*few)).collect() if few else []:
        members.setdefault(r.value_class, []).append(r.o)
    found, joined, held = [], [], {}
    for i, shape in enumerate(shapes.collect()):
        if sizes.get(shape.value_class, 0) > FEW_MEMBERS:
            joined.append(shape)
        else:
            held |= _looked_at(shape, f"__focus{i}", f"__values{i}")
            found.append(_judged(F.col(f"__focus{i}"), F.col(f"__values{i}"), shape, members.get(shape.value_class, [])))
    out = shape_violations(judged.rest, shapes, judged.has_class)
    if found:
        # explode_outer: a plain explode would judge the row once more to skip empty ones
        inside = judged.alone.withColumns(held).select("s", F.explode_outer(F.flatten(F.array(*found))).alias("x")).filter("x is not null")
        out = out.unionByName(inside.select("x.shape_id", F.col("s").alias("focus"), "x.property", "x.constraint"))
    if joined:
        used = [x for shape in joined for x in (shape.property, "rdf:type")]
        single = judged.alone.select("s", F.explode(F.filter("statements", lambda x: x["p"].isin(*used))).alias("x")).select("s", "x.*")
        out = out.unionByName(shape_violations(single, shapes.sparkSession.createDataFrame(joined, shapes.schema), judged.has_class))
    return out


def _looked_at(shape, focus: str, values: str) -> dict[str, Column]:
    """Columns that tell whether a row is a focus node of the shape, and its values."""
    return {
        focus: F.exists("statements", lambda x: (x["p"] == "rdf:type") & (x["o"] == shape.target_class)),
        values: F.filter("statements", lambda x: x["p"] == shape.property),
    }


def _judged(focus: Column, values: Column, shape, members: Sequence[str]) -> Column:
    """(shape_id, property, constraint) of one shape that the values of a row violate."""
    number = lambda x: x["o"].try_cast("double")
    tests = {
        "min_count": shape.min_count is not None and F.size(values) < shape.min_count,
        "max_count": shape.max_count is not None and F.size(values) > shape.max_count,
        "datatype": shape.datatype is not None and F.exists(values, lambda x: x["o_type"] != shape.datatype),
        "range": (shape.min_value is not None or shape.max_value is not None) and F.exists(
            values, lambda x: F.coalesce((number(x) < F.lit(shape.min_value).cast("double")) | (number(x) > F.lit(shape.max_value).cast("double")), F.lit(False))
        ),
        "class": shape.value_class is not None and F.exists(values, lambda x: ~x["o"].isin(*members) if members else F.lit(True)),
    }
    made = lambda kind: F.struct(F.lit(shape.shape_id).alias("shape_id"), F.lit(shape.property).alias("property"), F.lit(kind).alias("constraint"))
    return F.array_compact(F.array(*[F.when(focus & test, made(kind)) for kind, test in tests.items() if test is not False], F.lit(None).cast("struct<shape_id:string,property:string,constraint:string>")))


def judged_report(judged: JudgedRows, shapes: DataFrame, violations: DataFrame) -> DataFrame:
    """The result of ``shape_report`` from rows: focus nodes of one row are counted in it."""
    classes = sorted({r.target_class for r in shapes.select("target_class").distinct().collect()})
    types = F.array_distinct(F.transform(F.filter("statements", lambda x: (x["p"] == "rdf:type") & x["o"].isin(*classes)), lambda x: x["o"]))
    alone = judged.alone.select(F.explode_outer(types).alias("target_class")).filter("target_class is not null")
    rest = judged.rest.filter(F.col("p") == "rdf:type").select("s", F.col("o").alias("target_class")).filter(F.col("target_class").isin(*classes)).distinct()
    return _report(alone.unionByName(rest.select("target_class")), shapes, violations)
