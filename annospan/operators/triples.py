"""Triple tables (s, p, o, o_type), pattern queries and entailment.

Names are compact (``core:``, ``pop:``, ``prot:``, ``obo:``); ``o_type`` is
``iri`` or a literal type. Every builder is one projection of the occurrence
table into an array of (p, o, o_type) that is exploded, so no shuffle happens
before the final ``distinct``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospan.functions.cells import (
    blank_to_null,
    display_label,
    extract_chebi,
    iri_fragment,
    missing,
    ordinal_index,
    safe_bool,
    safe_float,
    safe_int,
    split_cell,
    split_multi,
)
from annospan.operators.common import union_all
from annospan.operators.summaries import cooccurrence
from annospan.session import cut_lineage, materialise

TRIPLE = ["s", "p", "o", "o_type"]

# Classes and their parent.
CLASS_PARENTS = {
    "Protein": "Entity",
    "DomainOccurrence": "Entity",
    "DomainType": "Entity",
    "PositionalCategory": "AnnotationTerm",
    "TopologyContext": "AnnotationTerm",
    "CopyNumberCategory": "AnnotationTerm",
    "ProximityCategory": "AnnotationTerm",
    "DisorderStatus": "AnnotationTerm",
    "FunctionalCategory": "AnnotationTerm",
    "DiscontinuityPattern": "AnnotationTerm",
    "InsertionCategory": "AnnotationTerm",
    "StructuralCoverageQuality": "AnnotationTerm",
    "AnnotationTerm": "Entity",
    "GOTerm": "Entity",
    "GOFunctionTerm": "GOTerm",
    "GOProcessTerm": "GOTerm",
    "GOCellularComponent": "GOTerm",
    "BindingTarget": "Entity",
    "ChEBIEntity": "BindingTarget",
    "CATHSuperfamily": "Entity",
    "KEGGEntry": "Entity",
    "ReactomePathway": "Entity",
    "DomainOrderPattern": "Entity",
    "CooccurrencePattern": "Entity",
}
# Object properties with domain and range.
OBJECT_PROPERTIES = {
    "occursInProtein": ("DomainOccurrence", "Protein"),
    "hasDomainOccurrence": ("Protein", "DomainOccurrence"),
    "hasDomainType": ("DomainOccurrence", "DomainType"),
    "isDomainTypeOfOccurrence": ("DomainType", "DomainOccurrence"),
    "hasCharacterisation": (None, None),
    "hasProximityContext": ("DomainOccurrence", "ProximityCategory"),
    "hasFunctionalRole": (None, "FunctionalCategory"),
    "hasGOAnnotation": ("DomainType", "GOTerm"),
    "hasStructuralClass": ("DomainType", "CATHSuperfamily"),
    "hasBindingTarget": ("DomainOccurrence", "BindingTarget"),
    "hasBindingTargetChEBI": ("DomainOccurrence", "ChEBIEntity"),
    "isDomainNeighbour": (None, "DomainType"),
    "cooccursWith": (None, "DomainType"),
    "hasKEGG": ("Protein", "KEGGEntry"),
    "hasReactome": ("Protein", "ReactomePathway"),
    "hasDomainOrderPattern": ("DomainType", "DomainOrderPattern"),
}
INVERSES = [("hasDomainOccurrence", "occursInProtein"), ("isDomainTypeOfOccurrence", "hasDomainType")]
SYMMETRIC = ["cooccursWith"]
SUB_PROPERTIES = [("hasBindingTargetChEBI", "hasBindingTarget")]

# Occurrence columns with their literal property and type.
OCCURRENCE_LITERALS = [
    ("occurrence_id", "occurrenceId", "string"),
    ("start", "startPos", "integer"),
    ("end", "endPos", "integer"),
    ("segments", "segmentsText", "string"),
    ("relative_start", "relativeStart", "decimal"),
    ("relative_end", "relativeEnd", "decimal"),
    ("relative_midpoint", "relativeMidpoint", "decimal"),
    ("ordinal_position_group", "ordinalPosition", "string"),
    ("copy_number", "copyNumber", "integer"),
    ("continuity_category", "continuityCategory", "string"),
    ("gap_from_prev", "gapFromPrev", "integer"),
    ("gap_to_next", "gapToNext", "integer"),
    ("adjacent_to_prev", "adjacentToPrev", "boolean"),
    ("adjacent_to_next", "adjacentToNext", "boolean"),
    ("nearest_tm_distance", "nearestTmDistance", "integer"),
    ("signal_cleavage_pos", "signalCleavagePos", "integer"),
    ("nearest_signal_cleavage_distance", "nearestSignalCleavageDistance", "integer"),
    ("nearest_active_site_distance", "nearestActiveSiteDistance", "integer"),
    ("binding_site_types", "bindingSiteText", "string"),
    ("function_tags", "functionTagsText", "string"),
]
# Vocabulary columns: property, class and name prefix of the individual.
VOCABULARY_COLUMNS = [
    ("positional_category", "hasCharacterisation", "PositionalCategory", "Pos_"),
    ("topology_context", "hasCharacterisation", "TopologyContext", "Topo_"),
    ("continuity_category", "hasCharacterisation", "DiscontinuityPattern", "Disc_"),
    ("insertion_category", "hasCharacterisation", "InsertionCategory", "Ins_"),
    ("disorder_status", "hasCharacterisation", "DisorderStatus", "Dis_"),
    ("proximity_categories", "hasProximityContext", "ProximityCategory", "Prox_"),
    ("function_tags", "hasFunctionalRole", "FunctionalCategory", "FuncCat_"),
]
POSITION_TERMS = ["Nterminal", "Internal", "Cterminal", "unknown"]
COPY_TERMS = ["single", "repeated", "unknown"]


def _po(p: str, o: Column, o_type: str = "iri") -> Column:
    prop = p if ":" in p else f"core:{p}"
    return F.struct(F.lit(prop).alias("p"), o.cast("string").alias("o"), F.lit(o_type).alias("o_type"))


def _each(tokens: Column, p: str, make) -> Column:
    return F.transform(tokens, lambda t: _po(p, make(t)))


def _emit(df: DataFrame, s: Column, arrays: Sequence[Column]) -> DataFrame:
    """One projection: all statements of a row in one array."""
    # The subject is a column before the explode, which would otherwise make it again for every statement.
    # explode_outer: a plain explode would build the array once more to skip empty ones
    named = df.withColumn("__s", s)
    return named.select("__s", F.explode_outer(F.flatten(F.array(*arrays))).alias("x")).select(F.col("__s").alias("s"), "x.*").filter("o is not null")


def _nest(df: DataFrame, s: Column, arrays: Sequence[Column]) -> DataFrame:
    """(s, statements): the statements of each row as one array."""
    held = F.filter(F.flatten(F.array(*arrays)), lambda x: x["o"].isNotNull())
    return df.select(s.alias("s"), held.alias("statements"))


def nested(triples: DataFrame) -> DataFrame:
    """(s, statements) with one statement a row."""
    return triples.select("s", F.array(F.struct("p", "o", "o_type")).alias("statements"))


def unnested(rows: DataFrame) -> DataFrame:
    """Back from (s, statements) to statements."""
    return rows.select("s", F.explode("statements").alias("x")).select("s", "x.*")


def protein_iri(c) -> Column:
    return F.concat(F.lit("prot:"), iri_fragment(F.col(c).cast("string") if isinstance(c, str) else c))


def type_iri(c) -> Column:
    return F.concat(F.lit("pop:DomainType_"), iri_fragment(F.col(c) if isinstance(c, str) else c))


def occurrence_iri(c) -> Column:
    return F.concat(F.lit("pop:Occ_"), iri_fragment(F.col(c) if isinstance(c, str) else c))


def term_iri(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"pop:{prefix}"), iri_fragment(value))


def obo_name(value: Column) -> Column:
    return F.concat(F.lit("obo:"), F.regexp_replace(F.upper(F.trim(value)), ":", "_"))


def triples_schema(spark) -> DataFrame:
    """Class and property declarations with parents, domains, ranges and characteristics."""
    rows = []
    for cls, parent in CLASS_PARENTS.items():
        rows += [(f"core:{cls}", "rdf:type", "owl:Class"), (f"core:{cls}", "rdfs:subClassOf", f"core:{parent}")]
    for prop, (dom, rng) in OBJECT_PROPERTIES.items():
        rows.append((f"core:{prop}", "rdf:type", "owl:ObjectProperty"))
        rows += [(f"core:{prop}", k, f"core:{v}") for k, v in (("rdfs:domain", dom), ("rdfs:range", rng)) if v]
    for _, prop, dtype in OCCURRENCE_LITERALS:
        rows += [(f"core:{prop}", "rdf:type", "owl:DatatypeProperty"), (f"core:{prop}", "rdfs:range", f"xsd:{dtype}")]
    rows += [(f"core:{a}", "owl:inverseOf", f"core:{b}") for a, b in INVERSES]
    rows += [(f"core:{p}", "rdf:type", "owl:SymmetricProperty") for p in SYMMETRIC]
    rows += [(f"core:{a}", "rdfs:subPropertyOf", f"core:{b}") for a, b in SUB_PROPERTIES]
    return spark.createDataFrame([(*r, "iri") for r in rows], "s string, p string, o string, o_type string").distinct()


def _individuals(values: DataFrame) -> DataFrame:
    """Statements of (iri, cls, value) individuals: type, label, identifier of a labelled value."""
    label = display_label("value")
    return _emit(values, F.col("iri"), [
        F.array(
            _po("rdf:type", F.concat(F.lit("core:"), F.col("cls"))), _po("rdf:type", F.lit("owl:NamedIndividual")),
            _po("rdfs:label", label, "string"),
            _po("externalId", F.when(label != F.trim("value"), F.col("value")), "string"),
        )
    ])


def triples_vocabulary(occ: DataFrame) -> DataFrame:
    """One individual per (prefix, value) in use, plus the fixed position and copy terms."""
    present = [(c, cls, pre) for c, _, cls, pre in VOCABULARY_COLUMNS if c in occ.columns]
    cells = F.array(*[
        F.transform(_terms(c), lambda t: F.struct(F.lit(cls).alias("cls"), F.lit(pre).alias("pre"), t.alias("value")))
        for c, cls, pre in present
    ])
    # Few distinct rows: cells are split once for each.
    used = occ.select(*[c for c, _, _ in present]).distinct().select(F.explode(F.flatten(cells)).alias("v")).select("v.*").distinct()
    fixed = occ.sparkSession.createDataFrame(
        [("PositionalCategory", "Pos_", t) for t in POSITION_TERMS] + [("CopyNumberCategory", "Copy_", t) for t in COPY_TERMS],
        "cls string, pre string, value string",
    )
    values = used.unionByName(fixed).distinct()
    return _individuals(values.select(F.concat(F.lit("pop:"), F.col("pre"), iri_fragment("value")).alias("iri"), "cls", "value"))


def _terms(column: str) -> Column:
    """Tokens of a vocabulary column; a blank position counts as unknown."""
    toks = F.array_distinct(split_cell(column))
    if column == "positional_category":
        return F.when(F.size(toks) == 0, F.array(F.lit("unknown"))).otherwise(toks)
    return toks


def collect_types(occ: DataFrame, position: str) -> DataFrame:
    """(domain_type_id, label, label_db, label_acc): all types in use, neighbours included."""
    others = [c for c in ("prev_domain_type", "next_domain_type", "cooccurring_domain_types") if c in occ.columns]
    named = [c for c in ("label", "label_db", "label_acc") if c in occ.columns]
    rows = occ.filter(~missing("domain_type_id"))
    own = rows.select("domain_type_id").distinct()
    if named:
        # Most types have one value in each column, which needs no position: only rows of the others are compared.
        value = lambda c: F.when(~missing(c) & F.col("__placed"), blank_to_null(c))
        values = rows.select("domain_type_id", *named, F.col(position).isNotNull().alias("__placed")).distinct()
        values = materialise(values.groupBy("domain_type_id").agg(
            F.greatest(*[F.count_distinct(value(c)) for c in named], F.lit(0), F.lit(0)).alias("__n"), *[F.max(value(c)).alias(c) for c in named]
        ), "types")
        unclear = rows.join(values.filter("__n > 1").select("domain_type_id"), "domain_type_id", "left_semi")
        own = values.filter("__n <= 1").drop("__n").unionByName(unclear.groupBy("domain_type_id").agg(
            *[F.min_by(blank_to_null(c), F.when(~missing(c), F.col(position))).alias(c) for c in named]
        ))
    if not others:
        return own
    extra = occ.select(*others).distinct().select(F.explode(F.flatten(F.array(*[split_cell(c) for c in others]))).alias("domain_type_id")).distinct()
    return extra.unionByName(own.select("domain_type_id")).distinct().join(own, "domain_type_id", "left")


def triples_proteins(occ: DataFrame) -> DataFrame:
    """Proteins with label, location text and pathway links."""
    own, rest = _proteins(occ, _emit)
    return union_all([own, *rest]).distinct()


def nested_proteins(occ: DataFrame) -> list[DataFrame]:
    """The same as (s, statements): the cells of a protein are gathered into one row (per location text)."""
    lists = [F.array_join(F.collect_set(c), ";").alias(c) for c in ("protein_kegg_ids", "protein_reactome_ids") if c in occ.columns]
    own, rest = _proteins(occ, _nest, lambda rows, keys: rows.groupBy(*keys).agg(*lists) if lists else rows.distinct())
    return [own, *rest]


def _proteins(occ: DataFrame, emit, gather=None) -> tuple[DataFrame, list[DataFrame]]:
    wanted = ("protein_accession", "protein_subcellular_location", "protein_kegg_ids", "protein_reactome_ids")
    occ = occ.select(*[c for c in wanted if c in occ.columns])
    occ = occ if gather else occ.distinct()
    rows = occ.filter(~missing("protein_accession"))
    rows = gather(rows, [c for c in wanted[:2] if c in occ.columns]) if gather else rows
    s = protein_iri("protein_accession")
    arrays = [F.array(
        _po("rdf:type", F.lit("core:Protein")), _po("rdf:type", F.lit("owl:NamedIndividual")),
        _po("rdfs:label", F.concat(F.lit("Protein "), F.col("protein_accession").cast("string")), "string"),
    )]
    if "protein_subcellular_location" in occ.columns:
        arrays.append(F.array(_po("subcellularLocationText", blank_to_null("protein_subcellular_location"), "string")))
    parts = []
    for col, prop, cls, prefix in (
        ("protein_kegg_ids", "hasKEGG", "KEGGEntry", "KEGG_"), ("protein_reactome_ids", "hasReactome", "ReactomePathway", "Reactome_"),
    ):
        if col in occ.columns:
            arrays.append(_each(split_multi(col), prop, lambda t: term_iri(prefix, t)))
            ids = occ.select(F.explode(split_multi(col)).alias("value")).distinct()
            parts.append(emit(ids, term_iri(prefix, F.col("value")), [F.array(
                _po("rdf:type", F.lit(f"core:{cls}")), _po("rdf:type", F.lit("owl:NamedIndividual")), _po("externalId", F.col("value"), "string"),
            )]))
    return emit(rows, s, arrays), parts


def triples_types(occ: DataFrame, position: str) -> DataFrame:
    """Domain types: identifiers, GO terms by aspect, functional roles, structure."""
    types = collect_types(occ, position)
    wanted = (
        "domain_type_id", "go_terms_all", "go_terms_mf", "go_terms_bp", "go_terms_cc", "function_tags",
        "cath_superfamilies", "structural_coverage_quality",
    )
    occ = occ.select(*[c for c in wanted if c in occ.columns]).distinct()
    base = [
        _po("rdf:type", F.lit("core:DomainType")), _po("rdf:type", F.lit("owl:NamedIndividual")),
        _po("rdfs:label", F.coalesce(F.col("label"), F.col("domain_type_id")) if "label" in types.columns else F.col("domain_type_id"), "string"),
        _po("domainTypeId", F.col("domain_type_id"), "string"),
    ]
    for col, prop in (("label_db", "sourceDB"), ("label_acc", "accession")):
        if col in types.columns:
            base.append(_po(prop, F.col(col), "string"))
    parts = [_emit(types, type_iri("domain_type_id"), [F.array(*base)])]
    links = []
    for col, cls in (("go_terms_all", None), ("go_terms_mf", "GOFunctionTerm"), ("go_terms_bp", "GOProcessTerm"), ("go_terms_cc", "GOCellularComponent")):
        if col in occ.columns:
            links.append(_each(split_multi(col), "hasGOAnnotation", obo_name))
            ids = occ.filter(~missing("domain_type_id")).select(F.explode(split_multi(col)).alias("v")).distinct()
            kinds = [_po("rdf:type", F.lit("core:GOTerm")), _po("rdf:type", F.lit("owl:NamedIndividual"))]
            if cls:
                kinds.append(_po("rdf:type", F.lit(f"core:{cls}")))
            parts.append(_emit(ids, obo_name(F.col("v")), [F.array(*kinds)]))
    if "function_tags" in occ.columns:
        links.append(_each(split_cell("function_tags"), "hasFunctionalRole", lambda t: term_iri("FuncCat_", t)))
    if "cath_superfamilies" in occ.columns:
        links.append(_each(split_multi("cath_superfamilies"), "hasStructuralClass", lambda t: term_iri("CATHSF_", t)))
        ids = occ.select(F.explode(split_multi("cath_superfamilies")).alias("v")).distinct()
        parts.append(_emit(ids, term_iri("CATHSF_", F.col("v")), [F.array(
            _po("rdf:type", F.lit("core:CATHSuperfamily")), _po("rdf:type", F.lit("owl:NamedIndividual")),
            _po("rdfs:label", F.concat(F.lit("CATH superfamily "), F.col("v")), "string"), _po("externalId", F.col("v"), "string"),
        )]))
    if "structural_coverage_quality" in occ.columns:
        q = blank_to_null("structural_coverage_quality")
        links.append(_each(F.array_compact(F.array(q)), "hasCharacterisation", lambda t: term_iri("StructQ_", t)))
        ids = occ.select(q.alias("value")).filter("value is not null").distinct()
        parts.append(_individuals(ids.select(term_iri("StructQ_", F.col("value")).alias("iri"), F.lit("StructuralCoverageQuality").alias("cls"), "value")))
    if links:
        parts.append(_emit(occ.filter(~missing("domain_type_id")), type_iri("domain_type_id"), links))
    return union_all(parts).distinct()


_LITERAL_CAST = {"integer": safe_int, "decimal": safe_float, "boolean": safe_bool, "string": blank_to_null}


def triples_occurrences(occ: DataFrame, only: Sequence[str] = ()) -> DataFrame:
    """All statements about occurrences (or those of some properties), and the binding targets they name.

    Occurrence ids must be unique (de-duplicate first): repeated statements are
    then removed inside the row and the large part of the graph is not shuffled.
    """
    own, rest = _occurrence_parts(occ, _emit, only)
    out = union_all([own, union_all(rest).distinct()]) if rest else own
    return out.filter(F.col("p").isin(*only)) if only else out


def nested_occurrences(occ: DataFrame, only: Sequence[str] = ()) -> list[DataFrame]:
    """The same as (s, statements): a row per occurrence, and those of the binding targets."""
    own, rest = _occurrence_parts(occ, _nest, only)
    return [own, *rest]


def _occurrence_parts(occ: DataFrame, emit, only: Sequence[str] = ()) -> tuple[DataFrame, list[DataFrame]]:
    """Statements of the occurrences and, each by itself, of what they name; ``only`` leaves the others unmade."""
    wanted = lambda p: not only or (p if ":" in p else f"core:{p}") in only
    s = occurrence_iri("occurrence_id")
    rows = occ.filter(~missing("occurrence_id") & ~missing("protein_accession") & ~missing("domain_type_id"))
    fixed = [
        ("rdf:type", F.lit("core:DomainOccurrence"), "iri"), ("rdf:type", F.lit("owl:NamedIndividual"), "iri"),
        ("rdfs:label", F.concat(F.lit("DomainOccurrence "), F.col("occurrence_id")), "string"),
        ("occursInProtein", protein_iri("protein_accession"), "iri"), ("hasDomainType", type_iri("domain_type_id"), "iri"),
    ]
    fixed += [(p, _LITERAL_CAST[t](c), t) for c, p, t in OCCURRENCE_LITERALS if c in occ.columns]
    if "ordinal_label_nc" in occ.columns:
        fixed.append(("ordinalPositionIndex", ordinal_index(F.col("ordinal_label_nc"), F.lit(None).cast("int")), "integer"))
    if "copy_number" in occ.columns:
        n = safe_int("copy_number")
        term = F.when(n == 1, "single").when(n.isNotNull(), "repeated").otherwise("unknown")
        fixed.append(("hasCharacterisation", F.concat(F.lit("pop:Copy_"), term), "iri"))
    near = [blank_to_null(c) for c in ("prev_domain_type", "next_domain_type") if c in occ.columns]
    near_types = F.array_distinct(F.array_compact(F.array(*near))) if near else None
    none = F.array().cast("array<struct<p:string,o:string,o_type:string>>")
    made = [_po(*x) for x in fixed if wanted(x[0])]
    arrays = [F.array(*made) if made else none]
    if near and wanted("isDomainNeighbour"):
        arrays.append(_each(near_types, "isDomainNeighbour", type_iri))
    for c, prop, _, prefix in VOCABULARY_COLUMNS:
        if c in occ.columns and wanted(prop):
            arrays.append(_each(_terms(c), prop, lambda t: term_iri(prefix, t)))
    if "cooccurring_domain_types" in occ.columns and wanted("cooccursWith"):
        arrays.append(_each(F.array_distinct(split_cell("cooccurring_domain_types")), "cooccursWith", type_iri))
    parts = []
    text = []
    if "binding_partner" in occ.columns:
        target = lambda t: term_iri("BindingTarget_", F.when(t.rlike(r"^DOT:\d+\s"), F.substring_index(t, " ", 1)).otherwise(t))
        if wanted("hasBindingTarget"):
            arrays.append(_each(F.array_distinct(split_cell("binding_partner")), "hasBindingTarget", target))
        text.append(F.col("binding_partner"))
        names = rows.select("binding_partner").distinct().select(F.explode(split_cell("binding_partner")).alias("v")).distinct()
        coded = F.col("v").rlike(r"^DOT:\d+\s")
        parts.append(emit(names, target(F.col("v")), [F.array(
            _po("rdf:type", F.lit("core:BindingTarget")), _po("rdf:type", F.lit("owl:NamedIndividual")),
            _po("rdfs:label", F.when(coded, F.trim(F.regexp_replace("v", r"^DOT:\d+\s+", ""))).otherwise(F.col("v")), "string"),
            _po("externalId", F.when(coded, F.substring_index("v", " ", 1)), "string"),
        )]))
    if "binding_target_chebi" in occ.columns:
        text.append(F.col("binding_target_chebi"))
    if text:
        chebi = extract_chebi(F.concat_ws(";", *text))
        if wanted("hasBindingTargetChEBI"):
            arrays.append(_each(chebi, "hasBindingTargetChEBI", obo_name))
        ids = rows.select(*[c for c in ("binding_partner", "binding_target_chebi") if c in occ.columns]).distinct().select(F.explode(chebi).alias("v")).distinct()
        parts.append(emit(ids, obo_name(F.col("v")), [F.array(
            _po("rdf:type", F.lit("core:ChEBIEntity")), _po("rdf:type", F.lit("owl:NamedIndividual")),
        )]))
    if not any(wanted(p) for p in ("rdf:type", "rdfs:label", "externalId")):
        parts = []
    return emit(rows, s, arrays), parts


def triples_order_patterns(pairs: DataFrame) -> DataFrame:
    """Pattern individuals from (first_type, second_type, occurrence_support, protein_support)."""
    a, b = F.col("first_type"), F.col("second_type")
    s = F.concat(F.lit("pop:DomOrder_"), iri_fragment(a), F.lit("__"), iri_fragment(b))
    own = _emit(pairs, s, [F.array(
        _po("rdf:type", F.lit("core:DomainOrderPattern")), _po("rdf:type", F.lit("owl:NamedIndividual")),
        _po("rdfs:label", F.concat(F.lit("Domain order: "), a, F.lit(" -> "), b), "string"),
        _po("supportProteins", F.col("protein_support"), "integer"), _po("supportOccurrences", F.col("occurrence_support"), "integer"),
        _po("orderDomainTypeA", type_iri(a)), _po("orderDomainTypeB", type_iri(b)),
    )])
    back = pairs.select(F.explode(F.array_distinct(F.array(type_iri(a), type_iri(b)))).alias("s"), s.alias("o"))
    return own.unionByName(back.select("s", F.lit("core:hasDomainOrderPattern").alias("p"), "o", F.lit("iri").alias("o_type")))


def triples_cooccurrence(occ: DataFrame, entity: str = "protein_accession", type_id: str = "domain_type_id") -> DataFrame:
    """Co-occurrence patterns with their support, and the symmetric links."""
    pairs = cooccurrence(occ.filter(~missing(entity) & ~missing(type_id)), entity, type_id)
    a, b = F.col("domain_a"), F.col("domain_b")
    s = F.concat(F.lit("pop:CoOcc_"), iri_fragment(a), F.lit("__"), iri_fragment(b))
    stacked = pairs.select(F.explode(F.array(
        *[F.struct(s.alias("s"), x["p"].alias("p"), x["o"].alias("o"), x["o_type"].alias("o_type")) for x in (
            _po("rdf:type", F.lit("core:CooccurrencePattern")), _po("rdf:type", F.lit("owl:NamedIndividual")),
            _po("rdfs:label", F.concat(F.lit("Co-occurrence: "), a, F.lit(" + "), b), "string"),
            _po("supportProteins", F.col("protein_count"), "integer"),
            _po("domainTypeA", type_iri(a)), _po("domainTypeB", type_iri(b)),
        )],
        *[F.struct(x.alias("s"), F.lit("core:cooccursWith").alias("p"), y.alias("o"), F.lit("iri").alias("o_type"))
          for x, y in ((type_iri(a), type_iri(b)), (type_iri(b), type_iri(a)))],
    )).alias("t"))
    return stacked.select("t.*")


def graph_summary(triples: DataFrame) -> DataFrame:
    """(measure, n): distinct triples, named individuals and members per class.

    Statements are told apart by two 64-bit digests, so no text but the class
    names is shuffled, and total and classes are counted in one pass. An empty
    graph has the total of 0 alone.
    """
    keys = triples.select(
        F.xxhash64("s", "p", "o").alias("d1"), F.xxhash64(F.lit(1), "o", "p", "s").alias("d2"),
        F.when(F.col("p") == "rdf:type", F.col("o")).alias("cls"),
    ).distinct()
    counts = keys.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct(F.lit(True).alias("whole"), F.lit("triples").alias("measure")), F.struct(F.lit(False).alias("whole"), F.col("cls").alias("measure")))
    rows = counts.select(F.explode(both).alias("m"), "n").select("m.*", "n").filter("measure is not null")
    rows = rows.unionByName(triples.sparkSession.range(1).select(F.lit(True).alias("whole"), F.lit("triples").alias("measure"), F.lit(0).alias("n")))
    return rows.groupBy("whole", "measure").agg(F.sum("n").alias("n")).select("measure", "n")


def subject_summary(rows: DataFrame) -> DataFrame:
    """The same from (s, statements) rows.

    A subject of one row alone needs no shuffle of its statements: they are counted in the row.
    Subjects are told to be alone by the counts of their digests; those of several rows
    (or with a digest in common) are summarised statement by statement.
    """
    marked = rows.withColumn("__d", F.xxhash64("s"))
    # Written, so that its size is known; few subjects have several rows.
    shared = materialise(marked.groupBy("__d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__d", F.lit(True).alias("__shared")), "shared")
    # As text, as sets of text are hashed; the length keeps property and object apart.
    told = F.array_distinct(F.transform("statements", lambda x: F.concat(F.length(x["p"]).cast("string"), F.lit(":"), x["p"], x["o"])))
    classes = F.array_distinct(F.transform(F.filter("statements", lambda x: x["p"] == "rdf:type"), lambda x: x["o"]))
    no, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    count = lambda whole, measure, n: F.struct(no.alias("d1"), no.alias("d2"), F.lit(whole).alias("whole"), measure.alias("measure"), n.alias("n"))
    in_row = F.concat(F.array(count(True, F.lit("triples"), F.size(told).cast("long"))), F.transform(classes, lambda o: count(False, o, one)))
    single = F.transform("statements", lambda x: F.struct(
        F.xxhash64("s", x["p"], x["o"]).alias("d1"), F.xxhash64(F.lit(1), x["o"], x["p"], "s").alias("d2"), F.lit(False).alias("whole"),
        F.when(x["p"] == "rdf:type", x["o"]).alias("measure"), one.alias("n"),
    ))
    parts = marked.join(shared, "__d", "left").select(F.explode(F.when(F.col("__shared"), single).otherwise(in_row)).alias("x")).select("x.*")
    parts = parts.groupBy("d1", "d2", "whole", "measure").agg(F.sum("n").alias("n"))
    of_single = F.array(*[
        F.struct(F.lit(w).alias("whole"), m.alias("measure"), one.alias("n")) for w, m in ((True, F.lit("triples")), (False, F.col("measure")))
    ])
    counts = parts.select(F.explode(F.when(F.col("d1").isNotNull(), of_single).otherwise(F.array(F.struct("whole", "measure", "n")))).alias("x")).select("x.*")
    least = rows.sparkSession.range(1).select(F.lit(True).alias("whole"), F.lit("triples").alias("measure"), F.lit(0).cast("long").alias("n"))
    return counts.filter("measure is not null").unionByName(least).groupBy("whole", "measure").agg(F.sum("n").alias("n")).select("measure", "n")


# Pattern queries -----------------------------------------------------------


def _prop(t: DataFrame, p: str, s: str, o: str) -> DataFrame:
    name = p if ":" in p else f"core:{p}"
    return t.filter(F.col("p") == name).select(F.col("s").alias(s), F.col("o").alias(o))


def _of_class(t: DataFrame, cls: str, s: str) -> DataFrame:
    return t.filter((F.col("p") == "rdf:type") & (F.col("o") == f"core:{cls}")).select(F.col("s").alias(s))


def types_by_role(t: DataFrame, role: str) -> DataFrame:
    """DL01 / DL02: domain types whose functional role carries a label."""
    return (
        _of_class(t, "DomainType", "dt").join(_prop(t, "hasFunctionalRole", "dt", "r"), "dt")
        .join(_prop(t, "rdfs:label", "dt", "dt_label"), "dt")
        .join(_prop(t, "rdfs:label", "r", "func_label").filter(F.lower("func_label") == role), "r")
        .select("dt", "dt_label", "func_label").distinct()
    )


def _occurrences(t: DataFrame) -> DataFrame:
    return (
        _of_class(t, "DomainOccurrence", "occ").join(_prop(t, "occursInProtein", "occ", "prot"), "occ")
        .join(_prop(t, "hasDomainType", "occ", "dt"), "occ")
    )


def occurrences_by_context(t: DataFrame, context: str, role: str | None = None) -> DataFrame:
    """DL03 (context only) and DL04 (context and role on the same occurrence)."""
    labels = _prop(t, "rdfs:label", "x", "x_label")

    def terms(wanted: str, cls: str | None = None) -> DataFrame:
        """Few names, each on many occurrences. Written, so that their size is known and no occurrence is dealt by its term."""
        found = labels.filter(F.lower("x_label") == wanted).select("x")
        return materialise((found.join(_of_class(t, cls, "x"), "x", "left_semi") if cls else found).distinct(), "terms")

    ctx = _prop(t, "hasCharacterisation", "occ", "x").join(terms(context, None if role else "TopologyContext"), "x", "left_semi")
    used = materialise(_prop(t, "hasDomainType", "occ", "dt").select("dt").distinct(), "types")
    names = materialise(_prop(t, "rdfs:label", "dt", "dt_label").join(used, "dt", "left_semi"), "names")
    out = _occurrences(t).join(names, "dt").join(ctx, "occ", "left_semi")
    if role is not None:
        out = out.join(_prop(t, "hasFunctionalRole", "occ", "x").join(terms(role), "x", "left_semi"), "occ", "left_semi")
    return out.select("prot", "occ", "dt", "dt_label").distinct()


def cooccurring_pairs(t: DataFrame) -> DataFrame:
    """DL05."""
    return (
        _of_class(t, "DomainType", "dt_a").join(_prop(t, "cooccursWith", "dt_a", "dt_b"), "dt_a").filter("dt_a < dt_b")
        .join(_prop(t, "rdfs:label", "dt_a", "label_a"), "dt_a").join(_prop(t, "rdfs:label", "dt_b", "label_b"), "dt_b")
        .select("dt_a", "label_a", "dt_b", "label_b").distinct()
    )


def multi_type_proteins(t: DataFrame) -> DataFrame:
    """DL06."""
    distinct = _occurrences(t).select("prot", "dt").distinct()
    return distinct.groupBy("prot").agg(F.count(F.lit(1)).alias("n_domains")).filter("n_domains > 1")


def inconsistent_individuals(t: DataFrame) -> DataFrame:
    """DL07: members of the empty class, with all their types."""
    bad = t.filter("p = 'rdf:type' and o = 'owl:Nothing'").select(F.col("s").alias("ind")).distinct()
    return bad.join(_prop(t, "rdf:type", "ind", "type"), "ind").distinct()


def types_with_go(t: DataFrame) -> DataFrame:
    """DL08."""
    return (
        _of_class(t, "DomainType", "dt").join(_prop(t, "rdfs:label", "dt", "dt_label"), "dt")
        .join(_prop(t, "hasGOAnnotation", "dt", "go"), "dt").select("dt", "dt_label", "go").distinct()
    )


def neighbour_chains(t: DataFrame) -> DataFrame:
    """DL09: occurrences with optional first and optional different second neighbour."""
    n = _prop(t, "isDomainNeighbour", "occ", "prev_dt")
    n2 = _prop(t, "isDomainNeighbour", "o2", "next_dt")
    base = _of_class(t, "DomainOccurrence", "occ").join(_prop(t, "hasDomainType", "occ", "this_dt"), "occ").join(n, "occ", "left")
    return base.join(n2, (F.col("occ") == F.col("o2")) & (F.col("next_dt") != F.col("prev_dt")), "left").select(
        "occ", "prev_dt", "this_dt", "next_dt"
    ).distinct()


def binding_coverage(t: DataFrame) -> DataFrame:
    """DL10."""
    return (
        _of_class(t, "DomainOccurrence", "occ").join(_prop(t, "occursInProtein", "occ", "prot"), "occ")
        .join(_prop(t, "hasBindingTarget", "occ", "target"), "occ").select("occ", "prot", "target").distinct()
    )


PATTERNS = {
    "DL01": lambda t: types_by_role(t, "scaffold"),
    "DL02": lambda t: types_by_role(t, "receptor-binding"),
    "DL03": lambda t: occurrences_by_context(t, "transmembrane"),
    "DL04": lambda t: occurrences_by_context(t, "transmembrane", "scaffold"),
    "DL05": cooccurring_pairs,
    "DL06": multi_type_proteins,
    "DL07": inconsistent_individuals,
    "DL08": types_with_go,
    "DL09": neighbour_chains,
    "DL10": binding_coverage,
}


def pattern(triples: DataFrame, name: str) -> DataFrame:
    return PATTERNS[name](triples)


# Entailment ----------------------------------------------------------------


def closure(edges: DataFrame, max_iter: int = 20) -> DataFrame:
    """Transitive closure of (child, parent): path lengths double every round."""
    paths = edges.select("child", "parent").filter("child <> parent").distinct()
    size = paths.count()
    for _ in range(max_iter):
        longer = paths.join(paths.select(F.col("child").alias("parent"), F.col("parent").alias("top")), "parent")
        grown = paths.unionByName(longer.select("child", F.col("top").alias("parent"))).filter("child <> parent").distinct()
        paths = cut_lineage(grown)
        new_size = paths.count()
        if new_size == size:
            return paths
        size = new_size
    raise ValueError(f"closure did not settle within {max_iter} rounds")


CLASSES_PER_WORD = 62
TYPE = "rdf:type"


def _ancestors(edges: set[tuple[str, str]]) -> dict[str, set[str]]:
    """All that can be reached from each child of (child, parent)."""
    up = {}
    for child, parent in edges:
        up.setdefault(child, set()).add(parent)
    out = {}
    for child in up:
        seen, todo = set(), [child]
        while todo:
            new = up.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out[child] = seen
    return out


def _ways(flips: set[tuple[str, str]], subs: set[tuple[str, str]]) -> set[tuple[str, str, bool]]:
    """(p, q, swap): the property statements q that a statement p entails, with its ends swapped or not."""
    step = {(a, b, True) for a, b in flips} | {(a, b, False) for a, b in subs}
    ways = set(step)
    while True:
        longer = {(p, r, a != b) for p, q, a in ways for x, r, b in step if x == q}
        if longer <= ways:
            return {(p, q, swap) for p, q, swap in ways if p != q or swap}
        ways |= longer


def entailment_counts(rows: DataFrame, schema: DataFrame) -> DataFrame:
    """(measure, n): the report of ``entail`` from (s, statements) rows, without its statements.

    What a statement entails lies in its row: other properties of the same ends and classes of both. So a row
    sends one number of bits (its classes, those asserted) for its subject and for each object that gets a class,
    under two 64-bit digests, and its distinct statements are counted in the row. Statements go on one by one, as
    digests, only for subjects of several rows and for properties that can be entailed in several ways. A property that
    no statement has and one other entails with ends swapped has as many statements as that one. The
    schema is held by the driver.
    """
    axioms = [(r.s, r.p, r.o) for r in schema.select("s", "p", "o").distinct().collect()]
    pairs = lambda p: {(s, o) for s, x, o in axioms if x == p}
    supers = _ancestors({(a, b) for a, b in pairs("rdfs:subClassOf") if a != b})
    inverse = pairs("owl:inverseOf")
    flips = inverse | {(b, a) for a, b in inverse} | {(s, s) for s, o in pairs(TYPE) if o == "owl:SymmetricProperty"}
    ways = _ways(flips, {(a, b) for a, b in pairs("rdfs:subPropertyOf") if a != b})
    if TYPE in {x for p, q, _ in ways for x in (p, q)}:
        raise ValueError("properties that entail types need entail()")
    domains, ranges = pairs("rdfs:domain"), {(p, c) for p, c in pairs("rdfs:range") if not c.startswith("xsd:")}
    known = {c for e in pairs("rdfs:subClassOf") for c in e} | {c for _, c in domains | ranges} | {"owl:Nothing"}
    place = {c: i for i, c in enumerate(sorted(known))}
    words = range(len(place) // CLASSES_PER_WORD + 1)

    def bits(classes, word: int, lift: bool = True) -> int:
        every = {x for c in classes for x in ({c} | supers.get(c, set()) if lift else {c})}
        return sum(1 << place[c] % CLASSES_PER_WORD for c in every if place[c] // CLASSES_PER_WORD == word)

    def looked_up(of: dict[str, int], key: Column) -> Column:
        cells = [F.lit(x) for k, v in sorted(of.items()) if v for x in (k, v)]
        zero = F.lit(0).cast("long")
        return F.coalesce(F.create_map(*cells)[key].cast("long"), zero) if cells else zero

    properties = {p for p, _ in domains | ranges} | {x for p, q, _ in ways for x in (p, q)}
    own = lambda table, p: [c for x, c in table if x == p]
    entailed = lambda p, straight, turned: [c for x, q, swap in ways if x == p for c in own(turned if swap else straight, q)]
    of_any = [{p: bits(own(domains, p), w) for p in properties} for w in words]
    of_iri = [{p: bits(own(domains, p) + entailed(p, domains, ranges), w) for p in properties} for w in words]
    of_object = [{p: bits(own(ranges, p) + entailed(p, ranges, domains), w) for p in properties} for w in words]
    lifted, alone = ([{c: bits([c], w, lift) for c in place} for w in words] for lift in (True, False))
    is_iri, is_type = lambda x: x["o_type"] == "iri", lambda x: x["p"] == TYPE
    subject = lambda x, w: F.when(is_type(x), looked_up(lifted[w], x["o"])).when(is_iri(x), looked_up(of_iri[w], x["p"])).otherwise(looked_up(of_any[w], x["p"]))
    asserted = lambda x, w: F.when(is_type(x), looked_up(alone[w], x["o"])).otherwise(F.lit(0).cast("long"))
    target = lambda x, w: F.when(is_iri(x), looked_up(of_object[w], x["p"])).otherwise(F.lit(0).cast("long"))

    sources = {q: {(p, swap) for p, x, swap in ways if x == q} for _, q, _ in ways}
    local = {q for q, by in sources.items() if not any(swap for _, swap in by)}  # entailed by statements of the same subject
    turned = sorted(q for q, by in sources.items() if len(by) == 1 and q not in local and (q, True) not in by)  # by one other property
    entail_by = {q: next(iter(sources[q]))[0] for q in turned}
    told = set(sources) - local - set(turned)

    def listed(x: Column) -> Column:
        """As text, as sets of text are hashed; lengths keep the parts apart."""
        return F.concat(F.length(x["p"]).cast("string"), F.lit(":"), F.length(x["o"]).cast("string"), F.lit(":"), x["p"], x["o"], x["o_type"])

    distinct_of = lambda found: F.size(F.array_distinct(F.transform(found, lambda x: x["o"]))).cast("long")
    of = lambda *ps: F.filter("__hot", lambda x: x["p"].isin(*ps))
    iris_of = lambda *ps: F.filter("__hot", lambda x: x["p"].isin(*ps) & is_iri(x))
    ends = lambda found: F.transform(found, lambda x: x["o"])
    hot = F.filter("statements", lambda x: x["p"].isin(TYPE, *properties))
    marked = rows.withColumn("__d", F.xxhash64("s")).withColumn("__hot", hot)
    shared = materialise(rows.select(F.xxhash64("s").alias("__d")).groupBy("__d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__d", F.lit(True).alias("__shared")), "shared")

    fields = [*[f"t{w}" for w in words], *[f"a{w}" for w in words], "n", "m", *[f"c{i}" for i in range(len(turned))], *[f"p{i}" for i in range(len(turned))]]
    flags = ["known", "made", "once", *[f"one{i}" for i in range(len(turned))], *[f"had{i}" for i in range(len(turned))]]

    def record(kind: int, parts: Sequence[Column], **values: Column) -> Column:
        long = lambda c: values.get(c, F.lit(0)).cast("long").alias(c)
        flag = lambda c: values.get(c, F.lit(False)).alias(c)
        return F.struct(F.xxhash64(F.lit(kind), *parts).alias("d1"), F.xxhash64(*reversed(parts), F.lit(kind)).alias("d2"), *map(long, fields), *map(flag, flags))

    zero = F.lit(0).cast("long")
    gathered = lambda f, w: F.aggregate("__hot", zero, lambda acc, x: acc.bitwiseOR(f(x, w)))
    classes = {f"{name}{w}": gathered(f, w) for w in words for name, f in (("t", subject), ("a", asserted))}
    new = sum((F.size(F.array_except(ends(iris_of(*[p for p, _ in sources[q]])), ends(of(q)))).cast("long") for q in sorted(local)), zero)
    turns = {f"c{i}": distinct_of(iris_of(entail_by[q])) for i, q in enumerate(turned)}
    asserts = {f"p{i}": F.size(of(q)).cast("long") for i, q in enumerate(turned)}
    node = F.array(record(0, [F.col("s")], n=F.size(F.array_distinct(F.transform("statements", listed))).cast("long"), m=new, **classes, **turns, **asserts))
    node_of_many = F.array(record(0, [F.col("s")], **classes))
    objects = F.transform(
        F.filter("__hot", lambda x: F.greatest(*[target(x, w) for w in words], F.lit(0), F.lit(0)) > 0),
        lambda x: record(0, [x["o"]], **{f"t{w}": target(x, w) for w in words}),
    )

    def sent(found: Column, kind: int, name: str, swap: bool = False, **flag: Column) -> Column:
        place_of = lambda x: [x["o"], F.lit(name), F.col("s")] if swap else [F.col("s"), F.lit(name), x["o"]]
        return F.transform(found, lambda x: record(kind, place_of(x), **flag))

    def one_by_one(qs: set[str]) -> list[Column]:
        """The statements of some properties, asserted or entailed, by their digests."""
        parts = []
        for q in sorted(qs):
            parts.append(sent(of(q), 1, q, known=F.lit(True)))
            parts += [sent(iris_of(p), 1, q, swap, made=F.lit(True)) for p, swap in sorted(sources[q])]
        return parts

    statements = F.transform("statements", lambda x: record(2, [F.col("s"), x["p"], x["o"], x["o_type"]], once=F.lit(True)))
    turned_once = [sent(iris_of(entail_by[q]), 3, str(i), **{f"one{i}": F.lit(True)}) for i, q in enumerate(turned)]
    had = [sent(of(q), 4, str(i), **{f"had{i}": F.lit(True)}) for i, q in enumerate(turned)]
    everywhere = F.flatten(F.array(objects, *one_by_one(told)))
    of_many = F.flatten(F.array(node_of_many, statements, *turned_once, *had, *one_by_one(local)))
    # explode_outer: a plain explode would count the row once more to skip empty ones
    each = marked.join(shared, "__d", "left").select(F.explode_outer(F.concat(F.when(F.col("__shared"), of_many).otherwise(node), everywhere)).alias("x")).select("x.*")
    held = each.groupBy("d1", "d2").agg(
        *[(F.bit_or(c) if c[0] in "ta" and c[1:].isdigit() else F.sum(c)).alias(c) for c in fields], *[F.max(c).alias(c) for c in flags],
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    many = lambda cond: F.count_if(cond)
    nothing, at = place["owl:Nothing"], place["owl:Nothing"] // CLASSES_PER_WORD
    found = held.agg(
        (total("n") + many(F.col("once"))).alias("asserted"), total("m").alias("local"), many(F.col("made") & ~F.col("known")).alias("told"),
        sum((total(F.bit_count(F.col(f"t{w}").bitwiseAND(F.bitwise_not(f"a{w}")))) for w in words), zero).alias("types"),
        many(F.col(f"t{at}").bitwiseAND(F.lit(1 << nothing % CLASSES_PER_WORD).cast("long")) != 0).alias("inconsistent"),
        *[(total(f"c{i}") + many(F.col(f"one{i}"))).alias(f"turned{i}") for i in range(len(turned))],
        *[(total(f"p{i}") + many(F.col(f"had{i}"))).alias(f"asserted{i}") for i in range(len(turned))],
    ).first()
    inferred = found.local + found.told + found.types
    both = {q for i, q in enumerate(turned) if found[f"asserted{i}"] and found[f"turned{i}"]}
    inferred += sum(found[f"turned{i}"] for i, q in enumerate(turned) if q not in both)
    if both:  # asserted and entailed: its statements are told apart after all
        again = marked.select(F.explode(F.flatten(F.array(*one_by_one(both)))).alias("x")).select("x.d1", "x.d2", "x.known", "x.made")
        again = again.groupBy("d1", "d2").agg(F.max("known").alias("known"), F.max("made").alias("made"))
        inferred += again.filter("made and not known").count()
    out = [("asserted", found.asserted), ("total", found.asserted + inferred), ("inferred", inferred), ("inconsistent", found.inconsistent)]
    return rows.sparkSession.createDataFrame(out, "measure string, n long")


def entail(triples: DataFrame, schema: DataFrame, max_iter: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all, inferred, report) under subclass, subproperty, inverse, symmetric, domain and range axioms.

    The schema closures are computed once. The data then need no fixed point of
    their own: properties are expanded (inverse, symmetric, super) until no new
    property statement appears, then types are derived and lifted to all
    superclasses in one join.
    """
    supers = closure(_prop(schema, "rdfs:subClassOf", "child", "parent"), max_iter)
    sub_props = closure(_prop(schema, "rdfs:subPropertyOf", "child", "parent"), max_iter)
    inv = _prop(schema, "owl:inverseOf", "a", "b")
    flips = inv.unionByName(inv.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(
        schema.filter("p = 'rdf:type' and o = 'owl:SymmetricProperty'").select(F.col("s").alias("a"), F.col("s").alias("b"))
    ).distinct()
    # Every way a property statement can turn into another one, closed over the schema:
    # (property, property it entails, with subject and object swapped or not).
    step = flips.select(F.col("a").alias("p"), F.col("b").alias("q"), F.lit(True).alias("swap")).unionByName(
        sub_props.select(F.col("child").alias("p"), F.col("parent").alias("q"), F.lit(False).alias("swap"))
    ).distinct()
    reach = step
    size = reach.count()
    for _ in range(max_iter):
        nxt = reach.join(step.select(F.col("p").alias("q"), F.col("q").alias("r"), F.col("swap").alias("s2")), "q").select(
            "p", F.col("r").alias("q"), (F.col("swap") != F.col("s2")).alias("swap")
        )
        reach = cut_lineage(reach.unionByName(nxt).distinct())
        new_size = reach.count()
        if new_size == size:
            break
        size = new_size
    else:
        raise ValueError(f"properties did not settle within {max_iter} rounds")
    reach = materialise(reach, "reach")
    base = materialise(triples.select(*TRIPLE).distinct(), "asserted")
    derived = base.filter("o_type = 'iri'").join(reach, "p").select(
        F.when(F.col("swap"), F.col("o")).otherwise(F.col("s")).alias("s"), F.col("q").alias("p"),
        F.when(F.col("swap"), F.col("s")).otherwise(F.col("o")).alias("o"), "o_type",
    )
    # Only statements of the entailed properties can repeat an asserted one.
    entailed = materialise(reach.select(F.col("q").alias("p")).distinct(), "entailed")
    known = base.join(entailed, "p", "left_semi").select("s", "p", "o")
    new_props = materialise(derived.distinct().join(known, ["s", "p", "o"], "left_anti").select(*TRIPLE), "properties")
    props = base.unionByName(new_props)
    domains = materialise(_prop(schema, "rdfs:domain", "p", "cls"), "domains")
    ranges = materialise(_prop(schema, "rdfs:range", "p", "cls").filter("cls not like 'xsd:%'"), "ranges")
    direct = union_all([
        props.filter("p = 'rdf:type'").select("s", F.col("o").alias("cls")),
        props.join(domains, "p").select("s", "cls"),
        props.filter("o_type = 'iri'").join(ranges, "p").select(F.col("o").alias("s"), "cls"),
    ]).distinct()
    ups = supers.select(F.col("child").alias("cls"), F.col("parent")).unionByName(
        supers.select("child", "parent").unionByName(supers.select("parent", "parent").toDF("child", "parent"))
        .select(F.col("child").alias("cls"), F.col("child").alias("parent"))
    ).distinct()
    ups = materialise(ups, "superclasses")
    lifted = direct.join(ups, "cls", "left").select("s", F.coalesce("parent", "cls").alias("o")).distinct()
    asserted_types = base.filter("p = 'rdf:type'").select("s", "o")
    new_types = materialise(
        lifted.join(asserted_types, ["s", "o"], "left_anti")
        .select("s", F.lit("rdf:type").alias("p"), "o", F.lit("iri").alias("o_type")), "types",
    )
    inferred = new_props.unionByName(new_types)
    everything = base.unionByName(inferred)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")
    report = union_all([
        n(base, "asserted"), n(everything, "total"), n(inferred, "inferred"),
        n(everything.filter("p = 'rdf:type' and o = 'owl:Nothing'"), "inconsistent"),
    ])
    return everything, inferred, report
