"""Controlled vocabulary: injection of identifiers, carry-over, membership, missing terms.

Lookups are plain equi joins: a small vocabulary is broadcast by Spark after it
has checked the size, a large one is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospan.functions.cells import blank_to_null, missing, split_cell, token_forms
from annospan.functions.text_similarity import char_tokens, gestalt_ratio
from annospan.operators.blocks import prefix_candidates



def has_identifier(token: Column) -> Column:
    """The text before a colon within the first seven characters is upper case."""
    head = F.substring_index(F.substring(token, 1, 7), ":", 1)
    return (F.length(token) >= 4) & F.substring(token, 1, 7).contains(":") & head.rlike("[A-Z]") & (F.upper(head) == head)


def vocab_index(vocab: DataFrame) -> DataFrame:
    """(term_type, form, id, id_label): every spelling of every term, one row each."""
    label = F.concat_ws(" ", F.trim("ID"), F.trim("Name"))
    extra = [c for c in ("canonical_name", "synonym") if c in vocab.columns]
    forms = F.array_union(
        F.array(F.trim("ID"), F.trim("Name"), label),
        F.flatten(F.array(*[split_cell(c) for c in extra])) if extra else F.array().cast("array<string>"),
    )
    both = F.array_distinct(F.concat(forms, F.transform(forms, lambda f: F.lower(f))))
    rows = vocab.select("term_type", F.trim("ID").alias("id"), label.alias("id_label"), F.explode(both).alias("form"))
    return rows.filter("form is not null and form <> ''").groupBy("term_type", "form").agg(
        F.min(F.struct("id", "id_label")).alias("v")
    ).select("term_type", "form", "v.id", "v.id_label")


def inject_ids(
    df: DataFrame, vocab: DataFrame, col_types: dict[str, str], row_id: str, delimiter: str = ";"
) -> tuple[DataFrame, DataFrame]:
    """Replace known tokens by ``ID label``; returns (table, distinct unmapped tokens).

    Tokens that already carry an identifier and unknown tokens pass through, so
    a second run changes nothing. Distinct (column, token) pairs are looked up
    once each; the answers are joined back by token.
    """
    index = vocab_index(vocab).filter(F.col("form") == F.lower("form")).select("term_type", "form", "id_label")
    cells = F.array(*[
        F.struct(F.lit(c).alias("c"), F.lit(t).alias("t"), split_cell(c, delimiter).alias("toks"))
        for c, t in col_types.items()
    ])
    tokens = (
        df.select(row_id, F.explode(cells).alias("x"))
        .select(row_id, F.col("x.c").alias("column_name"), F.col("x.t").alias("term_type"), F.posexplode("x.toks").alias("pos", "token"))
    )
    distinct = tokens.select("column_name", "term_type", "token").distinct().withColumn("form", F.lower("token"))
    looked = distinct.join(index, ["term_type", "form"], "left").withColumn("__has", has_identifier(F.col("token")))
    answers = looked.select(
        "column_name", "token",
        F.when(F.col("__has"), F.col("token")).otherwise(F.coalesce("id_label", "token")).alias("mapped"),
    )
    unmapped = looked.filter(~F.col("__has") & F.col("id_label").isNull()).select("column_name", "token")
    rebuilt = (
        tokens.join(answers, ["column_name", "token"])
        .groupBy(row_id)
        .agg(*[
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.when(F.col("column_name") == c, F.struct("pos", "mapped")))),
                    lambda x: x["mapped"],
                ), delimiter,
            ).alias(f"__{c}")
            for c in col_types
        ])
    )
    out = df.join(rebuilt, row_id, "left")
    for c in col_types:
        out = out.withColumn(c, F.when(missing(c), F.col(c)).otherwise(F.col(f"__{c}")))
    return out.select(*df.columns), unmapped


def carry_over(
    target: DataFrame, source: DataFrame, key: Sequence[str], cols: Sequence[str], position: str
) -> tuple[DataFrame, DataFrame]:
    """Fill blank target cells from the last source row of the same key; counts per column."""
    last = source.groupBy(*key).agg(*[F.max_by(blank_to_null(c), F.col(position)).alias(f"__{c}") for c in cols])
    joined = target.join(last, list(key), "left")
    filled = {c: missing(c) & F.col(f"__{c}").isNotNull() for c in cols}
    counts = joined.agg(*[F.coalesce(F.sum(filled[c].cast("long")), F.lit(0)).alias(c) for c in cols])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_filled")) for c in cols]))
    out = joined.withColumns({c: F.coalesce(blank_to_null(c), F.col(f"__{c}")) for c in cols}).select(*target.columns)
    return out, counts.select(pairs.alias("p")).select("p.*")


def known_tokens(tokens: DataFrame, index: DataFrame, token: str = "token", term_type: str = "term_type") -> DataFrame:
    """Distinct (term_type, token) with a flag: does any spelling occur in the vocabulary?"""
    distinct = tokens.select(term_type, token).distinct()
    forms = distinct.withColumn("form", F.explode(token_forms(token)))
    hits = forms.join(index.select("term_type", "form"), ["term_type", "form"], "left_semi").select(term_type, token).distinct()
    return distinct.join(hits.withColumn("known", F.lit(True)), [term_type, token], "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )


def missing_terms(
    tokens: DataFrame, index: DataFrame, token: str = "token", term_type: str = "term_type", min_ratio: float = 0.6
) -> DataFrame:
    """Tokens unknown to their vocabulary: count, known elsewhere?, closest known term."""
    counts = tokens.groupBy(term_type, token).agg(F.count(F.lit(1)).alias("n"))
    unknown = known_tokens(tokens, index, token, term_type).filter(~F.col("known")).drop("known")
    anywhere = (
        unknown.select(token).distinct().withColumn("form", F.explode(token_forms(token)))
        .join(index.select("form").distinct(), "form", "left_semi").select(token).distinct()
        .withColumn("known_elsewhere", F.lit(True))
    )
    closest = closest_terms(unknown.select(token).distinct(), index, token, min_ratio)
    return (
        counts.join(unknown, [term_type, token], "left_semi")
        .join(anywhere, token, "left").join(closest, token, "left")
        .select(term_type, token, "n", F.coalesce("known_elsewhere", F.lit(False)).alias("known_elsewhere"), "closest", "ratio")
    )


def closest_terms(words: DataFrame, index: DataFrame, word: str, min_ratio: float) -> DataFrame:
    """Best known term per word by gestalt ratio, where the ratio reaches ``min_ratio``.

    The ratio cannot exceed twice the shared characters over the summed
    lengths. A pair that can reach the cut therefore shares one of its rarest
    characters, which turns the search into an equi join on (character number);
    the exact ratio is computed for the survivors only.
    """
    terms = index.select(F.lower("form").alias("term")).distinct()
    left = words.select(F.col(word), F.lower(F.col(word)).alias("__w")).withColumn("__wt", char_tokens(F.col("__w")))
    right = terms.withColumn("__tt", char_tokens(F.col("term")))
    candidates = prefix_candidates(
        left.select("__w", "__wt").distinct(), "__w", "__wt", right, "term", "__tt", min_ratio
    )
    shared = F.size(F.array_intersect(char_tokens(F.col("__w")), char_tokens(F.col("term"))))
    bound = 2.0 * shared / (F.length("__w") + F.length("term"))
    scored = candidates.filter(bound >= min_ratio - 1e-12).withColumn("ratio", gestalt_ratio("__w", "term")).filter(
        F.col("ratio") >= min_ratio
    )
    best = scored.groupBy("__w").agg(
        F.min_by("term", F.struct(-F.col("ratio"), F.col("term"))).alias("closest"), F.max("ratio").alias("ratio")
    )
    return left.select(word, "__w").join(best, "__w").select(word, "closest", F.round("ratio", 4).alias("ratio"))
