"""Registered queries of the corpus operators, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospan.llm import language, lattice, lexical, mixing, nearest, neartext, packing, passages, quality, sharding, toxicity, webpage, whitening
from annospan.llm.tables import crc_rest, table


def op1_language_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the byte network."""
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document; ``held_out`` rows are not learned from."""
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", (crc_rest("doc_id", 5) == 0).alias("held_out"), "severity", "grade", "p_toxic",
        F.col("rejected").cast("int").alias("toxic"),
    )


def op4_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all others."""
    return nearest.nearest_vectors(table(spark, sf_dir, "embeddings"), query_step=20, nearest=20)


def packed(docs: DataFrame) -> DataFrame:
    """Documents packed into sequences of at most 2048 tokens, with a digest of each piece's ids."""
    import public_tokenizers

    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    placed = packing.pack_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.withColumn("length", F.col("length").cast("long"))


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed."""
    return packed(table(spark, sf_dir, "documents"))


def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from four fifths of the labels."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-copy class of every document at a five-word Jaccard of 0.8."""
    return neartext.ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


def op8_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return webpage.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.98 within a label."""
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight contiguous shards of near equal bytes."""
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 20-word windows that also start earlier."""
    cut = passages.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of all embeddings."""
    white = whitening.whiten_vectors(table(spark, sf_dir, "embeddings"))
    rows = white.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"))
    return rows.select(
        "vec_id", (F.col("k") + 1).alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error",
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_language_bytes": op1_language_bytes,
    "op2_mix_sources": op2_mix_sources,
    "op3_toxicity_ordinal": op3_toxicity_ordinal,
    "op4_adaptive_scan": op4_adaptive_scan,
    "op5_pack_documents": op5_pack_documents,
    "op6_quality_trees": op6_quality_trees,
    "op7_ngram_join": op7_ngram_join,
    "op8_line_blocks": op8_line_blocks,
    "op9_lattice_dedup": op9_lattice_dedup,
    "op10_shard_bytes": op10_shard_bytes,
    "op11_remove_repeats": op11_remove_repeats,
    "op12_whitening": op12_whitening,
    "op13_ranked_search": op13_ranked_search,
}

# Every link by brute force; the joins find links by hashing, so equal rows show that none was lost.
SQL: dict[str, str] = {
    "op7_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
g AS (SELECT r, doc_id, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
    ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT r, len(s) AS n, unnest(s) AS x FROM g),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM i WHERE k / (na + nb - k) >= 0.8),
m AS (SELECT r, r AS o FROM g UNION SELECT m.r, l.b FROM m JOIN l ON l.a = m.o),
c AS (SELECT m.r, min(g.doc_id) AS class_id FROM m JOIN g ON g.r = m.o GROUP BY m.r),
n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, doc_id = class_id AS kept
FROM g JOIN c USING (r) LEFT JOIN n USING (r)""",
    "op9_lattice_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
m AS (SELECT vec_id, vec_id AS o FROM v UNION SELECT m.vec_id, l.b FROM m JOIN l ON l.a = m.o),
c AS (SELECT vec_id, min(o) AS component_id FROM m GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op11_remove_repeats": r"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
x AS (SELECT r, doc_id, s.p, s.k FROM (SELECT r, doc_id, unnest(list_transform(range(0, len(t) - 19), lambda i: {'p': i, 'k': array_to_string(t[i + 1:i + 20], ' ')})) AS s FROM w)),
f AS (SELECT k, min({'d': doc_id, 'p': p}) AS m FROM x GROUP BY k),
g AS (SELECT DISTINCT r, unnest(range(p, p + 20)) AS j FROM x JOIN f USING (k) WHERE {'d': doc_id, 'p': p} > m),
e AS (SELECT r, unnest(t) AS word, unnest(range(0, len(t))) AS j FROM w),
k AS (SELECT e.r, count(g.r) AS n, string_agg(word, ' ' ORDER BY e.j) FILTER (WHERE g.r IS NULL) AS kept FROM e LEFT JOIN g ON g.r = e.r AND g.j = e.j GROUP BY e.r)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)""",
    "op13_ranked_search": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
n AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, n GROUP BY term, docs),
m AS (SELECT r, doc_id, 50 + (50 * len(t)::BIGINT * docs) // total AS m FROM d, n WHERE len(t) > 0),
s AS (SELECT i, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50""",
}
