"""Queries of the engine's operators over the driver's tables, and the same rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.functions import dates as D
from siftlark.functions import hashing
from siftlark.functions import text as T
from siftlark.functions import vectors as V
from siftlark.operators import evaluation, fhir, fulltext, history, matching, metrics, parser, redaction, retrieval, review, rules, vector_index
from siftlark.operators import versions as versioning
from siftlark.plans import adapters as A
from siftlark.sources.shared import shared_path, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
METRIC_LIST = ", ".join(metrics.METRICS)


def query(oracle: str | None = None):
    """Register a query under its function's name, with its DuckDB counterpart."""

    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


# --- retrieval -----------------------------------------------------------------------------------

DOCS_SQL = """docs AS (SELECT p_partkey AS doc_id, lower(p_name) AS title, lower(p_type) AS conditions, lower(p_brand) AS interventions,
    'age at least ' || p_size || ' years' AS eligibility FROM part)"""
TERMS_SQL = A.TERMS_SQL
SCORED_SQL = f"""{DOCS_SQL}, {TERMS_SQL},
hits AS (SELECT query_id, doc_id, pos, fact_id, CASE WHEN contains(conditions, term) THEN 4 WHEN contains(title, term) THEN 3
         WHEN contains(interventions, term) THEN 2 WHEN contains(eligibility, term) THEN 1 END AS w FROM docs, terms),
scored AS (SELECT query_id, doc_id, CAST(sum(w) AS DOUBLE) AS score, count(*) AS matched_terms, count(*) FILTER (w = 4) AS conditions_matches, count(*) FILTER (w = 3) AS title_matches,
           count(*) FILTER (w = 2) AS interventions_matches, count(*) FILTER (w = 1) AS eligibility_matches, string_agg(fact_id, ',' ORDER BY pos) AS fact_ids
           FROM hits WHERE w IS NOT NULL GROUP BY ALL),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 400)"""


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.best_by_fields(retrieval.trial_fields(A.documents(spark, sf_dir)), A.terms(spark, sf_dir), retrieval.LIMITS["lexical"])


@query(f"WITH {SCORED_SQL} SELECT * FROM lexical")
def q3_field_scoring(spark, sf_dir):
    return lexical(spark, sf_dir).withColumn("fact_ids", F.array_join("fact_ids", ","))


VECTORS_SQL = """vecs AS (SELECT vec_id AS doc_id, embedding, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
asked AS (SELECT 'q' || (doc_id + 1) AS query_id, v AS qv FROM vecs WHERE doc_id % 50 = 0),
sims AS (SELECT query_id, doc_id, round(list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))), 12) AS score FROM vecs, asked),
semantic AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sims QUALIFY rank <= 400)"""


def vector_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 50."""
    now = F.lit("2024-01-01").cast("timestamp")
    vectors = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", now.alias("ingested_at"), F.lit(None).cast("timestamp").alias("superseded_at"))
    asked = vectors.where("doc_id % 50 = 0").select(F.concat(F.lit("q"), (F.col("doc_id") + 1).cast("string")).alias("query_id"), F.col("embedding").alias("vector"), now.alias("as_of"))
    return vectors, asked


def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors."""
    return matching.semantic_candidates(*vector_tables(spark, sf_dir))


@query(f"WITH {VECTORS_SQL} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM semantic")
def q4_cosine_topk(spark, sf_dir):
    return semantic(spark, sf_dir).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {VECTORS_SQL} SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_exact, true AS enough FROM semantic")
def q4_ann_recall(spark, sf_dir):
    """Recall of the vector index over all queries of the exact search: 0.9 or more of all their neighbours."""
    stored_vectors, asked = vector_tables(spark, sf_dir)
    found = vector_index.VectorIndex.build(stored_vectors).search(asked)
    told = vector_index.recall(found, matching.semantic_candidates(stored_vectors, asked))
    return told.agg(F.count("*").alias("n_queries"), F.sum("n_exact").alias("n_exact"), (F.sum("n_found") >= 0.9 * F.sum("n_exact")).alias("enough"))


RANKS_SQL = """ranks AS (SELECT query_id, doc_id, l.rank AS lexical_rank, s.rank AS semantic_rank FROM lexical l FULL JOIN semantic s USING (query_id, doc_id))"""


def fused_sql(w_lexical: str, w_semantic: str) -> str:
    return f"""fused AS (SELECT query_id, doc_id, lexical_rank, semantic_rank,
        coalesce({w_lexical} / (60 + lexical_rank), 0) + coalesce({w_semantic} / (60 + semantic_rank), 0) AS score FROM ranks),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused QUALIFY rank <= 250)"""


def fused(spark, sf_dir, weights=(1.0, 1.0)):
    return retrieval.fuse_rrf(lexical(spark, sf_dir), semantic(spark, sf_dir), weights=weights)


@query(f"WITH {SCORED_SQL}, {VECTORS_SQL}, {RANKS_SQL}, {fused_sql('1.0::DOUBLE', '1.0::DOUBLE')} SELECT query_id, doc_id, lexical_rank, semantic_rank, rank, round(score, 9) AS score FROM top")
def q5_rrf(spark, sf_dir):
    return fused(spark, sf_dir).withColumn("score", F.round("score", 9))


@query(f"WITH {SCORED_SQL}, {VECTORS_SQL}, {RANKS_SQL}, {fused_sql('0.75::DOUBLE', '0.25::DOUBLE')} SELECT query_id, doc_id, lexical_rank, semantic_rank, rank, round(score, 9) AS score FROM top")
def q5_weighted_rrf(spark, sf_dir):
    return fused(spark, sf_dir, (0.75, 0.25)).withColumn("score", F.round("score", 9))


RERANK_SQL = """near AS (SELECT top.query_id, top.doc_id, top.rank AS input_rank, term, kind, ' ' || array_to_string(regexp_extract_all(conditions, '[\\p{L}\\p{N}_]+'), ' ') || ' ' AS c,
    ' ' || array_to_string(regexp_extract_all(interventions, '[\\p{L}\\p{N}_]+'), ' ') || ' ' AS i, ' ' || array_to_string(regexp_extract_all(title, '[\\p{L}\\p{N}_]+'), ' ') || ' ' AS t,
    ' ' || array_to_string(regexp_extract_all(term, '[\\p{L}\\p{N}_]+'), ' ') || ' ' AS w FROM top JOIN docs USING (doc_id) LEFT JOIN terms USING (query_id)),
tiers AS (SELECT query_id, doc_id, input_rank, max(CASE WHEN kind = 'condition' AND contains(c, w) THEN 3 WHEN kind <> 'condition' AND contains(i, w) THEN 2 WHEN contains(t, w) THEN 1 ELSE 0 END) AS tier
          FROM near GROUP BY ALL),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, input_rank, doc_id) AS rank, CASE WHEN tier > 0 THEN 'direct_support' ELSE 'unknown' END AS structured_status FROM tiers
             QUALIFY rank <= 100)"""


@query(f"WITH {SCORED_SQL}, {VECTORS_SQL}, {RANKS_SQL}, {fused_sql('1.0::DOUBLE', '1.0::DOUBLE')}, {RERANK_SQL} SELECT query_id, doc_id, input_rank, tier, rank, structured_status FROM reranked")
def q6_rerank(spark, sf_dir):
    return retrieval.rerank_structured(fused(spark, sf_dir), A.documents(spark, sf_dir), A.terms(spark, sf_dir))


@query(
    f"WITH {SCORED_SQL}, {VECTORS_SQL}, {RANKS_SQL}, {fused_sql('1.0::DOUBLE', '1.0::DOUBLE')}, {RERANK_SQL},"
    " parts AS (SELECT query_id, count(*) FILTER (lexical_rank IS NOT NULL) AS n_lexical, count(*) FILTER (semantic_rank IS NOT NULL) AS n_semantic FROM ranks GROUP BY ALL)"
    " SELECT query_id, doc_id, r.rank, tier, input_rank, CASE WHEN n_semantic = 0 THEN 'lexical_only_no_semantic_candidates' ELSE 'hybrid' END AS mode, n_lexical, n_semantic FROM reranked r JOIN parts USING (query_id)"
)
def q9_hybrid_pipeline(spark, sf_dir):
    """The whole match run: lexical and semantic pools, fusion, rerank, mode and stage counts."""
    # Fusion and counts both read the pools, which are written once.
    lex, sem = stored(lexical(spark, sf_dir), "lexical"), stored(semantic(spark, sf_dir), "semantic")
    final = retrieval.rerank_structured(retrieval.fuse_rrf(lex, sem), A.documents(spark, sf_dir), A.terms(spark, sf_dir))
    counts = lex.select("query_id", F.lit(1).alias("l"), F.lit(0).alias("s")).unionByName(sem.select("query_id", F.lit(0).alias("l"), F.lit(1).alias("s"))).groupBy("query_id").agg(F.sum("l").alias("n_lexical"), F.sum("s").alias("n_semantic"))
    mode = retrieval.retrieval_mode(F.lit(True), F.col("n_semantic"), F.lit(True), F.lit(True))
    return final.join(counts, "query_id").select("query_id", "doc_id", "rank", "tier", "input_rank", mode.alias("mode"), "n_lexical", "n_semantic")


#: Words of documents and of benchmark items; ``w[k]`` is an item's k-th word.
WORDS_SQL = r"""tokens AS (SELECT doc_id, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\p{L}\p{N}_]+') AS t FROM documents),
asked AS (SELECT 't' || item_id AS query_id, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\p{L}\p{N}_]+') AS w FROM benchmark)"""


def item_words(spark, sf_dir):
    """query_id and words of every benchmark item."""
    words = T.words(T.normalize(F.coalesce("text", F.lit(""))))
    return A.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("query_id"), words.alias("w"))


@query(f"WITH {WORDS_SQL} SELECT query_id, doc_id FROM asked, tokens WHERE len(w) > 0 AND list_has_all(t, w[1:3])")
def f2_and_match(spark, sf_dir):
    """The first three words of every benchmark item, in all documents."""
    asked = item_words(spark, sf_dir).select("query_id", F.array_join(F.slice("w", 1, 3), " ").alias("text"))
    return retrieval.and_match(A.table(spark, sf_dir, "documents").select("doc_id", "text"), asked)


@query(rf"""WITH {WORDS_SQL}, padded AS (SELECT doc_id, ' ' || array_to_string(t, ' ') || ' ' AS d FROM tokens)
SELECT query_id, doc_id FROM asked, padded WHERE (contains(d, ' ' || w[1] || ' ' || w[2] || ' ') AND contains(d, ' ' || w[4] || ' '))
    OR (contains(d, ' ' || w[6] || ' ') AND contains(d, ' ' || w[7] || ' ') AND NOT contains(d, ' ' || w[3] || ' '))""")
def f2_websearch(spark, sf_dir):
    """A phrase and a word, or two words without a third, from every benchmark item; found through an index of all documents."""
    w = lambda k: F.get("w", F.lit(k - 1))
    asked = item_words(spark, sf_dir).select("query_id", F.format_string('"%s %s" "%s" or "%s" "%s" -"%s"', w(1), w(2), w(4), w(6), w(7), w(3)).alias("text"))
    index = fulltext.new_index(spark, A.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return index.search(asked).select("query_id", "doc_id")


@query("""SELECT doc_id, lang, source FROM documents WHERE lower(lang) IN ('en', 'de') AND lower(source) IN ('src1', 'src2', 'src3')""")
def f4_metadata_filter(spark, sf_dir):
    passed = retrieval.metadata_filter(F.col("lang"), F.array("source"), F.array("lang"), {"statuses": ["EN", "de"], "phases": ["SRC1", "src2", "Src3"]})
    return A.table(spark, sf_dir, "documents").where(passed).select("doc_id", "lang", "source")


@query(r"""SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\p{Z}]+', ' ', 'g'))) AS normalized FROM documents""")
def t1_normalize(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normalized"))


@query(r"""SELECT doc_id, contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ', ' of the ') AS has_run FROM documents""")
def t5_word_sequence(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.has_word_sequence(F.col("text"), F.lit("Of  the")).alias("has_run"))


STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}')), lambda x: x NOT IN ({STOPS}))) AS n_tokens FROM documents""")
def t6_token_set(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.size(T.token_set(F.col("text"))).cast("long").alias("n_tokens"))


OVERLAP_SQL = f"""toks AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9-]{{2,}}'))) AS token FROM documents),
topics AS (SELECT 't' || item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}'))) AS token FROM benchmark),
overlap AS (SELECT query_id, doc_id, CAST(sum(2.0) AS DOUBLE) AS score FROM toks JOIN topics USING (token) WHERE token NOT IN ({STOPS}) GROUP BY ALL),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM overlap QUALIFY rank <= 100)"""


def overlap(spark, sf_dir):
    topics = A.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("query_id"), "text")
    return retrieval.token_overlap(A.table(spark, sf_dir, "documents").select("doc_id", "text"), topics, {"text": 2.0}, 100)


@query(f"WITH {OVERLAP_SQL} SELECT * FROM found")
def q11_token_overlap(spark, sf_dir):
    """All benchmark items as topics against all documents; the limit is the operator's top-k."""
    return overlap(spark, sf_dir)


WEIGHTS = [(f"w{i}", i / 8, 1 - i / 8) for i in range(9)]
WEIGHTS_SQL = ", ".join(f"('{c}', {a}::DOUBLE, {b}::DOUBLE)" for c, a, b in WEIGHTS)
SWEEP_SQL = f"""weights(config, w_lexical, w_semantic) AS (VALUES {WEIGHTS_SQL}),
swept AS (SELECT config, query_id, doc_id, coalesce(w_lexical / (60 + lexical_rank), 0) + coalesce(w_semantic / (60 + semantic_rank), 0) AS score FROM ranks, weights),
best AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, doc_id) AS rank FROM swept QUALIFY rank <= 20)"""


@query(f"WITH {SCORED_SQL}, {VECTORS_SQL}, {RANKS_SQL}, {SWEEP_SQL} SELECT config, query_id, doc_id, rank, round(score, 9) AS score FROM best")
def q13_weight_sweep(spark, sf_dir):
    weights = spark.createDataFrame(WEIGHTS, "config string, w_lexical double, w_semantic double")
    swept = retrieval.weighted_fusion_sweep(lexical(spark, sf_dir), semantic(spark, sf_dir), weights, 20)
    return swept.select("config", "query_id", "doc_id", "rank", F.round("score", 9).alias("score"))


@query("""SELECT vec_id, len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x))) AS valid FROM embeddings""")
def p7_vector_validation(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").select("vec_id", V.is_valid(F.col("embedding"), 64).alias("valid"))


@query("""SELECT count(*) AS current, count(vec_id) AS embedded, count(*) > 0 AND count(*) = count(vec_id) AS complete FROM part LEFT JOIN embeddings ON p_partkey = vec_id""")
def a12_coverage(spark, sf_dir):
    current = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("version_id"))
    return retrieval.coverage(current, A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("version_id")))


# --- metrics -------------------------------------------------------------------------------------

PER_QUERY_SQL = f"""{A.JUDGMENTS_SQL},
ideal AS (SELECT query_id, sum(CASE WHEN r <= 5 THEN g END) AS ideal_5, sum(CASE WHEN r <= 10 THEN g END) AS ideal_10, count(*) FILTER (grade = 2) AS total
          FROM (SELECT query_id, grade, r, (2.0 ** grade - 1) / log2(r + 1.0) AS g FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM judged)) GROUP BY query_id),
graded AS (SELECT f.query_id, f.doc_id, rank, coalesce(grade, 0) AS grade, (2.0 ** coalesce(grade, 0) - 1) / log2(rank + 1.0) AS g FROM found f LEFT JOIN judged USING (query_id, doc_id)),
hit AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN g END) AS dcg_5, sum(CASE WHEN rank <= 10 THEN g END) AS dcg_10, count(*) FILTER (grade = 2 AND rank <= 5) AS h5,
        count(*) FILTER (grade = 2 AND rank <= 10) AS h10, count(*) FILTER (grade = 2 AND rank <= 50) AS h50, min(rank) FILTER (grade = 2) AS first, count(*) FILTER (grade = 1 AND rank <= 10) AS ones,
        count(*) FILTER (rank <= 10) AS shown FROM graded GROUP BY query_id),
per_query AS (SELECT query_id, CASE WHEN ideal_5 > 0 THEN coalesce(dcg_5, 0) / ideal_5 ELSE 0 END AS ndcg_5, CASE WHEN ideal_10 > 0 THEN coalesce(dcg_10, 0) / ideal_10 ELSE 0 END AS ndcg_10,
        coalesce(h5, 0) / 5.0::DOUBLE AS precision_5, coalesce(h10, 0) / 10.0::DOUBLE AS precision_10, CASE WHEN total > 0 THEN coalesce(h50, 0) / total::DOUBLE ELSE 0 END AS recall_50,
        coalesce(1.0::DOUBLE / first, 0) AS mrr, CASE WHEN shown > 0 THEN ones / shown::DOUBLE ELSE 0 END AS grade_1_rate_10 FROM ideal LEFT JOIN hit USING (query_id))"""
ROUNDED = ", ".join(f"round({m}, 9) AS {m}" for m in metrics.METRICS)


def per_query(spark, sf_dir):
    return metrics.ranking_metrics(overlap(spark, sf_dir), A.judgments(spark, sf_dir))


@query(f"WITH {OVERLAP_SQL}, {PER_QUERY_SQL} SELECT query_id, {ROUNDED} FROM per_query")
def a17_ranking_metrics(spark, sf_dir):
    return per_query(spark, sf_dir).select("query_id", *[F.round(m, 9).alias(m) for m in metrics.METRICS])


@query(f"WITH {OVERLAP_SQL}, {PER_QUERY_SQL} SELECT " + ", ".join(f"round(coalesce(avg({m}), 0), 9) AS {m}" for m in metrics.METRICS) + " FROM per_query")
def a30_mean_metrics(spark, sf_dir):
    return metrics.mean_metrics(per_query(spark, sf_dir)).select(*[F.round(m, 9).alias(m) for m in metrics.METRICS])


@query(f"WITH {OVERLAP_SQL}, {PER_QUERY_SQL} SELECT query_id, round(grade_1_rate_10, 9) AS grade_1_rate_10 FROM per_query ORDER BY grade_1_rate_10 DESC, query_id LIMIT 10")
def k10_diagnosis(spark, sf_dir):
    """The ten worst topics, a report."""
    return per_query(spark, sf_dir).select("query_id", F.round("grade_1_rate_10", 9).alias("grade_1_rate_10")).orderBy(F.desc("grade_1_rate_10"), "query_id").limit(10)


PAIRS_SQL = """pairs AS (SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS expected,
    CASE WHEN doc_id % 7 = 0 THEN 'toxic' WHEN doc_id % 5 = 0 THEN 'odd' ELSE 'good' END AS predicted FROM labels)"""


def outcome_pairs(spark, sf_dir):
    expected = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    predicted = F.when(F.col("doc_id") % 7 == 0, "toxic").when(F.col("doc_id") % 5 == 0, "odd").otherwise("good")
    return A.table(spark, sf_dir, "labels").select(expected.alias("expected"), predicted.alias("predicted"))


@query(f"""WITH {PAIRS_SQL}, labels_seen AS (SELECT DISTINCT expected AS label FROM pairs),
f AS (SELECT label, 2.0 * count(*) FILTER (expected = label AND predicted = label) / (count(*) FILTER (expected = label) + count(*) FILTER (predicted = label)) AS f1 FROM labels_seen, pairs GROUP BY label)
SELECT round(avg(f1), 9) AS macro_f1 FROM f""")
def a22_macro_f1(spark, sf_dir):
    return metrics.macro_f1(outcome_pairs(spark, sf_dir)).select(F.round("macro_f1", 9).alias("macro_f1"))


@query(f"WITH {PAIRS_SQL} SELECT round(count(*) FILTER (expected = 'toxic' AND predicted = 'toxic') / (count(*) FILTER (expected = 'toxic'))::DOUBLE, 9) AS recall FROM pairs")
def a23_label_recall(spark, sf_dir):
    return metrics.label_recall(outcome_pairs(spark, sf_dir), "toxic").select(F.round("recall", 9).alias("recall"))


@query(f"WITH {PAIRS_SQL} SELECT expected, count(*) AS n FROM pairs GROUP BY expected")
def a24_histogram(spark, sf_dir):
    return evaluation.histogram(outcome_pairs(spark, sf_dir), "expected")


@query("""WITH e AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), p AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 500),
c AS (SELECT (SELECT count(*) FROM e JOIN p USING (doc_id)) AS tp, (SELECT count(*) FROM e) AS n_expected, (SELECT count(*) FROM p) AS n_predicted)
SELECT tp, n_expected, n_predicted, round(tp / n_predicted::DOUBLE, 9) AS precision, round(tp / n_expected::DOUBLE, 9) AS recall,
       round(2 * (tp / n_predicted::DOUBLE) * (tp / n_expected::DOUBLE) / (tp / n_predicted::DOUBLE + tp / n_expected::DOUBLE), 9) AS f1 FROM c""")
def a25_set_prf(spark, sf_dir):
    e = A.table(spark, sf_dir, "labels").where("quality = 1")
    p = A.table(spark, sf_dir, "documents").where("n_chars > 500")
    return metrics.set_prf(e, p, "doc_id").select("tp", "n_expected", "n_predicted", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


# --- versions ------------------------------------------------------------------------------------

AS_OF_SQL = "TIMESTAMP '1998-06-01'"


@query(f"WITH {A.VERSIONS_SQL} SELECT key, version_id FROM versions WHERE ingested_at <= {AS_OF_SQL} AND (superseded_at IS NULL OR superseded_at > {AS_OF_SQL})")
def f1_as_of_filter(spark, sf_dir):
    built = versioning.build_versions(A.versions(spark, sf_dir))
    return retrieval.as_of(built, F.lit("1998-06-01").cast("timestamp")).select("key", "version_id")


@query(f"WITH {A.VERSIONS_SQL} SELECT key, version_id, superseded_by, superseded_at, CASE WHEN root <> version_id THEN root END AS reused_from, root = version_id AS requires_reparse FROM versions")
def j14_version_chain(spark, sf_dir):
    return versioning.build_versions(A.versions(spark, sf_dir)).select("key", "version_id", "superseded_by", "superseded_at", "reused_from", "requires_reparse")


@query(f"WITH {A.VERSIONS_SQL} SELECT key, version_id, superseded_by, superseded_at, CASE WHEN root <> version_id THEN root END AS reused_from, root = version_id AS requires_reparse FROM versions")
def l1_incremental_upsert(spark, sf_dir):
    """Orders arrive in three deltas, the last third first; the history is merged, not built."""
    arrivals = A.versions(spark, sf_dir)
    store = history.VersionHistory(spark, shared_path(spark, "history"), 16)
    for third in (2, 0, 1):
        store.merge(arrivals.where(F.pmod(F.col("seq"), F.lit(3)) == third))
    return store.read().select("key", "version_id", "superseded_by", "superseded_at", "reused_from", "requires_reparse")


@query(f"WITH {A.VERSIONS_SQL} SELECT key, version_id FROM versions QUALIFY row_number() OVER (PARTITION BY key ORDER BY ingested_at DESC, seq DESC) = 1")
def w2_latest_version(spark, sf_dir):
    return versioning.latest(versioning.build_versions(A.versions(spark, sf_dir))).select("key", "version_id")


@query(f"WITH {A.VERSIONS_SQL} SELECT version_id FROM arrivals a WHERE ingested_at >= TIMESTAMP '1998-01-01' AND NOT EXISTS (SELECT 1 FROM versions v WHERE v.key = a.key AND v.source_hash = a.source_hash AND v.ingested_at < TIMESTAMP '1998-01-01')")
def l2_unseen_arrivals(spark, sf_dir):
    arrivals = A.versions(spark, sf_dir)
    known = versioning.build_versions(arrivals).where(F.col("ingested_at") < F.lit("1998-01-01").cast("timestamp"))
    return versioning.unseen(arrivals.where(F.col("ingested_at") >= F.lit("1998-01-01").cast("timestamp")), known).select("version_id")


@query("SELECT p_partkey AS version_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def j11_backfill_anti(spark, sf_dir):
    jobs = A.table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("version_id"))
    stored = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("version_id"), F.col("p_size").alias("ingested_at"))
    return versioning.missing_work(stored, jobs).select("version_id")


@query("""SELECT count(*) AS n_versions, count(d) AS n_dated, count(*) - count(d) AS n_undated, min(d) AS oldest_update, max(d) AS newest_update, max(o_orderdate) AS last_retrieved
FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS d, o_orderdate FROM orders)""")
def a10_freshness(spark, sf_dir):
    stored = A.versions(spark, sf_dir).withColumn("source_updated_at", F.when(F.col("matching_hash") != "P", F.col("retrieved_at")))
    return versioning.freshness(stored)


@query("SELECT CASE WHEN bool_or(o_orderstatus = 'P') THEN 'updating' WHEN count(*) > 0 THEN 'ready' ELSE 'empty' END AS state FROM orders")
def a11_catalogue_state(spark, sf_dir):
    jobs = A.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", "queued").otherwise("completed").alias("status"))
    return versioning.catalogue_state(jobs, F.lit(True))


@query("""SELECT o_orderpriority AS kind, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_failed, max(epoch(TIMESTAMP '2002-01-01')::BIGINT - epoch(o_orderdate)::BIGINT) AS max_lag
FROM orders GROUP BY ALL""")
def a14_ingest_metrics(spark, sf_dir):
    day = F.col("o_orderdate").cast("timestamp")
    jobs = A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"), F.lit("2002-01-01").cast("timestamp").alias("retrieved_at"), day.alias("source_updated_at"))
    return versioning.ingest_metrics(jobs, "kind")


# --- facts, dates, rules -------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def n1_json_number(spark, sf_dir):
    from siftlark.functions import variants

    return A.table(spark, sf_dir, "events").select("event_id", variants.number(F.try_parse_json("props"), "$.k").alias("k"))


@query("""WITH g AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(DISTINCT value) AS n FROM events GROUP BY ALL)
SELECT event_id, n > 1 AS conflicting FROM events JOIN g ON g.user_id = events.user_id AND g.event_type = events.event_type AND g.day = CAST(ts AS DATE)""")
def a6_conflicts(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return fhir.conflicting_values(rows, ["user_id", "event_type", "day"], "value").select("event_id", "conflicting")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) <= DATE '2001-06-01' - 365 AS stale FROM orders")
def d6_stale(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", D.is_stale(F.to_date("o_orderdate"), F.lit("2001-06-01").cast("date")).alias("stale"))


def cut_dates(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.col("o_orderkey") % 4
    return A.table(spark, sf_dir, "orders").select("o_orderkey", F.when(kind == 0, F.substring(text, 1, 4)).when(kind == 1, F.substring(text, 1, 7)).when(kind == 2, text).otherwise(F.concat(F.substring(text, 1, 8), F.lit("45"))).alias("written"))


CUT_SQL = """cut AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
    ELSE strftime(o_orderdate, '%Y-%m-') || '45' END AS written FROM orders)"""


@query(f"""WITH {CUT_SQL} SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' END AS precision,
CASE WHEN o_orderkey % 4 = 2 THEN written END AS normalized FROM cut""")
def d1_partial_dates(spark, sf_dir):
    parsed = D.partial_date(F.col("written"))
    return cut_dates(spark, sf_dir).select("o_orderkey", parsed["precision"].alias("precision"), parsed["normalized_date"].cast("string").alias("normalized"))


@query(f"""WITH {CUT_SQL}, r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(written || '-01-01' AS DATE) WHEN 1 THEN CAST(written || '-01' AS DATE) WHEN 2 THEN CAST(written AS DATE) END AS earliest FROM cut)
SELECT o_orderkey, earliest::VARCHAR AS earliest, (CASE o_orderkey % 4 WHEN 0 THEN make_date(year(earliest), 12, 31) WHEN 1 THEN last_day(earliest) WHEN 2 THEN earliest END)::VARCHAR AS latest FROM r""")
def d3_birth_range(spark, sf_dir):
    born = D.birth_range(F.col("written"))
    return cut_dates(spark, sf_dir).select("o_orderkey", born["earliest"].cast("string").alias("earliest"), born["latest"].cast("string").alias("latest"))


@query("SELECT o_orderkey, CAST(year(DATE '2026-02-28') - year(o_orderdate) - CASE WHEN (2, 28) < (month(o_orderdate), day(o_orderdate)) THEN 1 ELSE 0 END AS INTEGER) AS age FROM orders")
def d2_age(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", D.age_years(F.to_date("o_orderdate"), F.lit("2026-02-28").cast("date")).cast("int").alias("age"))


@query(f"""WITH {A.FACTS_SQL} SELECT fact_id, CASE WHEN code <> '2345-7' THEN NULL WHEN unit = 'mg/dL' THEN round(numeric_value * (1 / 18.0182::DOUBLE), 6) WHEN unit = 'mmol/L' THEN round(numeric_value, 6) END AS converted FROM facts""")
def m1_unit_conversion(spark, sf_dir):
    """Every fact; codes without a known unit convert to nothing."""
    return A.facts(spark, sf_dir).select("fact_id", F.round(rules.convert_unit(F.col("code.system"), F.col("code.value"), F.col("numeric_value"), F.col("unit"), F.lit("mmol/L")), 6).alias("converted"))


@query(f"""WITH {A.FACTS_SQL} SELECT patient_id AS query_id, fact_id, kind, CASE WHEN k % 4 = 1 THEN 'Shown ' || code ELSE code END AS text FROM facts
WHERE ((issue IS NULL AND ((kind = 'condition' AND status = 'active') OR (kind = 'medication' AND status = 'active') OR (kind = 'procedure' AND status = 'completed')))
   OR (issue = 'stale' AND kind = 'condition' AND status = 'active'))""")
def q1_query_builder(spark, sf_dir):
    shaped = A.facts(spark, sf_dir).select(
        "patient_id", "fact_id", "kind", F.struct("code.system", "code.value", F.when(F.col("k") % 4 == 1, F.concat(F.lit("Shown "), F.col("code.value"))).when(F.col("k") % 4 == 2, F.lit("  ")).alias("display")).alias("code"),
        F.struct(F.col("status").alias("clinical_status"), "status").alias("value"), F.transform("issue_codes", lambda c: F.struct(c.alias("code"))).alias("quality_issues"), F.lit(0).alias("ordinal"),
    )
    return retrieval.build_query_terms(shaped).select("query_id", "fact_id", "kind", "text")


GROUPS_SQL = A.evaluation_sql(f"SELECT DISTINCT import_id, DATE '{A.AS_OF}' AS as_of FROM efacts")


def evaluated(spark, sf_dir):
    facts = A.facts(spark, sf_dir)
    return rules.evaluate_criteria(A.criteria(spark, facts.select("import_id").distinct()), facts)


@query(f"WITH {GROUPS_SQL} SELECT import_id AS match_id, criterion_id, outcome, reason, n_evidence, reason NOT LIKE 'predicate%' AS requires_review FROM results")
def r10_rule_evaluation(spark, sf_dir):
    """Conditions, laboratory values with all comparators, windows, recency and statuses of every import in one pass."""
    return evaluated(spark, sf_dir).select("match_id", "criterion_id", "outcome", "reason", F.size("evidence_fact_ids").cast("long").alias("n_evidence"), "requires_review")


@query(f"""WITH {GROUPS_SQL} SELECT import_id AS match_id, CASE WHEN bool_or(outcome IN ('unknown', 'conflicting')) THEN 'needs_review'
WHEN bool_or(category = 'exclusion' AND outcome = 'not_met') THEN 'likely_excluded' WHEN bool_or(category = 'inclusion' AND outcome = 'not_met') THEN 'not_relevant' ELSE 'potential_match' END AS outcome
FROM results GROUP BY import_id""")
def a1_match_outcome(spark, sf_dir):
    found = evaluated(spark, sf_dir)
    wanted = A.criteria(spark, A.facts(spark, sf_dir).select("import_id").distinct()).select("match_id", "criterion_id", "category", F.lit(False).alias("requires_human_review"))
    return rules.aggregate_matches(wanted.select("match_id").distinct(), wanted, found)


@query("SELECT doc_id AS fact_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def j12_evidence_anti(spark, sf_dir):
    listed = A.table(spark, sf_dir, "documents").select(F.lit("m").alias("match_id"), F.col("doc_id").cast("string").alias("criterion_id"), F.array("doc_id").alias("evidence_fact_ids"), F.lit("met").alias("outcome"))
    known = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("fact_id"))
    return rules.evidence_problems(listed, known).where("problem = 'missing_fact'").select(F.col("criterion_id").cast("long").alias("fact_id"))


# --- parser --------------------------------------------------------------------------------------


def eligibility_texts(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.lit("Summary of "), "p_name", F.lit("\nInclusion Criteria:\nAge at least "), size, F.lit(" years"), F.when(F.col("p_size") % 3 == 0, " (confirmed)").otherwise(""),
        F.lit("\nage "), size, F.lit("-60 years unless "), "p_type", F.lit("\nExclusion criteria\nage ≤ "), size, F.lit("\n"),
    )
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("eligibility_text"))


PARSED_SQL = """texts AS (SELECT p_partkey AS doc_id, p_size AS s, 'Summary of ' || p_name || chr(10) || 'Inclusion Criteria:' || chr(10) AS head, CASE WHEN p_size % 3 = 0 THEN ' (confirmed)' ELSE '' END AS note,
    p_type AS kind FROM part),
first AS (SELECT *, length(head) AS s1, 'Age at least ' || s || ' years' AS h1, 'age ' || s || '-60 years' AS h2, 'age ≤ ' || s AS h3 FROM texts),
placed AS (SELECT *, s1 + length(h1) + length(note) + 1 AS s2, s1 + length(h1) + length(note) + 1 + length(h2) + length(' unless ' || kind) + 1 + length('Exclusion criteria') + 1 AS s3 FROM first),
crits AS (SELECT doc_id, 'inclusion' AS category, h1 AS source_text, s1 AS source_start, 'at_least' AS operator, s AS years, CASE WHEN note <> '' THEN 'nested_clause' ELSE '' END AS review_reasons FROM placed
    UNION ALL SELECT doc_id, 'inclusion', h2, s2, 'at_least', s, 'ambiguous_clause' FROM placed WHERE s <= 60 UNION ALL SELECT doc_id, 'inclusion', h2, s2, 'at_most', 60, 'ambiguous_clause' FROM placed WHERE s <= 60
    UNION ALL SELECT doc_id, 'exclusion', h3, s3, 'at_most', s, 'low_confidence_parse' FROM placed)"""


@query(f"""WITH {PARSED_SQL} SELECT doc_id, category, source_text, source_start, source_start + length(source_text) AS source_end, operator, years, review_reasons,
CAST(CASE review_reasons WHEN '' THEN 1.0 WHEN 'low_confidence_parse' THEN 0.6 ELSE 0.75 END AS DOUBLE) AS parser_confidence FROM crits""")
def t9_age_parser(spark, sf_dir):
    return parser.parse_criteria(eligibility_texts(spark, sf_dir)).select(
        "doc_id", "category", "source_text", F.col("source_start").cast("long").alias("source_start"), F.col("source_end").cast("long").alias("source_end"), "operator", "years",
        F.array_join("review_reasons", ",").alias("review_reasons"), F.col("parser_confidence").cast("double").alias("parser_confidence"),
    )


# --- review --------------------------------------------------------------------------------------

CURRENT_SQL = f"""{A.CORRECTIONS_SQL},
current AS (SELECT r.*, coalesce(l.corrected, r.outcome) AS current_outcome, coalesce(n, 0) AS n_corrections FROM results r
    LEFT JOIN (SELECT result_id, arg_max(corrected, created_at) AS corrected, count(*) AS n FROM fixed GROUP BY result_id) l USING (result_id))"""


@query(f"WITH {CURRENT_SQL} SELECT result_id, outcome, current_outcome, n_corrections FROM current")
def a3_latest_correction(spark, sf_dir):
    return review.current_outcomes(*A.corrections(spark, sf_dir)).select("result_id", "outcome", "current_outcome", "n_corrections")


@query(f"""WITH {CURRENT_SQL} SELECT match_id, CASE WHEN bool_or(current_outcome IN ('unknown', 'conflicting')) THEN 'needs_review' WHEN bool_or(category = 'exclusion' AND current_outcome = 'not_met') THEN 'likely_excluded'
WHEN bool_or(category = 'inclusion' AND current_outcome = 'not_met') THEN 'not_relevant' ELSE 'potential_match' END AS displayed_outcome FROM current GROUP BY match_id""")
def a2_current_outcome(spark, sf_dir):
    return review.displayed_outcomes(review.current_outcomes(*A.corrections(spark, sf_dir)))


@query(f"""WITH {A.CORRECTIONS_SQL}, h AS (SELECT f.*, coalesce(lag(corrected) OVER w, r.outcome) AS previous, row_number() OVER w AS position FROM fixed f JOIN results r USING (result_id)
WINDOW w AS (PARTITION BY result_id ORDER BY created_at, correction_id)) SELECT result_id, correction_id, previous, corrected, position, previous <> corrected AS changes FROM h""")
def w9_correction_history(spark, sf_dir):
    return review.correction_history(*A.corrections(spark, sf_dir)).select("result_id", "correction_id", "previous", "corrected", "position", "changes")


@query(f"""WITH {A.CORRECTIONS_SQL} SELECT result_id, 'evaluated' AS event, outcome, 0 AS position FROM results
UNION ALL SELECT result_id, 'corrected', corrected, row_number() OVER (PARTITION BY result_id ORDER BY created_at, correction_id) FROM fixed JOIN results USING (result_id)""")
def l8_audit_history(spark, sf_dir):
    results, fixed = A.corrections(spark, sf_dir)
    return review.audit_history(results.withColumn("evaluated_at", F.lit(0).cast("long")), fixed).select("result_id", "event", "outcome", "position")


@query(f"WITH {A.FACTS_SQL} SELECT fact_id, row_number() OVER (PARTITION BY patient_id ORDER BY CAST(effective_at AS DATE) DESC NULLS LAST, k DESC, fact_id) AS place FROM facts")
def k6_timeline(spark, sf_dir):
    """Facts dated to the day, of which the newer entry comes first."""
    facts = A.facts(spark, sf_dir).withColumns({"effective_at": F.to_date("effective_at"), "created_at": F.col("k")})
    return review.timeline(facts).select("fact_id", "place")


@query("SELECT p_partkey AS doc_id, p_name AS title, (SELECT count(*) FROM part) AS total FROM part ORDER BY p_partkey LIMIT 25")
def k7_page(spark, sf_dir):
    """The first page of the catalogue and how many entries it has."""
    return versioning.page(A.documents(spark, sf_dir).select("doc_id", "title"), "doc_id")


@query("""SELECT o_orderkey AS job_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'sync' WHEN '2-HIGH' THEN 'match' WHEN '3-MEDIUM' THEN 'embedding' ELSE 'backfill' END AS kind, o_orderdate AS created_at
FROM orders WHERE o_orderstatus = 'P' ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END, o_orderdate, o_orderkey LIMIT 5""")
def k8_fifo(spark, sf_dir):
    """The next five jobs to claim."""
    from siftlark.streaming import queue

    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "sync").when(F.col("o_orderpriority") == "2-HIGH", "match").when(F.col("o_orderpriority") == "3-MEDIUM", "embedding").otherwise("backfill")
    log = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), kind.alias("kind"), F.when(F.col("o_orderstatus") == "P", "queued").otherwise("completed").alias("status"), F.col("o_orderdate").alias("at"))
    return queue.next_jobs(log, spark.createDataFrame([], "job_id long"), 5).select("job_id", "kind", "created_at")


@query()
def p8_redact(spark, sf_dir):
    """The phone pattern looks around itself, which the oracle's engine cannot; tests hold it against Python's."""
    hidden = T.redact(F.col("text"))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.sha2(hidden, 256).alias("redacted_sha"), (hidden != F.col("text")).alias("changed"))


@query("""SELECT c_custkey, '{"id": ' || c_custkey || ', "name": "[REDACTED]", "tags": ["' || c_mktsegment || '", "mail [REDACTED] now"], "visit": {"code": "' || c_mktsegment || '", "note": "[REDACTED]", "seen": [{"phone": "[REDACTED]", "ref": "r' || c_custkey || '"}]}}' AS clean
FROM customer""")
def p9_redact_json(spark, sf_dir):
    """Nested documents of every customer: fields by name at any depth, addresses in texts of lists."""
    key = F.col("c_custkey").cast("string")
    seen = F.array(F.struct(F.concat(F.lit("r"), key).alias("ref"), F.lit("555-0000").alias("phone")))
    visit = F.struct(seen.alias("seen"), F.lit("private").alias("note"), F.col("c_mktsegment").alias("code"))
    tags = F.array("c_mktsegment", F.concat(F.lit("mail a"), key, F.lit("@x.example.org now")))
    document = F.to_json(F.struct(visit.alias("visit"), tags.alias("tags"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id")))
    return A.table(spark, sf_dir, "customer").select("c_custkey", redaction.redact_json(document).alias("clean"))


@query("""SELECT o_orderkey, sha256('{"a":"' || o_orderstatus || '","list":[' || o_custkey || ',null,{"k":true}]' || CASE WHEN o_orderkey % 3 = 0 THEN ',"price":' || o_totalprice::DOUBLE WHEN o_orderkey % 3 = 1 THEN ',"price":"\\u00e9"' ELSE '' END || ',"z":' || o_orderkey || '}') AS hash FROM orders""")
def h1_canonical_hash(spark, sf_dir):
    """Orders as documents with names out of order: with a fraction, with a letter beyond ASCII, and plain."""
    price = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(', "price" : '), F.col("o_totalprice").cast("double").cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.lit(', "price": "é"')).otherwise("")
    document = F.format_string('{"z": %s, "list": [%s, null, {"k": true}]%s, "a": "%s"}', F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), price, F.col("o_orderstatus"))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", hashing.canonical_hash(document).alias("hash"))
