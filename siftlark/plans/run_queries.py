"""Queries of match runs over the driver's tables, and the same rows in DuckDB SQL.

Parts are the catalogue: the first ones, as many as there are vectors, came in January 2024 and are
embedded, the others came in March. Every part whose key is divisible by 50 is a run with the terms of its own
type and brand; its number k decides instant, encoder and whether it has terms and a vector, so that
all modes occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.operators import matching as M
from siftlark.operators import fulltext, retrieval
from siftlark.plans import adapters as A
from siftlark.plans.registry import WORDS_SQL, item_words, query
from siftlark.sources.shared import stored, uncounted

RUN_SQL = r"""vn AS (SELECT count(*) AS n FROM embeddings),
cat AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN ing + INTERVAL 100 DAY END AS sup FROM (
    SELECT p_partkey AS doc_id, p_size, lower(p_name) AS title, lower(p_type) AS conditions, lower(p_brand) AS interventions, 'age at least ' || p_size || ' years' AS eligibility,
           TIMESTAMP '2024-01-01' + to_days((CASE WHEN p_partkey < n THEN p_partkey % 30 ELSE 60 + p_partkey % 30 END)::INTEGER) AS ing FROM part, vn)),
runs AS (SELECT 'q' || p_partkey AS query_id, CASE WHEN k % 2 = 0 THEN TIMESTAMP '2024-02-15' ELSE TIMESTAMP '2024-06-01' END AS as_of, k % 5 <> 0 AS ready, CASE WHEN k % 7 <> 0 THEN p_partkey % n END AS vec, k
         FROM (SELECT p_partkey, p_partkey // 50 AS k, n FROM part, vn WHERE p_partkey % 50 = 0)),
own AS (SELECT 'q' || p_partkey AS query_id, 'f' || p_partkey AS f, split_part(p_type, ' ', 1) AS c, p_brand AS b FROM part WHERE p_partkey % 50 = 0 AND (p_partkey // 50) % 9 <> 0),
terms AS (SELECT query_id, 0 AS pos, lower(c) AS term, f || 'a' AS fact_id, 'condition' AS kind FROM own UNION ALL SELECT query_id, 1, lower(b), f || 'b', 'medication' FROM own),
cover AS (SELECT i.as_of, count(doc_id) AS current, count(*) FILTER (doc_id < n) AS embedded FROM (SELECT DISTINCT as_of FROM runs) i LEFT JOIN cat ON ing <= as_of AND (sup IS NULL OR sup > as_of), vn GROUP BY i.as_of),
started AS (SELECT r.*, current, embedded, current > 0 AND current = embedded AS complete, EXISTS (SELECT 1 FROM own WHERE own.query_id = r.query_id) AS has_terms FROM runs r JOIN cover USING (as_of)),
parts AS (SELECT doc_id, ing, sup, place, regexp_extract_all(s, '[\p{L}\p{N}_]+') AS t FROM (SELECT doc_id, ing, sup, unnest([title, conditions, interventions, eligibility]) AS s, unnest(range(4)) AS place FROM cat)),
toks AS (SELECT *, coalesce(sum(len(t) + 1) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM parts),
w AS (SELECT doc_id, ing, sup, unnest(t) AS word, base + unnest(range(len(t))) AS pos FROM toks),
qw AS (SELECT query_id, as_of, len(ws) AS n_words, unnest(ws) AS word FROM (SELECT query_id, as_of, list_distinct(regexp_extract_all(lower(c || ' ' || b), '[\p{L}\p{N}_]+')) AS ws FROM own JOIN runs USING (query_id))),
met AS (SELECT query_id, doc_id, n_words, pos, word, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS j FROM w JOIN qw USING (word) WHERE ing <= as_of AND (sup IS NULL OR sup > as_of)),
whole AS (SELECT query_id, doc_id FROM met JOIN cat USING (doc_id) JOIN own USING (query_id) GROUP BY ALL HAVING count(DISTINCT word) = any_value(n_words) AND any_value(interventions) = lower(any_value(b))),
seen AS (SELECT a.query_id, a.doc_id, a.j, a.pos, a.n_words, b.word, max(b.j) AS lj FROM met a SEMI JOIN whole USING (query_id, doc_id) JOIN met b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.j <= a.j GROUP BY ALL),
spans AS (SELECT query_id, doc_id, j, pos, min(lj) AS s FROM seen GROUP BY ALL HAVING count(*) = any_value(n_words)),
fresh AS (SELECT * FROM (SELECT *, lag(s) OVER (PARTITION BY query_id, doc_id ORDER BY j) AS before FROM spans) WHERE before IS NULL OR before < s),
dense AS (SELECT f.query_id, f.doc_id, sum(0.1::DOUBLE / (1 + (f.pos - m.pos) - (f.j - f.s))) AS cover_rank FROM fresh f JOIN met m ON m.query_id = f.query_id AND m.doc_id = f.doc_id AND m.j = f.s GROUP BY ALL),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cover_rank, 9) DESC, doc_id) AS rank FROM dense QUALIFY rank <= 400),
hits AS (SELECT query_id, doc_id, pos, fact_id, CASE WHEN contains(conditions, term) THEN 4 WHEN contains(title, term) THEN 3 WHEN contains(interventions, term) THEN 2 WHEN contains(eligibility, term) THEN 1 END AS wt
         FROM pool JOIN cat USING (doc_id) JOIN terms USING (query_id) WHERE p_size > 3),
scored AS (SELECT query_id, doc_id, CAST(sum(wt) AS DOUBLE) AS score, count(*) AS matched_terms FROM hits WHERE wt IS NOT NULL GROUP BY ALL),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 400),
vecs AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
emb AS (SELECT doc_id, v, ing, sup, p_size FROM vecs JOIN cat USING (doc_id)),
asked AS (SELECT query_id, as_of, v AS qv FROM started JOIN vecs ON vec = doc_id WHERE has_terms AND complete AND ready),
sims AS (SELECT query_id, doc_id, p_size, round(list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))), 12) AS score FROM emb, asked WHERE ing <= as_of AND (sup IS NULL OR sup > as_of)),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank0 FROM sims QUALIFY rank0 <= 400),
semantic AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near WHERE p_size > 3),
ranks AS (SELECT query_id, doc_id, l.rank AS lexical_rank, s.rank AS semantic_rank, l.score AS lexical_score, s.score AS semantic_score FROM lexical l FULL JOIN semantic s USING (query_id, doc_id)),
fused AS (SELECT *, coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) AS fusion_score FROM ranks),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, doc_id) AS input_rank FROM fused QUALIFY input_rank <= 250),
spaced AS (SELECT query_id, doc_id, input_rank, kind, ' ' || array_to_string(regexp_extract_all(conditions, '[\p{L}\p{N}_]+'), ' ') || ' ' AS c, ' ' || array_to_string(regexp_extract_all(interventions, '[\p{L}\p{N}_]+'), ' ') || ' ' AS i,
           ' ' || array_to_string(regexp_extract_all(title, '[\p{L}\p{N}_]+'), ' ') || ' ' AS t, ' ' || array_to_string(regexp_extract_all(term, '[\p{L}\p{N}_]+'), ' ') || ' ' AS x FROM top JOIN cat USING (doc_id) JOIN terms USING (query_id)),
tiers AS (SELECT query_id, doc_id, input_rank, max(CASE WHEN kind = 'condition' AND contains(c, x) THEN 3 WHEN kind <> 'condition' AND contains(i, x) THEN 2 WHEN contains(t, x) THEN 1 ELSE 0 END) AS tier FROM spaced GROUP BY ALL),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, input_rank, doc_id) AS rank FROM tiers QUALIFY rank <= 100),
counts AS (SELECT query_id, (SELECT count(*) FROM pool p WHERE p.query_id = s.query_id) AS lexical_pool, (SELECT count(*) FROM lexical p WHERE p.query_id = s.query_id) AS lexical_after_filters,
    (SELECT count(*) FROM near p WHERE p.query_id = s.query_id) AS semantic_pool, (SELECT count(*) FROM semantic p WHERE p.query_id = s.query_id) AS semantic_after_filters,
    (SELECT count(*) FROM top p WHERE p.query_id = s.query_id) AS fused, (SELECT count(*) FROM final p WHERE p.query_id = s.query_id) AS persisted FROM started s),
modes AS (SELECT s.*, c.* EXCLUDE (query_id), CASE WHEN NOT has_terms THEN 'insufficient_evidence' WHEN NOT complete THEN 'lexical_only_partial_semantic_catalogue' WHEN NOT ready THEN 'lexical_only_model_unavailable'
    WHEN semantic_pool = 0 THEN 'lexical_only_no_semantic_candidates' ELSE 'hybrid' END AS mode FROM started s JOIN counts c USING (query_id)),
facts AS (SELECT query_id, fact_id, kind, []::VARCHAR[] AS codes, true AS used FROM terms UNION ALL SELECT query_id, f || 'c', 'observation', [], false FROM own
    UNION ALL SELECT query_id, f || 'd', 'condition', CASE WHEN k % 3 = 0 THEN ['stale', 'conflicting'] ELSE ['missing'] END, false FROM own JOIN runs USING (query_id)),
told AS (SELECT query_id, '{"included_fact_ids":[' || string_agg('"' || fact_id || '"', ',' ORDER BY fact_id) FILTER (used) || '],"omitted_fact_ids":[' || string_agg('"' || fact_id || '"', ',' ORDER BY fact_id) FILTER (NOT used)
    || '],"omitted_fact_reasons":{' || string_agg('"' || fact_id || '":["' || CASE WHEN len(codes) > 0 THEN array_to_string(list_sort(codes), '","') ELSE 'unsupported_retrieval_fact_kind:' || kind END || '"]', ',' ORDER BY fact_id) FILTER (NOT used)
    || '},"term_kinds":[' || string_agg('"' || kind || '"', ',' ORDER BY kind) FILTER (used) || ']}' AS manifest FROM facts GROUP BY query_id)"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """runs, terms, facts, catalogue and embedded."""
    n = A.table(spark, sf_dir, "embeddings").count()
    key, first = F.col("p_partkey"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    days = F.when(key < n, key % 30).otherwise(60 + key % 30).cast("int")
    born = first + F.make_dt_interval(days=days)
    part = A.table(spark, sf_dir, "part")
    catalogue = A.documents(spark, sf_dir).join(
        uncounted(part.select(key.alias("doc_id"), born.alias("ingested_at"), F.when(key % 7 == 0, born + F.make_dt_interval(days=F.lit(100))).alias("superseded_at"))), "doc_id"
    )
    vectors = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("doc_id"), "embedding").withColumn("model", F.lit("m1"))
    embedded = M.embedded_catalogue(catalogue.select("doc_id", "ingested_at", "superseded_at"), vectors.unionByName(vectors.withColumn("model", F.lit("m0"))), "m1")
    asked = part.where(key % 50 == 0).withColumn("k", F.floor(key / 50))
    instant = F.when(F.col("k") % 2 == 0, F.lit("2024-02-15").cast("timestamp")).otherwise(F.lit("2024-06-01").cast("timestamp"))
    runs = asked.select(F.concat(F.lit("q"), key.cast("string")).alias("query_id"), instant.alias("as_of"), (F.col("k") % 5 != 0).alias("encoder_ready"), F.when(F.col("k") % 7 != 0, key % n).cast("long").alias("doc_id"))
    runs = runs.join(uncounted(vectors.where("model = 'm1'").select("doc_id", F.col("embedding").alias("vector"))), "doc_id", "left").drop("doc_id")
    fact = lambda suffix, kind, codes: F.struct(F.concat(F.lit("f"), key.cast("string"), F.lit(suffix)).alias("fact_id"), F.lit(kind).alias("kind"), codes.cast("array<string>").alias("issue_codes"))
    flawed = F.when(F.col("k") % 3 == 0, F.array(F.lit("stale"), F.lit("conflicting"))).otherwise(F.array(F.lit("missing")))
    own = asked.where("k % 9 <> 0").withColumn("query_id", F.concat(F.lit("q"), key.cast("string")))
    facts = own.select("query_id", F.explode(F.array(fact("a", "condition", F.array()), fact("b", "medication", F.array()), fact("c", "observation", F.array()), fact("d", "condition", flawed))).alias("f")).select("query_id", "f.*")
    term = lambda pos, text, suffix, kind: F.struct(F.lit(pos).alias("pos"), text.alias("text"), F.concat(F.lit("f"), key.cast("string"), F.lit(suffix)).alias("fact_id"), F.lit(kind).alias("kind"))
    terms = own.select("query_id", F.explode(F.array(term(0, F.split_part("p_type", F.lit(" "), F.lit(1)), "a", "condition"), term(1, F.col("p_brand"), "b", "medication"))).alias("t")).select("query_id", "t.*")
    return {"runs": runs, "terms": terms, "facts": facts, "catalogue": catalogue, "embedded": embedded}


def ran(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    t = tables(spark, sf_dir)
    candidates, stages = M.run_matches(t["runs"], t["terms"], t["catalogue"], t["embedded"], F.col("p_size") > 3)
    return candidates, stages, t


#: The import of a run, and the criteria of a part: most rules, none for every eleventh one, and some that a person has to read.
ASSESSED_SQL = f"""people AS (SELECT count(DISTINCT user_id) AS n FROM events),
imported AS (SELECT r.query_id, r.as_of::DATE AS as_of, 'p' || k % people.n || ':' || k % 2 AS import_id FROM runs r, people),
{A.evaluation_sql("SELECT DISTINCT import_id, as_of FROM imported")},
asks AS (SELECT doc_id, criterion_id, doc_id % 13 = 0 AS by_person FROM cat, crit WHERE doc_id % 11 <> 0 AND (doc_id + length(criterion_id)) % 3 <> 0),
assessed AS (SELECT f.query_id, f.doc_id, count(a.criterion_id) AS n_results, CASE WHEN bool_or(a.criterion_id IS NULL OR a.by_person OR e.outcome IN ('unknown', 'conflicting')) THEN 'needs_review'
    WHEN bool_or(e.category = 'exclusion' AND e.outcome = 'not_met') THEN 'likely_excluded' WHEN bool_or(e.category = 'inclusion' AND e.outcome = 'not_met') THEN 'not_relevant' ELSE 'potential_match' END AS match_outcome
    FROM final f JOIN imported i USING (query_id) LEFT JOIN asks a ON a.doc_id = f.doc_id LEFT JOIN results e ON e.import_id = i.import_id AND e.as_of = i.as_of AND e.criterion_id = a.criterion_id GROUP BY f.query_id, f.doc_id)"""


def assessment_tables(spark, sf_dir, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs with import, criteria of parts, facts of imports)."""
    n = A.table(spark, sf_dir, "events").select("user_id").distinct().count()
    k = F.floor(F.regexp_extract("query_id", "[0-9]+", 0).cast("long") / 50)
    imported = runs.select("query_id", "as_of", F.concat(F.lit("p"), (k % n).cast("string"), F.lit(":"), (k % 2).cast("string")).alias("import_id"))
    key = F.col("p_partkey")
    listed = A.table(spark, sf_dir, "part").where(key % 11 != 0).select(key.alias("doc_id")).crossJoin(F.broadcast(A.rule_table(spark)))
    criteria = listed.where((F.col("doc_id") + F.length("criterion_id")) % 3 != 0).withColumn("requires_human_review", F.col("doc_id") % 13 == 0)
    return imported, criteria, A.facts(spark, sf_dir)


@query(f"""WITH {RUN_SQL}, {ASSESSED_SQL} SELECT query_id, doc_id, rank, tier, f.input_rank, mode, lexical_rank, semantic_rank, lexical_score, round(semantic_score, 6) AS semantic_score, round(fusion_score, 9) AS fusion_score,
n_results, match_outcome FROM final f JOIN top USING (query_id, doc_id) JOIN modes USING (query_id) JOIN assessed USING (query_id, doc_id)""")
def q9_match_run(spark, sf_dir):
    """The whole run of all patients: catalogue as of each run's instant, full text, filter, coverage gate, fusion, rerank, and the criteria of every match against the run's import."""
    candidates, stages, t = ran(spark, sf_dir)
    candidates = stored(candidates, "candidates")
    imported, criteria, facts = assessment_tables(spark, sf_dir, t["runs"])
    _, outcomes = M.assess_matches(candidates, imported, criteria, facts)
    return candidates.join(uncounted(stages.select("query_id", "mode")), "query_id").join(uncounted(outcomes), ["query_id", "doc_id"]).select(
        "query_id", "doc_id", "rank", "tier", "input_rank", "mode", "lexical_rank", "semantic_rank", "lexical_score", F.round("semantic_score", 6).alias("semantic_score"), F.round("fusion_score", 9).alias("fusion_score"),
        "n_results", "match_outcome",
    )


@query(f"""WITH {RUN_SQL} SELECT query_id, mode, CASE mode WHEN 'insufficient_evidence' THEN 'no_usable_retrieval_facts' WHEN 'lexical_only_partial_semantic_catalogue' THEN 'semantic_vector_coverage_incomplete'
WHEN 'lexical_only_model_unavailable' THEN 'semantic_model_unavailable' WHEN 'lexical_only_no_semantic_candidates' THEN 'semantic_branch_returned_no_candidates' ELSE '' END AS reasons,
lexical_pool, lexical_after_filters, semantic_pool, semantic_after_filters, fused, persisted, current AS current_trials, embedded AS embedded_trials, as_of, sha256(manifest) AS manifest_hash FROM modes LEFT JOIN told USING (query_id)""")
def q8_execution(spark, sf_dir):
    """Mode, reasons, six stage counts, coverage and the hash of the manifest of every run."""
    _, stages, t = ran(spark, sf_dir)
    done = M.executions(stages, M.manifests(t["facts"], t["terms"]))
    return done.select("query_id", "mode", F.array_join("degradation_reasons", ",").alias("reasons"), "counts.*", "semantic_coverage.*", F.col("catalogue.as_of").alias("as_of"), F.col("query_manifest_hash").alias("manifest_hash"))


@query(f"""WITH {RUN_SQL} SELECT query_id, mode, count(*) FILTER (used) AS included_fact_count, count(*) FILTER (NOT used) AS omitted_fact_count,
coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (used), '') AS term_kinds FROM modes LEFT JOIN facts USING (query_id) GROUP BY ALL""")
def f16_review_safe(spark, sf_dir):
    _, stages, t = ran(spark, sf_dir)
    safe = M.review_safe(M.executions(stages, M.manifests(t["facts"], t["terms"])))
    count = lambda c: F.coalesce(F.col(f"query_summary.{c}").cast("long"), F.lit(0)).alias(c)
    return safe.select("query_id", "mode", count("included_fact_count"), count("omitted_fact_count"), F.array_join(F.coalesce("query_summary.term_kinds", F.array().cast("array<string>")), ",").alias("term_kinds"))


@query(f"""WITH {RUN_SQL} SELECT query_id, doc_id, lexical_score AS lexical, round(semantic_score, 6) AS semantic, round(fusion_score, 9) AS fusion, tier AS support_tier, CASE WHEN lexical_score IS NOT NULL THEN 2 END AS query_terms,
CASE WHEN tier > 0 THEN 'direct_support' ELSE 'unknown' END AS status FROM final JOIN top USING (query_id, doc_id)""")
def f17_score_components(spark, sf_dir):
    parts = M.score_components(ran(spark, sf_dir)[0])
    return parts.select(
        "query_id", "doc_id", F.col("lexical.score").alias("lexical"), F.round("semantic.score", 6).alias("semantic"), F.round("fusion.score", 9).alias("fusion"), F.col("structured.support_tier").alias("support_tier"),
        F.col("lexical.query_term_count").cast("int").alias("query_terms"), F.col("structured.status").alias("status"),
    )


@query(f"""WITH {RUN_SQL}, a AS (SELECT query_id, array_to_string(list(doc_id ORDER BY rank), ',') AS lexical_ids FROM lexical GROUP BY 1), b AS (SELECT query_id, array_to_string(list(doc_id ORDER BY rank), ',') AS semantic_ids FROM semantic GROUP BY 1),
c AS (SELECT query_id, array_to_string(list(doc_id ORDER BY input_rank), ',') AS hybrid_ids FROM top GROUP BY 1), d AS (SELECT query_id, array_to_string(list(doc_id ORDER BY rank), ',') AS final_ids FROM final GROUP BY 1)
SELECT query_id, md5(coalesce(lexical_ids, '')) AS lexical_ids, md5(coalesce(semantic_ids, '')) AS semantic_ids, md5(coalesce(hybrid_ids, '')) AS hybrid_ids, md5(coalesce(final_ids, '')) AS final_ids
FROM a FULL JOIN b USING (query_id) FULL JOIN c USING (query_id) FULL JOIN d USING (query_id)""")
def q10_id_lists(spark, sf_dir):
    """Ids of the four stages of every run, each list as a digest: what the run wrote is read, nothing is searched again."""
    t = tables(spark, sf_dir)
    _, _, held = M.staged_run(t["runs"], t["terms"], t["catalogue"], t["embedded"], F.col("p_size") > 3)
    lists = M.ranked_id_lists(held["lexical_after_filters"], held["semantic_after_filters"], held["fused"], held["persisted"])
    joined = lambda c: F.md5(F.coalesce(F.array_join(c, ","), F.lit(""))).alias(c)
    return lists.select("query_id", *[joined(c) for c in ("lexical_ids", "semantic_ids", "hybrid_ids", "final_ids")])


@query(rf"""WITH {WORDS_SQL}, word AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM tokens),
qw AS (SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY no) AS no FROM (SELECT query_id, word, min(no) AS no FROM (SELECT query_id, unnest(w[1:3]) AS word, unnest(range(3)) AS no FROM asked) WHERE word IS NOT NULL GROUP BY query_id, word)),
size AS (SELECT query_id, count(*) AS n FROM qw GROUP BY 1),
met AS (SELECT query_id, doc_id, pos, no, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS j FROM word JOIN qw USING (word)),
last AS (SELECT *, max(CASE WHEN no = 1 THEN j END) OVER o AS l1, max(CASE WHEN no = 2 THEN j END) OVER o AS l2, max(CASE WHEN no = 3 THEN j END) OVER o AS l3
         FROM met WINDOW o AS (PARTITION BY query_id, doc_id ORDER BY j)),
began AS (SELECT *, CASE WHEN n = 1 THEN l1 WHEN n = 2 AND l2 IS NOT NULL AND l1 IS NOT NULL THEN least(l1, l2) WHEN n = 3 AND l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL THEN least(l1, l2, l3) END AS s FROM last JOIN size USING (query_id)),
fresh AS (SELECT * FROM (SELECT *, lag(s) OVER (PARTITION BY query_id, doc_id ORDER BY j) AS before FROM began WHERE s IS NOT NULL) WHERE before IS NULL OR before < s),
dense AS (SELECT f.query_id, f.doc_id, round(sum(0.1::DOUBLE / (1 + (f.pos - m.pos) - (f.j - f.s))), 9) AS cover_rank FROM fresh f JOIN met m ON m.query_id = f.query_id AND m.doc_id = f.doc_id AND m.j = f.s GROUP BY ALL)
SELECT query_id, doc_id, round(cover_rank, 6) AS cover_rank, row_number() OVER (PARTITION BY query_id ORDER BY cover_rank DESC, doc_id) AS rank FROM dense QUALIFY rank <= 400""")
def k1_fulltext_topk(spark, sf_dir):
    """The first three words of every benchmark item, ranked over all documents; the limit is the operator's."""
    asked = item_words(spark, sf_dir).select("query_id", F.array_join(F.transform(F.slice("w", 1, 3), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ").alias("text"))
    found = fulltext.search(A.table(spark, sf_dir, "documents").select("doc_id", "text"), asked, retrieval.LIMITS["lexical"])
    return found.withColumn("cover_rank", F.round("cover_rank", 6))


@query("""WITH vecs AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, DATE '2024-01-01' + (vec_id % 90)::INTEGER AS ing FROM embeddings),
asked AS (SELECT 'v' || doc_id AS query_id, v AS qv FROM vecs WHERE doc_id % 50 = 0),
sims AS (SELECT query_id, doc_id, round(list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))), 12) AS score FROM vecs, asked WHERE ing <= DATE '2024-02-15')
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sims QUALIFY rank <= 400""")
def j1_semantic_as_of(spark, sf_dir):
    """Every vector whose id is divisible by 50 against all vectors that an instant sees."""
    day = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(days=(F.col("vec_id") % 90).cast("int"))
    stored = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", day.alias("ingested_at"), F.lit(None).cast("timestamp").alias("superseded_at"))
    asked = stored.where("doc_id % 50 = 0").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("query_id"), F.col("embedding").alias("vector"), F.lit("2024-02-15").cast("timestamp").alias("as_of"))
    return M.semantic_candidates(stored, asked).withColumn("score", F.round("score", 6))


FIELDED_SQL = """vecs AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), asked AS (SELECT 'v' || doc_id AS query_id, v AS qv FROM vecs WHERE doc_id % 50 = 0),
sims AS (SELECT query_id, doc_id, list_dot_product(v[1:32], qv[1:32]) AS a, list_dot_product(v[33:64], qv[33:64]) AS b FROM vecs, asked)"""


def fielded(spark, sf_dir, by_rank: bool) -> DataFrame:
    """Halves of the vectors as fields; every vector whose id is divisible by 50 is a query, in blocks."""
    stored = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = stored.where("doc_id % 50 = 0").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("query_id"), F.col("embedding").alias("vector"))
    return M.fielded_semantic(stored, asked, {"title": (0, 32), "body": (32, 64)}, {"title": 0.7, "body": 0.3}, by_rank=by_rank)


@query(f"WITH {FIELDED_SQL} SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, 0.7::DOUBLE * a + 0.3::DOUBLE * b AS score FROM sims) QUALIFY rank <= 400")
def q12_fielded_semantic(spark, sf_dir):
    return fielded(spark, sf_dir, False).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {FIELDED_SQL}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, doc_id) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, doc_id) AS rb FROM sims),
s AS (SELECT query_id, doc_id, CASE WHEN ra <= 400 THEN 0.7::DOUBLE / (60 + ra) ELSE 0 END + CASE WHEN rb <= 400 THEN 0.3::DOUBLE / (60 + rb) ELSE 0 END AS score FROM r WHERE ra <= 400 OR rb <= 400)
SELECT query_id, doc_id, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 400""")
def w10_fielded_rrf(spark, sf_dir):
    return fielded(spark, sf_dir, True).select("query_id", "doc_id", F.round("score", 9).alias("score"))


# --- query building ------------------------------------------------------------------------------

PEOPLE_SQL = """told AS (SELECT o_custkey AS patient, CASE o_orderkey % 3 WHEN 0 THEN 'birth-date' WHEN 1 THEN 'administrative-gender' ELSE 'other' END AS code,
    CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-01-15') END ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'other' WHEN o_custkey % 2 = 0 THEN ' Female' ELSE 'male' END END AS said,
    o_orderkey % 11 = 0 AS flawed FROM orders)"""


def demographic_facts(spark, sf_dir) -> DataFrame:
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 3
    date = F.when(key % 5 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-01-15"))
    sex = F.when(key % 4 == 0, "other").when(F.col("o_custkey") % 2 == 0, " Female").otherwise("male")
    code = F.when(kind == 0, "birth-date").when(kind == 1, "administrative-gender").otherwise("other")
    return A.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("patient_id"), key.alias("fact_id"), F.lit("demographic").alias("kind"), F.struct(code.alias("value")).alias("code"), F.when(kind == 0, date).otherwise(sex).alias("text"),
        F.when(key % 11 == 0, F.array(F.lit("invalid"))).otherwise(F.array().cast("array<string>")).alias("issue_codes"), F.lit("2026-02-28").cast("date").alias("as_of"),
    )


@query(f"""WITH {PEOPLE_SQL}, b AS (SELECT patient, min(said) AS lo, max(said) AS hi FROM told WHERE code = 'birth-date' AND NOT flawed AND length(said) = 10 GROUP BY 1),
s AS (SELECT patient, min(lower(trim(said))) AS lo, max(lower(trim(said))) AS hi FROM told WHERE code = 'administrative-gender' AND NOT flawed AND lower(trim(said)) IN ('male', 'female') GROUP BY 1)
SELECT p.patient AS patient_id, CASE WHEN b.lo = b.hi THEN CAST(2026 - year(CAST(b.lo AS DATE)) AS INTEGER) END AS age_years, CASE WHEN s.lo = s.hi THEN s.lo END AS recorded_sex
FROM (SELECT DISTINCT patient FROM told) p LEFT JOIN b USING (patient) LEFT JOIN s USING (patient)""")
def d4_documented_age_sex(spark, sf_dir):
    facts = demographic_facts(spark, sf_dir)
    return M.documented_age(facts).join(M.documented_sex(facts), "patient_id").select("patient_id", F.col("age_years").cast("int").alias("age_years"), "recorded_sex")


@query(f"""WITH {RUN_SQL} SELECT query_id, c || ' ' || b AS lexical_text, c AS conditions, NULL::INTEGER AS age_years, NULL::VARCHAR AS recorded_sex FROM own""")
def q1_built_queries(spark, sf_dir):
    t = tables(spark, sf_dir)
    facts = t["facts"].select(F.col("query_id").alias("patient_id"), "kind", F.struct(F.lit("x").alias("value")).alias("code"), F.lit("t").alias("text"), "issue_codes", F.lit("2026-02-28").cast("date").alias("as_of"))
    built = M.build_queries(facts, t["terms"])
    return built.select("query_id", "lexical_text", F.array_join("conditions", ",").alias("conditions"), F.col("age_years").cast("int").alias("age_years"), "recorded_sex")


@query(f"""WITH {RUN_SQL} SELECT query_id, fact_id, CASE WHEN len(codes) > 0 THEN array_to_string(list_sort(codes), ',') ELSE 'unsupported_retrieval_fact_kind:' || kind END AS reasons FROM facts WHERE NOT used""")
def f21_omissions(spark, sf_dir):
    t = tables(spark, sf_dir)
    told = M.manifests(t["facts"], t["terms"]).select("query_id", F.explode("manifest.omitted_fact_reasons").alias("fact_id", "why"))
    return told.select("query_id", "fact_id", F.array_join("why", ",").alias("reasons"))


# --- lifecycle and assembly ----------------------------------------------------------------------

IMPORTS_SQL = """imports AS (SELECT o_orderkey AS import_id, o_custkey AS patient_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, o_orderdate AS created_at, o_orderdate + to_days((o_orderkey % 5)::INTEGER) AS completed_at FROM orders),
best AS (SELECT patient_id, import_id FROM imports WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY completed_at DESC, created_at DESC, import_id DESC) = 1)"""


def imports(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    day = F.col("o_orderdate").cast("timestamp")
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("import_id"), F.col("o_custkey").alias("patient_id"), status.alias("status"), day.alias("created_at"), (day + F.make_dt_interval(days=(F.col("o_orderkey") % 5).cast("int"))).alias("completed_at"))


@query(f"WITH {IMPORTS_SQL} SELECT * FROM best")
def f20_latest_import(spark, sf_dir):
    return M.latest_completed_imports(imports(spark, sf_dir)).select("patient_id", "import_id")


@query(f"""WITH {IMPORTS_SQL} SELECT c_custkey AS run_id, import_id, CASE WHEN import_id IS NOT NULL THEN 'queued' END AS status, 250 AS fused_limit, CASE WHEN import_id IS NULL THEN 'no_completed_import' END AS problem
FROM customer LEFT JOIN best ON patient_id = c_custkey""")
def l6_create_runs(spark, sf_dir):
    asked = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_custkey").alias("patient_id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    return M.create_runs(asked, imports(spark, sf_dir)).select("run_id", "import_id", "status", F.col("configuration.fused_limit").alias("fused_limit"), "problem")


@query("""SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey % 3 = 0 AND o_orderkey % 9 <> 0""")
def l4_cancellations(spark, sf_dir):
    """Requests for every third run, asked twice; every ninth was cancelled before."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    runs = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), status.alias("status"))
    asked = runs.where("run_id % 3 = 0").select("run_id")
    return M.new_cancellations(asked.unionByName(asked), runs, asked.where("run_id % 9 = 0"))


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey % 9 <> 0")
def j17_not_cancelled(spark, sf_dir):
    runs = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    return M.not_cancelled(runs, runs.where("run_id % 9 = 0"))


@query(f"""WITH {IMPORTS_SQL} SELECT patient_id, arg_max(import_id, (created_at, import_id)) AS latest_sync, arg_max(status, (created_at, import_id)) AS latest_status, max(CASE WHEN status = 'completed' THEN completed_at END) AS last_success_at FROM imports GROUP BY 1""")
def k11_sync_summary(spark, sf_dir):
    return M.sync_summary(imports(spark, sf_dir).withColumnRenamed("import_id", "sync_id"), "patient_id")


@query("SELECT c_custkey AS run_id, count(o_orderkey) AS candidate_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a13_candidate_counts(spark, sf_dir):
    runs = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    return M.candidate_counts(runs, A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id")))


@query("SELECT l_orderkey AS version_id, l_linenumber AS criterion_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS place FROM lineitem")
def k9_criteria_order(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("criterion_id"), F.col("l_quantity").alias("source_start"))
    return M.criteria_in_order(rows).select("version_id", "criterion_id", "place")


ASSEMBLY_SQL = f"""{A.CORRECTIONS_SQL}, known AS (SELECT r.result_id, match_id, category, coalesce(arg_max(corrected, (created_at, correction_id)), any_value(outcome)) AS current, r.result_id % 5 = 0 AS bound FROM results r LEFT JOIN fixed USING (result_id) GROUP BY ALL),
matched AS (SELECT c_custkey AS match_id, c_custkey % 9 AS run_id, c_nationkey AS version_id, c_custkey AS candidate_rank FROM customer)"""


@query(f"""WITH {ASSEMBLY_SQL} SELECT run_id, m.match_id, candidate_rank, n_name AS title, count(result_id) AS n_results,
CASE WHEN bool_or(result_id IS NULL OR bound OR current IN ('unknown', 'conflicting')) THEN 'needs_review' WHEN bool_or(category = 'exclusion' AND current = 'not_met') THEN 'likely_excluded'
WHEN bool_or(category = 'inclusion' AND current = 'not_met') THEN 'not_relevant' ELSE 'potential_match' END AS outcome FROM matched m JOIN nation ON n_nationkey = version_id AND n_nationkey % 4 <> 1 LEFT JOIN known k ON k.match_id = m.match_id GROUP BY ALL""")
def j2_assembled_results(spark, sf_dir):
    """Customers as matches, nations as versions (some are missing), conversations as criterion results with corrections."""
    results, fixed = A.corrections(spark, sf_dir)
    key = F.col("c_custkey")
    matches = A.table(spark, sf_dir, "customer").select(key.alias("match_id"), (key % 9).alias("run_id"), F.col("c_nationkey").alias("version_id"), key.alias("candidate_rank"))
    versions = A.table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("version_id"), F.col("n_name").alias("title"))
    given = results.select("result_id", "match_id", F.col("result_id").alias("criterion_id"), "outcome", (F.col("result_id") % 5 == 0).alias("requires_review"))
    return M.assemble_results(matches, versions, given, results.select(F.col("result_id").alias("criterion_id"), "category"), fixed).drop("version_id")


@query("""SELECT l_orderkey * 10 + l_linenumber AS result_id, o_custkey AS patient_id, CASE WHEN l_linenumber <> 4 THEN 'p' || (l_suppkey % 3) END AS parser_version, CASE WHEN l_linenumber = 3 THEN 0 ELSE 1 END::BIGINT AS n_evidence,
CASE WHEN l_linenumber = 5 THEN 'criterion_of_other_version' WHEN l_linenumber = 3 THEN 'evidence_not_in_import' END AS problem FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) JOIN orders ON o_orderkey = l_orderkey""")
def j16_detail_context(spark, sf_dir):
    """Line items as results of their order's run; line 3 cites a fact that the import lacks, line 4 has no parser run, line 5 belongs elsewhere."""
    line, number = F.col("l_linenumber"), (F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    items = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey")).withColumn("no", number)
    orders = A.table(spark, sf_dir, "orders")
    results = items.select(F.col("no").alias("result_id"), F.col("no").alias("criterion_id"), F.col("no").alias("match_id"), F.array(F.when(line == 3, F.lit(-1)).otherwise(F.col("no"))).alias("evidence_fact_ids"))
    criteria = items.select(F.col("no").alias("criterion_id"), F.col("no").alias("version_id"))
    matches = items.select(F.col("no").alias("match_id"), F.col("l_orderkey").alias("run_id"), F.when(line == 5, F.lit(-1)).otherwise(F.col("no")).alias("version_id"))
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderkey").alias("import_id"))
    known = items.select(F.col("l_orderkey").alias("import_id"), F.col("no").alias("fact_id"))
    parsers = items.where(line != 4).select(F.col("no").alias("version_id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 3).cast("string")).alias("parser_version"))
    found = M.detail_context(results, criteria, matches, runs, orders.select(F.col("o_orderkey").alias("import_id"), F.col("o_custkey").alias("patient_id")), known, parsers)
    return found.select("result_id", "patient_id", "parser_version", "n_evidence", "problem")
