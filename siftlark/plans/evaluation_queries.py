"""Queries of evaluation, normalised facts and remaining operators over the driver's tables, and the same rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlark.operators import evaluation as E
from siftlark.operators import extract, fhir, metrics, parser, retrieval, review, rules
from siftlark.plans import adapters as A
from siftlark.plans import registry as R
from siftlark.plans.registry import query

CASES_SQL = """cases AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'exclusion' ELSE 'inclusion' END AS category, (['met', 'not_met', 'unknown', 'conflicting'])[(quality + 2 * toxic + doc_id) % 4 + 1] AS expected,
    (['met', 'not_met', 'unknown', 'conflicting'])[(quality + 2 * toxic + doc_id + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END) % 4 + 1] AS predicted, doc_id % 5 = 0 AS requires_review,
    [doc_id, doc_id + 1] AS expected_ids, CASE WHEN doc_id % 3 = 0 THEN [doc_id] WHEN doc_id % 3 = 1 THEN [doc_id, doc_id + 2] ELSE [] END AS predicted_ids FROM labels)"""


def cases(spark, sf_dir) -> DataFrame:
    key = F.col("doc_id")
    state = lambda shift: F.element_at(F.array(*[F.lit(x) for x in ("met", "not_met", "unknown", "conflicting")]), ((F.col("quality") + 2 * F.col("toxic") + key + shift) % 4 + 1).cast("int"))
    found = F.when(key % 3 == 0, F.array(key)).when(key % 3 == 1, F.array(key, key + 2)).otherwise(F.array().cast("array<bigint>"))
    return A.table(spark, sf_dir, "labels").select(
        key.cast("long").alias("doc_id"), F.when(key % 4 == 0, "exclusion").otherwise("inclusion").alias("category"), state(F.lit(0)).alias("expected"), state(F.when(key % 6 == 0, 1).otherwise(0)).alias("predicted"),
        (key % 5 == 0).alias("requires_review"), F.array(key, key + 1).alias("expected_ids"), found.alias("predicted_ids"),
    )


@query(f"""WITH {CASES_SQL}, f AS (SELECT label, 2.0 * count(*) FILTER (expected = label AND predicted = label) / (count(*) FILTER (expected = label) + count(*) FILTER (predicted = label)) AS f1
    FROM (SELECT DISTINCT expected AS label FROM cases), cases GROUP BY label),
r AS (SELECT count(*) FILTER (category = 'exclusion' AND expected = 'not_met' AND predicted = 'not_met') / (count(*) FILTER (category = 'exclusion' AND expected = 'not_met'))::DOUBLE AS exclusion_recall,
    count(*) FILTER (expected IN ('unknown', 'conflicting') AND predicted NOT IN ('unknown', 'conflicting') AND NOT requires_review) / (count(*) FILTER (expected IN ('unknown', 'conflicting')))::DOUBLE AS false_clearance_rate,
    sum(len(list_intersect(expected_ids, predicted_ids))) / sum(len(predicted_ids))::DOUBLE AS evidence_precision, count(*) FILTER (requires_review) / count(*)::DOUBLE AS abstention_rate FROM cases)
SELECT round((SELECT avg(f1) FROM f), 9) AS criterion_macro_f1, round(coalesce(CASE WHEN isnan(exclusion_recall) THEN 0 ELSE exclusion_recall END, 0), 9) AS exclusion_recall, round(false_clearance_rate, 9) AS false_clearance_rate,
round(evidence_precision, 9) AS evidence_precision, round(abstention_rate, 9) AS abstention_rate FROM r""")
def a26_criteria_quality(spark, sf_dir):
    found = E.criteria_quality(cases(spark, sf_dir))
    return found.select(*[F.round(c, 9).alias(c) for c in ("criterion_macro_f1", "exclusion_recall", "false_clearance_rate", "evidence_precision", "abstention_rate")])


@query(f"WITH {CASES_SQL} SELECT round(avg(CASE WHEN (len(predicted_ids) = 0) = requires_review THEN 1.0 ELSE 0.0 END), 9) AS abstention_accuracy FROM cases")
def a27_abstention_accuracy(spark, sf_dir):
    rows = cases(spark, sf_dir).select(F.size("predicted_ids").alias("n_predicted"), F.col("requires_review").alias("abstains"))
    return E.abstention_accuracy(rows).select(F.round("abstention_accuracy", 9).alias("abstention_accuracy"))


@query("""WITH e AS (SELECT o_custkey AS case_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS doc_id FROM orders), r AS (SELECT o_custkey AS case_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders)
SELECT case_id, CASE WHEN count(e.doc_id) = 0 THEN 1.0 ELSE round(count(r.doc_id) / count(e.doc_id)::DOUBLE, 9) END AS recall FROM (SELECT DISTINCT * FROM e) e LEFT JOIN (SELECT * FROM r WHERE rank <= 5) r USING (case_id, doc_id) GROUP BY 1""")
def a29_candidate_recall(spark, sf_dir):
    from pyspark.sql import Window as W

    orders = A.table(spark, sf_dir, "orders")
    expected = orders.select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("doc_id"))
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ranked = orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(order).alias("rank"))
    return E.candidate_recall(expected, ranked, 5).withColumn("recall", F.round("recall", 9))


@query(f"WITH {CASES_SQL} SELECT CASE WHEN requires_review THEN 'needs_review' ELSE predicted END AS shown, count(*) AS n FROM cases GROUP BY 1")
def a24_outcomes(spark, sf_dir):
    """Outcomes as reviewers see them: whatever is bound to review counts as such."""
    shown = F.when(F.col("requires_review"), "needs_review").otherwise(F.col("predicted"))
    return E.histogram(cases(spark, sf_dir).withColumn("shown", shown), "shown")


# --- sweep, split, diagnosis ---------------------------------------------------------------------

# Topics of every tenth of the labels against two rankings of the labelled documents.
REPORT_SQL = f"""{A.JUDGMENTS_SQL},
lex AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY md5(doc_id::VARCHAR), doc_id) AS rank FROM judged),
sem AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY md5((doc_id * 7)::VARCHAR), doc_id) AS rank FROM judged)"""


def report_sql(found: str, name: str) -> str:
    body = R.PER_QUERY_SQL.removeprefix(A.JUDGMENTS_SQL + ",")
    for part in ("ideal", "graded", "hit", "per_query"):
        body = body.replace(f"\n{part} AS", f"\n{part}_{name} AS").replace(f"FROM {part} ", f"FROM {part}_{name} ").replace(f"JOIN {part} ", f"JOIN {part}_{name} ")
    return body.replace("FROM found f", f"FROM {found} f").strip()


TWO_SQL = f"{REPORT_SQL},\n{report_sql('lex', 'l')},\n{report_sql('sem', 's')}"


def rankings(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql import Window as W

    judged = A.judgments(spark, sf_dir)
    by = lambda key: W.partitionBy("query_id").orderBy(F.md5(key.cast("string")), "doc_id")
    one = lambda key: judged.select("query_id", "doc_id", F.row_number().over(by(key)).alias("rank"))
    return judged, one(F.col("doc_id")), one(F.col("doc_id") * 7)


@query(f"""WITH {TWO_SQL}, d AS (SELECT l.query_id, l.ndcg_10 AS a, s.ndcg_10 AS b, s.grade_1_rate_10 AS r FROM per_query_l l JOIN per_query_s s USING (query_id))
SELECT query_id, round(a, 9) AS lexical_ndcg_10, round(b, 9) AS semantic_ndcg_10, round(b, 12) < round(a, 12) AS semantic_worse, CASE WHEN row_number() OVER (ORDER BY r DESC, query_id) <= 3 THEN row_number() OVER (ORDER BY r DESC, query_id) END::INTEGER AS place FROM d""")
def q14_diagnosis(spark, sf_dir):
    judged, lexical, semantic = rankings(spark, sf_dir)
    found = E.diagnosis(metrics.ranking_metrics(lexical, judged), metrics.ranking_metrics(semantic, judged), 3)
    return found.select("query_id", F.round("lexical_ndcg_10", 9).alias("lexical_ndcg_10"), F.round("semantic_ndcg_10", 9).alias("semantic_ndcg_10"), "semantic_worse", "place")


DELTA_SQL = " UNION ALL ".join(f"SELECT '{m}' AS metric, round((SELECT avg({m}) FROM per_query_l), 9) AS base, round((SELECT avg({m}) FROM per_query_s), 9) AS other, false AS passed" for m in metrics.METRICS)


@query(f"WITH {TWO_SQL} {DELTA_SQL}")
def a28_metric_deltas(spark, sf_dir):
    judged, lexical, semantic = rankings(spark, sf_dir)
    mean = lambda found: metrics.mean_metrics(metrics.ranking_metrics(found, judged))
    return E.metric_deltas(mean(lexical), mean(semantic)).select("metric", F.round("base", 9).alias("base"), F.round("other", 9).alias("other"), "passed")


SPLIT_WEIGHTS = ", ".join(f"({i}, 'w{i}', {i / 8}::DOUBLE, {1 - i / 8}::DOUBLE)" for i in range(9))


SPLIT_SQL = f"""{REPORT_SQL}, weights(ordinal, config, wl, ws) AS (VALUES {SPLIT_WEIGHTS}),
paired AS (SELECT query_id, doc_id, l.rank AS lr, s.rank AS sr FROM lex l FULL JOIN sem s USING (query_id, doc_id)),
swept AS (SELECT ordinal, config, query_id, doc_id, row_number() OVER (PARTITION BY config, query_id ORDER BY round(coalesce(wl / (60 + lr), 0) + coalesce(ws / (60 + sr), 0), 12) DESC, doc_id) AS rank FROM paired, weights),
ideal AS (SELECT query_id, sum(CASE WHEN r <= 10 THEN (2.0 ** grade - 1) / log2(r + 1.0) END) AS i10 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM judged) GROUP BY 1),
q AS (SELECT config, s.query_id, sum((2.0 ** grade - 1) / log2(rank + 1.0)) / any_value(i10) AS ndcg, count(*) FILTER (grade = 2) / 10.0::DOUBLE AS p10 FROM swept s JOIN judged USING (query_id, doc_id) JOIN ideal i ON i.query_id = s.query_id WHERE rank <= 10 GROUP BY ALL)"""


@query(f"""WITH {SPLIT_SQL}
SELECT config, CASE WHEN substr(query_id, 2)::INTEGER % 2 = 1 THEN 'tuning' ELSE 'held_out' END AS split, round(avg(CASE WHEN isnan(ndcg) THEN 0 ELSE coalesce(ndcg, 0) END), 9) AS ndcg_10, round(avg(p10), 9) AS precision_10 FROM q GROUP BY ALL""")
def q13_split_sweep(spark, sf_dir):
    """Nine weights, metrics on odd (tuning) and even (held-out) topics."""
    return split_sweep(spark, sf_dir).select("config", "split", F.round("ndcg_10", 9).alias("ndcg_10"), F.round("precision_10", 9).alias("precision_10"))


def split_sweep(spark, sf_dir) -> DataFrame:
    judged, lexical, semantic = rankings(spark, sf_dir)
    weights = spark.createDataFrame([(i, f"w{i}", i / 8, 1 - i / 8) for i in range(9)], "ordinal int, config string, w_lexical double, w_semantic double")
    swept = retrieval.weighted_fusion_sweep(lexical, semantic, weights, 100)
    per_topic = metrics.ranking_metrics(swept, judged, ("config", "query_id"))
    split = E.split_of(F.substring("query_id", 2, 9).cast("int"))
    return metrics.mean_metrics(per_topic.withColumn("split", split), "config", "split")


@query(f"""WITH {SPLIT_SQL}
SELECT config FROM (SELECT config, substr(config, 2)::INTEGER AS ordinal, round(avg(CASE WHEN isnan(ndcg) THEN 0 ELSE coalesce(ndcg, 0) END), 9) AS n, round(avg(p10), 9) AS p FROM q WHERE substr(query_id, 2)::INTEGER % 2 = 1 GROUP BY ALL)
ORDER BY n DESC, p DESC, ordinal LIMIT 1""")
def a31_best_configuration(spark, sf_dir):
    """The sweep's best weights on tuning topics, by means to nine decimals."""
    rounded = [F.round(c, 9).alias(c) for c in ("ndcg_10", "precision_10")]
    tuned = split_sweep(spark, sf_dir).where("split = 'tuning'").select("config", F.substring("config", 2, 9).cast("int").alias("ordinal"), *rounded)
    return E.best_configuration(tuned)


@query("SELECT DISTINCT doc_id AS query_id, 'first' AS only_in FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE n_chars > 300) USING (doc_id) UNION ALL SELECT DISTINCT doc_id, 'second' FROM documents ANTI JOIN labels USING (doc_id) WHERE n_chars > 300")
def j19_same_topics(spark, sf_dir):
    a = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"))
    return E.topics_that_differ(a, A.table(spark, sf_dir, "documents").where("n_chars > 300").select(F.col("doc_id").alias("query_id")))


@query("SELECT DISTINCT query_id, doc_id FROM (SELECT o_custkey AS query_id, o_orderkey AS doc_id FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def u7_candidate_union(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))
    return E.union_of(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 3 = 0"))


@query("SELECT o_orderkey AS report_id, 'model' AS setting, o_orderstatus AS found, 'F' AS pinned FROM orders WHERE o_orderstatus <> 'F'")
def p13_pins(spark, sf_dir):
    reports = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), F.create_map(F.lit("model"), F.col("o_orderstatus"), F.lit("fusion"), F.lit("v1")).alias("settings"))
    return E.pin_problems(reports, {"model": "F", "fusion": "v1"})


@query("SELECT l_orderkey, l_linenumber, l_orderkey || ':' || l_linenumber || ':' || l_returnflag AS signature FROM lineitem")
def h5_signatures(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", E.signature(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")).alias("signature"))


# --- normalised facts ----------------------------------------------------------------------------


def bundles(spark, sf_dir) -> DataFrame:
    """A bundle per customer: the patient, a condition, two readings of one code, a medication, a procedure and an allergy."""
    key = F.col("c_custkey")
    coded = lambda code: F.struct(F.array(F.struct(F.lit("s").alias("system"), code.alias("code"))).alias("coding"))
    subject = F.struct(F.concat(F.lit("Patient/c"), key.cast("string")).alias("reference"))
    name = lambda kind: F.concat(F.lit(kind), key.cast("string"))
    state = F.struct(F.array(F.struct(F.lit("s").alias("system"), F.when(key % 2 == 0, "active").otherwise("resolved").alias("code"))).alias("coding"))
    side = lambda value, unit: F.struct(value.alias("value"), unit.alias("unit"))
    span = lambda low, high, text: F.struct(side(low, F.lit("mg/dL")).alias("low"), side(high, F.when(key % 2 == 0, "mg/dL")).alias("high"), text.alias("text"))
    nothing = F.lit(None).cast("int")
    limits = F.array(span(F.when(key % 3 == 0, key), key + 7, F.lit("usual")), span(nothing, nothing, F.lit(" ")), span(nothing, nothing, F.when(key % 4 == 0, "by age")))
    reading = lambda no, value: F.struct(F.struct(F.lit("Observation").alias("resourceType"), name(no).alias("id"), F.lit("final").alias("status"), subject.alias("subject"), coded(F.lit("2345-7")).alias("code"),
                                                  F.struct(value.alias("value"), F.when(key % 4 != 0, "mg/dL").alias("unit")).alias("valueQuantity"), F.when(key % 5 != 0, "2026-01-05").alias("effectiveDateTime"),
                                                  limits.alias("referenceRange")).alias("resource"))
    parts = [
        F.struct(F.struct(F.lit("Patient").alias("resourceType"), name("c").alias("id"), F.when(key % 3 != 0, "female").alias("gender"), F.lit("1970-05-01").alias("birthDate")).alias("resource")),
        F.struct(F.struct(F.lit("Condition").alias("resourceType"), name("k").alias("id"), subject.alias("subject"), coded(F.col("c_mktsegment")).alias("code"), state.alias("clinicalStatus"), F.lit("2020-02-03").alias("onsetDateTime")).alias("resource")),
        reading("o", F.lit(5)),
        reading("x", F.when(key % 6 == 0, 6).otherwise(5)),
        F.struct(F.struct(F.lit("MedicationRequest").alias("resourceType"), name("m").alias("id"), F.lit("active").alias("status"), subject.alias("subject"), coded(F.lit("drug")).alias("medicationCodeableConcept"), F.lit("2026-02").alias("authoredOn")).alias("resource")),
        F.struct(F.struct(F.lit("Procedure").alias("resourceType"), name("p").alias("id"), F.lit("completed").alias("status"), subject.alias("subject"), coded(F.lit("proc")).alias("code"), F.lit("2026-13-01").alias("performedDateTime")).alias("resource")),
        F.struct(F.struct(F.lit("AllergyIntolerance").alias("resourceType"), name("a").alias("id"), subject.alias("patient"), coded(F.lit("nut")).alias("code")).alias("resource")),
    ]
    body = F.concat(F.lit('{"resourceType":"Bundle","entry":['), F.concat_ws(",", *[F.to_json(p) for p in parts]), F.lit("]}"))
    return A.table(spark, sf_dir, "customer").select(F.concat(F.lit("i"), key.cast("string")).alias("import_id"), body.alias("bundle"), F.lit("2026-03-01").cast("timestamp").alias("evaluated_at"))


FHIR_SQL = """c AS (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer),
raw(kind, letter, type, property, code, date_state) AS (VALUES ('demographic', 'c', 'Patient', 'administrative-gender', 'administrative-gender', 'none'), ('demographic', 'c', 'Patient', 'birth-date', 'birth-date', 'none'),
    ('condition', 'k', 'Condition', 'coding-0', NULL, 'stale'), ('observation', 'o', 'Observation', 'coding-0', '2345-7', 'reading'), ('observation', 'x', 'Observation', 'coding-0', '2345-7', 'reading'),
    ('medication', 'm', 'MedicationRequest', 'coding-0', 'drug', 'fresh'), ('procedure', 'p', 'Procedure', 'coding-0', 'proc', 'invalid'), ('allergy', 'a', 'AllergyIntolerance', 'coding-0', 'nut', 'missing')),
x AS (SELECT 'i' || k || ':' || type || ':' || letter || k || ':' || property AS fact_id, 'i' || k AS import_id, kind, coalesce(code, seg) AS code, k,
    CASE date_state WHEN 'none' THEN '' WHEN 'stale' THEN 'stale:date' WHEN 'fresh' THEN '' WHEN 'invalid' THEN 'invalid:date' WHEN 'missing' THEN 'missing:date'
      ELSE array_to_string(list_filter([CASE WHEN k % 5 = 0 THEN 'missing:date' END, CASE WHEN k % 4 = 0 THEN 'missing:valueQuantity.unit' END, CASE WHEN k % 5 <> 0 AND k % 6 = 0 THEN 'conflicting:valueQuantity.value' END], lambda i: i IS NOT NULL), ',') END AS issues
    FROM c, raw WHERE property <> 'administrative-gender' OR k % 3 <> 0)"""


@query(f"WITH {FHIR_SQL} SELECT fact_id, import_id, kind, code, issues FROM x")
def x10_normalized_facts(spark, sf_dir):
    """Demographics, conditions, observations, medications, procedures and allergies of every bundle, with their quality issues."""
    facts = fhir.normalize_bundles(bundles(spark, sf_dir))
    issues = F.array_join(F.transform("quality_issues", lambda i: F.concat_ws(":", i["code"], i["field"])), ",")
    return facts.select("fact_id", "import_id", "kind", F.col("code.value").alias("code"), issues.alias("issues"))


@query(f"WITH {FHIR_SQL} SELECT import_id, split_part(i, ':', 1) AS code, split_part(i, ':', 2) AS field, count(*) AS n FROM (SELECT import_id, unnest(string_split(issues, ',')) AS i FROM x WHERE issues <> '' UNION ALL SELECT 'i' || k, 'missing:gender' FROM c WHERE k % 3 = 0) GROUP BY ALL")
def x9_import_issues(spark, sf_dir):
    source = bundles(spark, sf_dir)
    return fhir.import_issues(source, fhir.normalize_bundles(source)).groupBy("import_id", "code", "field").agg(F.count("*").alias("n"))


@query(f"""WITH {FHIR_SQL} SELECT fact_id, 'low ' || CASE WHEN k % 3 = 0 THEN k || ' mg/dL' ELSE '-' END || ' high ' || (k + 7) || CASE WHEN k % 2 = 0 THEN ' mg/dL' ELSE '' END || ' usual' || CASE WHEN k % 4 = 0 THEN '; low - high - by age' ELSE '' END AS ranges
FROM x WHERE kind = 'observation'""")
def n2_reference_ranges(spark, sf_dir):
    """Reference ranges of all observations; sides without a number and ranges without anything are left out."""
    facts = fhir.normalize_bundles(bundles(spark, sf_dir)).where("kind = 'observation'")
    side = lambda r, s: F.when(r[s].isNull(), "-").otherwise(F.concat_ws(" ", r[s]["value"].cast("long").cast("string"), r[s]["unit"]))
    told = F.transform("reference_ranges", lambda r: F.concat_ws(" ", F.lit("low"), side(r, "low"), F.lit("high"), side(r, "high"), r["text"]))
    return facts.select("fact_id", F.array_join(told, "; ").alias("ranges"))


@query(f"WITH {FHIR_SQL} SELECT fact_id, contains(issues, 'conflicting') AS conflicting FROM x WHERE kind = 'observation'")
def a6_conflicting_observations(spark, sf_dir):
    facts = fhir.normalize_bundles(bundles(spark, sf_dir)).where("kind = 'observation'")
    return facts.select("fact_id", F.exists("quality_issues", lambda i: i["code"] == "conflicting").alias("conflicting"))


@query(f"WITH {FHIR_SQL} SELECT 'c' || k AS match_id, 'c_age' AS criterion_id, 'met' AS outcome, 'predicate_matched' AS reason FROM c UNION ALL SELECT 'c' || k, 'c_old', 'unknown', 'missing_evidence' FROM c WHERE false"
       " UNION ALL SELECT 'c' || k, 'c_sex', CASE WHEN k % 3 = 0 THEN 'unknown' ELSE 'met' END, CASE WHEN k % 3 = 0 THEN 'missing_evidence' ELSE 'predicate_matched' END FROM c"
       " UNION ALL SELECT 'c' || k, 'c_young', 'not_met', 'predicate_not_matched' FROM c")
def r1_age_and_sex(spark, sf_dir):
    """Age bounds and recorded sex of every bundle's patient, on facts that the normaliser made."""
    facts = fhir.rule_facts(fhir.normalize_bundles(bundles(spark, sf_dir)))
    listed = spark.createDataFrame([("c_age", "age", "at_least", 18, None), ("c_young", "age", "at_most", 40, None), ("c_sex", "recorded_sex", None, None, "female")], "criterion_id string, kind string, operator string, years int, value string")
    given = {"kind", "operator", "years", "value"}
    kinds = dict(f.split(":") for f in rules.RULE.removeprefix("struct<").removesuffix(">").split(","))
    rule = F.struct(*[F.col(n) if n in given else F.lit(None).cast(t).alias(n) for n, t in kinds.items()])
    asked = facts.select("patient_id", "import_id").distinct().crossJoin(F.broadcast(listed)).select(F.col("patient_id").alias("match_id"), "import_id", "criterion_id", F.lit("inclusion").alias("category"), F.lit("2026-03-01").cast("date").alias("as_of"), rule.alias("rule"))
    return rules.evaluate_criteria(asked, facts).select("match_id", "criterion_id", "outcome", "reason")


@query(f"WITH {FHIR_SQL} SELECT fact_id, split_part(fact_id, ':', 3) AS resource FROM x")
def j15_source_resources(spark, sf_dir):
    """All facts with the bundle entry they came from."""
    found = fhir.source_resources(bundles(spark, sf_dir), fhir.normalize_bundles(bundles(spark, sf_dir)))
    return found.select("fact_id", F.get_json_object("source_resource", "$.id").alias("resource"))


@query(f"WITH {A.FACTS_SQL} SELECT fact_id, row_number() OVER (PARTITION BY patient_id ORDER BY effective_at DESC NULLS LAST, fact_id) AS place FROM facts")
def k6_patient_timeline(spark, sf_dir):
    return review.timeline(A.facts(spark, sf_dir).withColumn("created_at", F.lit(0))).select("fact_id", "place")


@query(f"WITH {A.FACTS_SQL} SELECT fact_id FROM facts WHERE code = 'click'")
def f11_code_only_facts(spark, sf_dir):
    return rules.facts_of_code(A.facts(spark, sf_dir), "click").select("fact_id")


# --- studies -------------------------------------------------------------------------------------

STUDY_SQL = """s AS (SELECT p_partkey AS k, p_name AS name, p_type AS kind, p_brand AS brand, p_size AS size FROM part)"""


def studies(spark, sf_dir) -> DataFrame:
    """Parts as registry records; every fifth has no title and every seventh a wrong type of conditions."""
    key = F.col("p_partkey")
    date = F.when(key % 3 == 0, "2024-02-30").when(key % 3 == 1, "2024-02-28")
    section = F.struct(
        F.struct(F.format_string("NCT%08d", key).alias("nctId"), F.when(key % 5 != 0, F.col("p_name")).alias("briefTitle")).alias("identificationModule"),
        F.struct(F.lit("RECRUITING").alias("overallStatus"), F.when(date.isNotNull(), F.struct(date.alias("date"))).alias("lastUpdatePostDateStruct")).alias("statusModule"),
        F.struct(F.array("p_type").alias("conditions")).alias("conditionsModule"),
        F.struct(F.array(F.struct(F.col("p_brand").alias("name"), F.lit("DRUG").alias("type"))).alias("interventions")).alias("armsInterventionsModule"),
        F.struct(F.array(F.struct(F.lit("France").alias("country")), F.struct(F.lit(" ").alias("country")), F.struct(F.lit("France").alias("country"))).alias("locations")).alias("contactsLocationsModule"),
    )
    text = F.to_json(F.struct(section.alias("protocolSection")))
    return A.table(spark, sf_dir, "part").select(key.alias("k"), F.when(key % 7 == 0, F.replace(text, F.lit('"conditions":['), F.lit('"conditions":"x","other":['))).otherwise(text).alias("raw_study"))


@query(f"""WITH {STUDY_SQL} SELECT k, 'NCT' || lpad(k::VARCHAR, 8, '0') AS nct_id, CASE WHEN k % 5 <> 0 THEN name END AS title, CASE WHEN k % 7 = 0 THEN '' ELSE kind END AS conditions, brand AS interventions,
(['invalid', 'available', 'missing'])[k % 3 + 1] AS source_update_state, CASE WHEN k % 7 = 0 THEN 'malformed_field' END AS problem FROM s""")
def f12_trial_fields(spark, sf_dir):
    found = extract.extract_trials(studies(spark, sf_dir))
    names = F.array_join(F.transform("interventions", lambda i: i["name"]), ",")
    return found.select("k", "nct_id", "title", F.array_join(F.coalesce("conditions", F.array().cast("array<string>")), ",").alias("conditions"), names.alias("interventions"), "source_update_state", "problem")


@query(f"""WITH {STUDY_SQL} SELECT k, concat_ws(chr(10), CASE WHEN k % 5 <> 0 THEN name END, CASE WHEN k % 7 <> 0 THEN kind END, brand || ' ') AS document FROM s""")
def f15_embedding_documents(spark, sf_dir):
    return extract.extract_trials(studies(spark, sf_dir)).select("k", extract.embedding_document().alias("document"))


@query("SELECT p_partkey AS k, 'France' AS countries, 'DRUG' AS intervention_types, 'RECRUITING' AS status FROM part")
def f5_metadata(spark, sf_dir):
    found = extract.metadata_of(extract.extract_trials(studies(spark, sf_dir)))
    return found.select("k", F.array_join("countries", ",").alias("countries"), F.array_join("intervention_types", ",").alias("intervention_types"), "status")


# --- criteria ------------------------------------------------------------------------------------


@query(f"""WITH {R.PARSED_SQL} SELECT doc_id, source_start, operator, CASE WHEN doc_id % 2 = 0 THEN 'span_mismatch' WHEN doc_id % 9 = 0 THEN 'unknown_version' END AS problem FROM crits""")
def r13_manual_criteria(spark, sf_dir):
    """Typed-in criteria: those of even documents quote another text, every ninth document is not known."""
    texts = R.eligibility_texts(spark, sf_dir)
    quote = F.when(F.col("doc_id") % 2 == 0, F.lit("other")).otherwise(F.col("source_text"))
    rule = F.struct(F.lit("age").alias("kind"), "operator", "years")
    typed = parser.parse_criteria(texts).select("doc_id", "category", quote.alias("source_text"), "source_start", "source_end", rule.alias("rule"))
    found = parser.manual_criteria(typed, texts.where("doc_id % 9 <> 0 OR doc_id % 2 = 0"))
    return found.select("doc_id", F.col("source_start").cast("long").alias("source_start"), F.col("rule.operator").alias("operator"), "problem")


@query(f"""WITH {R.PARSED_SQL} SELECT doc_id, source_start, years, operator, review_reasons <> '' AS if_enabled, true AS requires_human_review, 'deterministic-v1' AS parser_version FROM crits""")
def r12_review_gate(spark, sf_dir):
    """Criteria with their provenance; every parse needs a person until automated use is enabled, and doubtful ones even then."""
    parsed = parser.parse_criteria(R.eligibility_texts(spark, sf_dir))
    enabled = parser.gated(parsed, automated=True).withColumnRenamed("requires_human_review", "if_enabled")
    found = parser.gated(enabled)
    return found.select("doc_id", F.col("source_start").cast("long").alias("source_start"), "years", "operator", "if_enabled", "requires_human_review", "parser_version")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'repeated_evidence' WHEN doc_id % 4 = 1 THEN 'missing_fact' WHEN doc_id % 4 = 2 THEN 'no_evidence' END AS problem, doc_id % 4 = 3 AND doc_id % 3 = 0 AS requires_review FROM labels""")
def r11_result_checks(spark, sf_dir):
    """Results as they may be stored: the first rule they break, and whether they or their criterion need review."""
    key = F.col("doc_id").cast("long")
    cited = F.when(key % 4 == 0, F.array(key, key)).when(key % 4 == 1, F.array(-key - 1)).when(key % 4 == 2, F.array().cast("array<bigint>")).otherwise(F.array(key))
    labels = A.table(spark, sf_dir, "labels").select(key.alias("doc_id"))
    results = labels.select(key.alias("match_id"), key.alias("criterion_id"), F.lit("met").alias("outcome"), cited.alias("evidence_fact_ids"), F.lit(False).alias("requires_review"))
    criteria = labels.select(key.alias("criterion_id"), ((key % 3 == 0) & (key % 4 == 3)).alias("requires_human_review"))
    return rules.checked_results(results, criteria, labels.select(key.alias("fact_id"))).select(F.col("match_id").alias("doc_id"), "problem", "requires_review")


@query("""SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'age_out_of_range' WHEN 1 THEN 'window_reversed' WHEN 2 THEN 'window_without_bound' WHEN 3 THEN 'status' END AS problem FROM benchmark""")
def p5_rule_validation(spark, sf_dir):
    key = F.col("item_id") % 5
    kinds = dict(f.split(":") for f in rules.RULE.removeprefix("struct<").removesuffix(">").split(","))
    given = {
        "kind": F.when(key == 0, "age").when(key < 3, "date_window").when(key == 3, "medication_status").otherwise("procedure_status"), "operator": F.lit("at_least"), "years": F.lit(131),
        "starts_on": F.when(key == 1, F.lit("2024-02-01").cast("date")), "ends_on": F.when(key == 1, F.lit("2024-01-01").cast("date")), "fact_kind": F.lit("condition"), "system": F.lit("s"), "code": F.lit("c"),
        "expected_status": F.when(key == 3, "wished").otherwise("completed"),
    }
    rule = F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
    return A.table(spark, sf_dir, "benchmark").select("item_id", rules.rule_problem(rule).alias("problem"))
