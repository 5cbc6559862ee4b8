"""The driver's tables in the roles of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.operators import rules

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as trial documents."""
    text = F.concat(F.lit("Age at least "), F.col("p_size").cast("string"), F.lit(" years"))
    named = F.array(F.struct(F.col("p_brand").alias("name"), F.lit("DRUG").alias("type"), F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("other_names")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.array("p_type").alias("conditions"), named.alias("interventions"), text.alias("eligibility_text"), "p_size"
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the queries that the vectors ask as well: type, brand, name and size of every fiftieth part, from the second one on."""
    key = F.col("p_partkey").cast("string")
    term = lambda pos, text, kind: F.struct(F.lit(pos).alias("pos"), text.alias("text"), F.concat(F.lit("f"), key, F.lit("abcd"[pos])).alias("fact_id"), F.lit(kind).alias("kind"))
    size = F.concat(F.lit("at least "), F.col("p_size").cast("string"))
    listed = F.array(term(0, F.col("p_type"), "condition"), term(1, F.col("p_brand"), "medication"), term(2, F.col("p_name"), "condition"), term(3, size, "procedure"))
    return table(spark, sf_dir, "part").where("(p_partkey - 1) % 50 = 0").select(F.concat(F.lit("q"), key).alias("query_id"), F.explode(listed).alias("t")).select("query_id", "t.*")


TERMS_SQL = """asking AS (SELECT * FROM part WHERE (p_partkey - 1) % 50 = 0),
terms AS (SELECT 'q' || p_partkey AS query_id, pos, lower(term) AS term, 'f' || p_partkey || letter AS fact_id, kind FROM (
    SELECT p_partkey, 0 AS pos, p_type AS term, 'a' AS letter, 'condition' AS kind FROM asking UNION ALL SELECT p_partkey, 1, p_brand, 'b', 'medication' FROM asking
    UNION ALL SELECT p_partkey, 2, p_name, 'c', 'condition' FROM asking UNION ALL SELECT p_partkey, 3, 'at least ' || p_size, 'd', 'procedure' FROM asking))"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as arrivals of document versions of a customer."""
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version_id"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("source_hash"),
        F.col("o_orderstatus").alias("matching_hash"), day.alias("retrieved_at"), day.alias("ingested_at"), F.col("o_orderkey").alias("seq"),
    )


VERSIONS_SQL = """
arrivals AS (SELECT o_custkey AS key, o_orderkey AS version_id, o_orderstatus || '|' || o_orderpriority AS source_hash, o_orderstatus AS matching_hash,
                    o_orderdate AS retrieved_at, o_orderdate AS ingested_at, o_orderkey AS seq FROM orders),
firsts AS (SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY key, source_hash ORDER BY ingested_at, seq) = 1),
versions AS (SELECT *, lead(version_id) OVER w AS superseded_by, lead(retrieved_at) OVER w AS superseded_at,
                    first(version_id) OVER (PARTITION BY key, matching_hash ORDER BY ingested_at, seq) AS root
             FROM firsts WINDOW w AS (PARTITION BY key ORDER BY ingested_at, seq))"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as patient facts, in two imports of each patient; their JSON number decides unit, status and quality."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "click", "condition").when(F.col("event_type") == "view", "observation").when(F.col("event_type") == "purchase", "medication").otherwise("procedure")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("patient_id"),
        F.concat(F.lit("p"), F.col("user_id").cast("string"), F.lit(":"), (F.col("event_id") % 2).cast("string")).alias("import_id"),
        F.concat_ws(":", F.lit("e"), F.col("event_id").cast("string")).alias("fact_id"),
        kind.alias("kind"),
        F.struct(F.lit(rules.LOINC).alias("system"), F.when(F.col("event_type") == "view", "2345-7").otherwise(F.col("event_type")).alias("value")).alias("code"),
        F.lit(None).cast("string").alias("text"),
        F.col("value").alias("numeric_value"),
        F.when(k % 3 == 0, "active").when(k % 3 == 1, "completed").alias("status"),
        F.when(k % 7 != 0, F.when(k % 2 == 0, "mg/dL").otherwise("mmol/L")).alias("unit"),
        F.when(k % 11 != 0, F.col("ts").cast("timestamp")).alias("effective_at"),
        F.when(k == 98, F.array(F.lit("conflicting"))).when(k == 97, F.array(F.lit("stale"))).otherwise(F.array().cast("array<string>")).alias("issue_codes"),
        k.alias("k"),
    )


FACTS_SQL = """
facts AS (SELECT 'p' || user_id AS patient_id, 'p' || user_id || ':' || event_id % 2 AS import_id, 'e:' || event_id AS fact_id, k, value AS numeric_value,
                 CASE event_type WHEN 'click' THEN 'condition' WHEN 'view' THEN 'observation' WHEN 'purchase' THEN 'medication' ELSE 'procedure' END AS kind,
                 CASE WHEN event_type = 'view' THEN '2345-7' ELSE event_type END AS code,
                 CASE WHEN k % 3 = 0 THEN 'active' WHEN k % 3 = 1 THEN 'completed' END AS status,
                 CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'mg/dL' ELSE 'mmol/L' END END AS unit,
                 CASE WHEN k % 11 <> 0 THEN ts END AS effective_at,
                 CASE WHEN k = 98 THEN 'conflicting' WHEN k = 97 THEN 'stale' END AS issue
          FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""

#: Rules of most kinds, with all comparators: criterion, category, rule.
RULES = (
    ("c_condition", "inclusion", {"kind": "coded_condition", "system": rules.LOINC, "code": "click"}),
    ("c_lab", "inclusion", {"kind": "numeric_lab_threshold", "system": rules.LOINC, "code": "2345-7", "comparator": "<", "threshold": 2000.0, "unit": "mmol/L"}),
    ("c_lab_le", "inclusion", {"kind": "numeric_lab_threshold", "system": rules.LOINC, "code": "2345-7", "comparator": "<=", "threshold": 1800.0, "unit": "mg/dL"}),
    ("c_lab_gt", "exclusion", {"kind": "numeric_lab_threshold", "system": rules.LOINC, "code": "2345-7", "comparator": ">", "threshold": 90.0, "unit": "mmol/L"}),
    ("c_lab_ge", "exclusion", {"kind": "numeric_lab_threshold", "system": rules.LOINC, "code": "2345-7", "comparator": ">=", "threshold": 900.0, "unit": "mg/dL"}),
    ("c_window", "inclusion", {"kind": "date_window", "fact_kind": "medication", "system": rules.LOINC, "code": "purchase", "starts_on": "2024-01-05", "ends_on": "2024-01-20"}),
    ("c_recency", "exclusion", {"kind": "recency_window", "fact_kind": "procedure", "system": rules.LOINC, "code": "error", "within_days": 20}),
    ("c_medication", "exclusion", {"kind": "medication_status", "system": rules.LOINC, "code": "purchase", "expected_status": "active"}),
    ("c_procedure", "inclusion", {"kind": "procedure_status", "system": rules.LOINC, "code": "signup", "expected_status": "completed"}),
)
AS_OF = "2024-01-31"


def rule_table(spark: SparkSession) -> DataFrame:
    """criterion_id, category and rule of ``RULES``."""
    fields = [f.split(":")[0] for f in rules.RULE.removeprefix("struct<").removesuffix(">").split(",")]
    rows = [(c, g, *(r.get(f) for f in fields)) for c, g, r in RULES]
    kinds = {"years": "int", "threshold": "double", "within_days": "int"}
    flat = spark.createDataFrame(rows, ", ".join(["criterion_id string", "category string", *[f"{f} {kinds.get(f, 'string')}" for f in fields]]))
    return flat.select("criterion_id", "category", F.struct(*fields).cast(rules.RULE).alias("rule"))


def criteria(spark: SparkSession, imports: DataFrame) -> DataFrame:
    """Every rule for every import."""
    return imports.select("import_id").crossJoin(F.broadcast(rule_table(spark))).select(F.col("import_id").alias("match_id"), "import_id", "criterion_id", "category", F.lit(AS_OF).cast("date").alias("as_of"), "rule")


def evaluation_sql(units: str) -> str:
    """``results`` of every rule for the units (import_id, as_of) of a query; ``facts`` is named ``efacts``."""
    kinds = {"coded_condition": "condition", "numeric_lab_threshold": "observation", "medication_status": "medication", "procedure_status": "procedure"}
    listed = ", ".join(str((c, g, kinds.get(r["kind"], r.get("fact_kind")), r["code"])) for c, g, r in RULES)
    labs = " ".join(
        f"WHEN '{c}' THEN CASE f.unit WHEN 'mg/dL' THEN f.numeric_value {'* (1 / 18.0182::DOUBLE)' if r['unit'] == 'mmol/L' else ''} {r['comparator']} {r['threshold']}::DOUBLE"
        f" WHEN 'mmol/L' THEN f.numeric_value {'/ (1 / 18.0182::DOUBLE)' if r['unit'] == 'mg/dL' else ''} {r['comparator']} {r['threshold']}::DOUBLE END"
        for c, _, r in RULES
        if r["kind"] == "numeric_lab_threshold"
    )
    return f"""{FACTS_SQL.replace("facts AS", "efacts AS", 1)},
units AS ({units}),
crit(criterion_id, category, kind, code) AS (VALUES {listed}),
rowed AS (SELECT p.import_id, p.as_of, c.criterion_id, c.category, f.fact_id, f.issue,
    CASE c.criterion_id WHEN 'c_condition' THEN true {labs}
      WHEN 'c_window' THEN CAST(f.effective_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
      WHEN 'c_recency' THEN p.as_of - CAST(f.effective_at AS DATE) <= 20
      WHEN 'c_medication' THEN f.status = 'active' WHEN 'c_procedure' THEN f.status = 'completed' END AS truth,
    CASE WHEN f.fact_id IS NULL THEN NULL WHEN c.kind = 'observation' AND f.unit IS NULL THEN 'unusable_evidence'
      WHEN c.criterion_id IN ('c_window', 'c_recency') AND f.effective_at IS NULL THEN 'missing_date'
      WHEN c.criterion_id IN ('c_medication', 'c_procedure') AND f.status IS NULL THEN 'undocumented_status' END AS flaw
    FROM units p CROSS JOIN crit c LEFT JOIN efacts f ON f.import_id = p.import_id AND f.kind = c.kind AND f.code = c.code),
reasoned AS (SELECT import_id, as_of, criterion_id, category, count(fact_id) AS n_evidence,
    CASE WHEN bool_or(issue = 'conflicting') THEN 'conflicting_evidence' WHEN count(issue) > 0 THEN 'unusable_evidence' WHEN count(fact_id) = 0 THEN 'missing_evidence'
      WHEN min(flaw) IS NOT NULL THEN min(flaw) WHEN bool_and(truth) <> bool_or(truth) THEN 'conflicting_evidence' WHEN bool_and(truth) THEN 'predicate_matched' ELSE 'predicate_not_matched' END AS reason
    FROM rowed GROUP BY ALL),
results AS (SELECT *, CASE WHEN reason = 'conflicting_evidence' THEN 'conflicting' WHEN reason NOT LIKE 'predicate%' THEN 'unknown'
    WHEN (reason = 'predicate_matched') = (category = 'inclusion') THEN 'met' ELSE 'not_met' END AS outcome FROM reasoned)"""


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judgments of forty topics."""
    grade = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when(F.col("toxic") == 1, 1).otherwise(0)
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("t"), (F.col("doc_id") % 40).cast("string")).alias("query_id"), "doc_id", grade.alias("grade"))


JUDGMENTS_SQL = """
judged AS (SELECT 't' || (doc_id % 40) AS query_id, doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN toxic = 1 THEN 1 ELSE 0 END AS grade FROM labels)"""


def corrections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as reviewed results: (results, corrections)."""
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("met", "not_met", "unknown", "conflicting")]), (F.length("text") % 4 + 1).cast("int"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", outcome.alias("outcome"))
    results = turns.where("turn = 0").select(
        F.col("conv_id").alias("result_id"), (F.col("conv_id") % 40).alias("match_id"), F.when(F.col("conv_id") % 3 == 0, "exclusion").otherwise("inclusion").alias("category"), "outcome"
    )
    fixed = turns.where("turn > 0").select(F.col("conv_id").alias("result_id"), F.col("turn").alias("correction_id"), F.col("turn").alias("created_at"), F.col("outcome").alias("corrected"))
    return results, fixed


CORRECTIONS_SQL = """
turns AS (SELECT conv_id, turn, (['met', 'not_met', 'unknown', 'conflicting'])[length(text) % 4 + 1] AS outcome FROM conversations),
results AS (SELECT conv_id AS result_id, conv_id % 40 AS match_id, CASE WHEN conv_id % 3 = 0 THEN 'exclusion' ELSE 'inclusion' END AS category, outcome FROM turns WHERE turn = 0),
fixed AS (SELECT conv_id AS result_id, turn AS correction_id, turn AS created_at, outcome AS corrected FROM turns WHERE turn > 0)"""
