"""Rule evaluation under a four-valued logic, and aggregation to match outcomes.

All rules of all imports are evaluated in one pass: criteria are joined to facts of their import on kind and code, every
fact contributes a truth value or a reason why it cannot, and one grouped aggregate decides in the fixed
order quality conflict, quality issue, missing, unusable, disagreement, predicate. Absence never
becomes a negative.

criteria: match_id, criterion_id, import_id, category, as_of date, rule struct (``RULE``)
facts: import_id, fact_id, kind, code struct<system,value>, text, numeric_value, status, unit, effective_at,
issue_codes array<string>
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlark.functions import dates as D
from siftlark.sources.shared import uncounted

RULE = (
    "struct<kind:string,operator:string,years:int,value:string,system:string,code:string,comparator:string,threshold:double,"
    "unit:string,fact_kind:string,starts_on:date,ends_on:date,within_days:int,expected_status:string>"
)
# Demographic codes, and lab units with their factor to one unit for each exact code.
BIRTH_DATE, RECORDED_SEX, LOINC = "birth-date", "administrative-gender", "http://loinc.org"
LAB_UNITS = {
    ("2345-7", "mmol/L"): 1.0,
    ("2345-7", "mg/dL"): 1 / 18.0182,
    ("718-7", "g/dL"): 1.0,
    ("718-7", "g/L"): 0.1,
    ("2160-0", "mg/dL"): 1.0,
    ("2160-0", "umol/L"): 1 / 88.4,
    ("2160-0", "µmol/L"): 1 / 88.4,
}
# Statuses that rules may ask for, and kinds of facts that windows may be about.
STATUSES = {
    "medication_status": ("active", "on-hold", "completed", "stopped", "not-taken", "cancelled", "draft"),
    "procedure_status": ("preparation", "in-progress", "not-done", "on-hold", "stopped", "completed"),
}
WINDOW_KINDS = ("condition", "observation", "medication", "procedure")
RULE_KINDS = ("age", "recorded_sex", "coded_condition", "numeric_lab_threshold", "date_window", "recency_window", "medication_status", "procedure_status")


def unit_factor(system: Column, code: Column, unit: Column) -> Column:
    """Factor to the code's own unit; null outside the supported set."""
    known = reduce(lambda c, kv: F.when((code == kv[0][0]) & (unit == kv[0][1]), F.lit(kv[1])).otherwise(c), LAB_UNITS.items(), F.lit(None).cast("double"))
    return F.when(system == LOINC, known)


def convert_unit(system: Column, code: Column, value: Column, source: Column, target: Column) -> Column:
    return value * unit_factor(system, code, source) / unit_factor(system, code, target)


def compare(value: Column, comparator: Column, threshold: Column) -> Column:
    return (
        F.when(comparator == ">", value > threshold)
        .when(comparator == ">=", value >= threshold)
        .when(comparator == "<", value < threshold)
        .when(comparator == "<=", value <= threshold)
    )


def rule_problem(rule: Column) -> Column:
    """Why a rule is not valid; null if it is."""
    kind = rule["kind"]
    between = lambda c, a, b: F.coalesce((c >= a) & (c <= b), F.lit(False))
    window = kind == "date_window"
    return (
        F.when(~kind.isin(*RULE_KINDS) | kind.isNull(), "unknown_kind")
        .when((kind == "age") & ~between(rule["years"], 0, 130), "age_out_of_range")
        .when((kind == "age") & ~F.coalesce(rule["operator"].isin("at_least", "at_most"), F.lit(False)), "age_operator")
        .when((kind == "recency_window") & ~between(rule["within_days"], 0, 36500), "days_out_of_range")
        .when(window & rule["starts_on"].isNull() & rule["ends_on"].isNull(), "window_without_bound")
        .when(window & (rule["starts_on"] > rule["ends_on"]), "window_reversed")
        .when(kind.isin("date_window", "recency_window") & ~F.coalesce(rule["fact_kind"].isin(*WINDOW_KINDS), F.lit(False)), "fact_kind")
        .when((kind == "numeric_lab_threshold") & unit_factor(rule["system"], rule["code"], rule["unit"]).isNull(), "unsupported_unit")
        .when((kind == "numeric_lab_threshold") & ~F.coalesce(rule["comparator"].isin(">", ">=", "<", "<="), F.lit(False)), "comparator")
        .when((kind == "recorded_sex") & ~F.coalesce(rule["value"].isin("male", "female"), F.lit(False)), "sex")
        .when(reduce(lambda a, b: a | b, [(kind == k) & ~F.coalesce(rule["expected_status"].isin(*v), F.lit(False)) for k, v in STATUSES.items()]), "status")
    )


def _candidates(criteria: DataFrame, facts: DataFrame) -> DataFrame:
    """Criteria with each fact of their import and code, or one row without a fact. Demographics match on code alone."""
    kind = F.col("rule.kind")
    asked = criteria.withColumn(
        "want_kind",
        F.when(kind.isin("age", "recorded_sex"), "demographic")
        .when(kind == "coded_condition", "condition")
        .when(kind == "numeric_lab_threshold", "observation")
        .when(kind == "medication_status", "medication")
        .when(kind == "procedure_status", "procedure")
        .otherwise(F.col("rule.fact_kind")),
    ).withColumn("want_code", F.when(kind == "age", BIRTH_DATE).when(kind == "recorded_sex", RECORDED_SEX).otherwise(F.col("rule.code")))
    demographic = F.col("want_kind") == "demographic"
    asked = asked.withColumn("want_system", F.when(demographic, F.lit("*")).otherwise(F.col("rule.system")))
    system = F.when(F.col("kind") == "demographic", F.lit("*")).otherwise(F.col("code.system"))
    found = facts.select(
        F.col("import_id").alias("fact_import"), F.col("kind").alias("fact_kind"), system.alias("fact_system"), F.col("code.value").alias("fact_code"),
        "fact_id", "text", "numeric_value", "status", F.col("unit").alias("fact_unit"), "effective_at", "issue_codes",
    )
    same = (
        (F.col("import_id") == F.col("fact_import")) & (F.col("want_kind") == F.col("fact_kind"))
        & (F.col("want_system") == F.col("fact_system")) & (F.col("want_code") == F.col("fact_code"))
    )
    return asked.join(uncounted(found), same, "left")


def facts_of_code(facts: DataFrame, code: str, system: str | None = None) -> DataFrame:
    """Facts of a code, in any system unless one is named."""
    same = F.col("code.value") == code
    return facts.where(same if system is None else same & (F.col("code.system") == system))


def checked_results(results: DataFrame, criteria: DataFrame, facts: DataFrame) -> DataFrame:
    """Results with the first rule of storage that they break, and review demanded by the result or by its criterion.

    A result may not cite a fact twice or one that does not exist, must cite something unless it is
    unknown, and there is one for each match and criterion.
    """
    cited = results.select("match_id", "criterion_id", F.explode("evidence_fact_ids").alias("fact_id")).join(facts.select("fact_id").distinct(), "fact_id", "left_anti")
    lost = cited.select("match_id", "criterion_id", F.lit(True).alias("lost")).distinct()
    copies = results.groupBy("match_id", "criterion_id").agg(F.count("*").alias("copies"))
    both = results.join(criteria.select("criterion_id", F.col("requires_human_review").alias("by_criterion")), "criterion_id", "left").join(lost, ["match_id", "criterion_id"], "left").join(copies, ["match_id", "criterion_id"])
    problem = (
        F.when(F.size(F.array_distinct("evidence_fact_ids")) != F.size("evidence_fact_ids"), "repeated_evidence")
        .when((F.col("outcome") != "unknown") & (F.size("evidence_fact_ids") == 0), "no_evidence")
        .when(F.col("lost"), "missing_fact")
        .when(F.col("copies") > 1, "second_result")
    )
    review = F.col("requires_review") | F.coalesce("by_criterion", F.lit(False))
    return both.withColumn("problem", problem).withColumn("requires_review", review).drop("by_criterion", "lost", "copies")


def evaluate_criteria(criteria: DataFrame, facts: DataFrame) -> DataFrame:
    """match_id, criterion_id, category, outcome, reason, evidence_fact_ids, requires_review."""
    rows = _candidates(criteria, facts)
    rule, kind, as_of = F.col("rule"), F.col("rule.kind"), F.col("as_of")
    day = F.to_date("effective_at")
    born = D.birth_range(F.col("text"))
    young, old = D.age_years(born["latest"], as_of), D.age_years(born["earliest"], as_of)
    at_least = rule["operator"] == "at_least"
    age = F.when(at_least, F.when(young >= rule["years"], True).when(old < rule["years"], False)).otherwise(F.when(old <= rule["years"], True).when(young > rule["years"], False))
    sex = F.lower(F.trim(F.when(F.trim("text") != "", F.col("text"))))
    value = convert_unit(rule["system"], rule["code"], F.col("numeric_value"), F.col("fact_unit"), rule["unit"])
    inside = (rule["starts_on"].isNull() | (day >= rule["starts_on"])) & (rule["ends_on"].isNull() | (day <= rule["ends_on"]))
    status = F.when(F.col("status") != "", F.col("status"))
    has = F.col("fact_id").isNotNull()
    truth = (
        F.when(kind == "age", age)
        .when(kind == "recorded_sex", sex == rule["value"])
        .when(kind == "coded_condition", F.lit(True))
        .when(kind == "numeric_lab_threshold", compare(value, rule["comparator"], rule["threshold"]))
        .when(kind == "date_window", inside)
        .when(kind == "recency_window", F.datediff(as_of, day) <= rule["within_days"])
        .otherwise(status == rule["expected_status"])
    )
    timed = kind.isin("date_window", "recency_window")
    # What makes a single fact unfit for its rule; the first that holds for any fact decides.
    flaw = (
        F.when((kind == "age") & born.isNull(), "unusable_evidence")
        .when((kind == "numeric_lab_threshold") & value.isNull(), "unusable_evidence")
        .when(timed & F.col("effective_at").isNull(), "missing_date")
        .when(kind.isin("medication_status", "procedure_status") & status.isNull(), "undocumented_status")
    )
    rows = rows.select(
        "match_id", "criterion_id", "category", kind.alias("rule_kind"), "fact_id", has.alias("has"),
        F.when(has, F.exists("issue_codes", lambda c: c == "conflicting")).alias("conflict"),
        F.when(has, F.size("issue_codes") > 0).alias("issue"),
        F.when(has, flaw).alias("flaw"),
        F.when(has & (kind == "recency_window") & (day > as_of), True).alias("future"),
        F.when(has, truth).alias("truth"),
        F.when(has & (kind == "age"), born).alias("born"),
        F.when(has & (kind == "recorded_sex"), sex).alias("sex"),
    )
    found = rows.groupBy("match_id", "criterion_id", "category", "rule_kind").agg(
        F.count("fact_id").alias("n"),
        F.coalesce(F.bool_or("conflict"), F.lit(False)).alias("conflict"),
        F.coalesce(F.bool_or("issue"), F.lit(False)).alias("issue"),
        F.min("flaw").alias("flaw"),
        F.coalesce(F.bool_or("future"), F.lit(False)).alias("future"),
        F.min("truth").alias("least"),
        F.max("truth").alias("most"),
        (F.min("born") == F.max("born")).alias("one_birth"),
        F.size(F.collect_set("sex")).alias("n_sexes"),
        F.min("sex").alias("sex"),
        F.array_sort(F.collect_list("fact_id")).alias("fact_ids"),
    )
    k = F.col("rule_kind")
    disagree = (
        F.when(k == "age", ~F.col("one_birth"))
        .when(k == "recorded_sex", (F.col("n_sexes") != 1) | (F.col("n") != 1))
        .otherwise(F.col("least") != F.col("most"))
    )
    reason = (
        F.when(F.col("conflict"), "conflicting_evidence")
        .when(F.col("issue"), "unusable_evidence")
        .when(F.col("n") == 0, "missing_evidence")
        .when(F.col("flaw").isNotNull(), F.col("flaw"))
        .when(F.col("future"), "future_date")
        .when(F.coalesce(disagree, F.lit(False)), "conflicting_evidence")
        .when((k == "recorded_sex") & ~F.col("sex").isin("male", "female"), "unusable_evidence")
        .when((k == "age") & F.col("least").isNull(), "ambiguous_age")
        .when(F.col("least"), "predicate_matched")
        .otherwise("predicate_not_matched")
    )
    matched = F.col("reason") == "predicate_matched"
    decided = F.col("reason").isin("predicate_matched", "predicate_not_matched")
    outcome = (
        F.when(F.col("reason") == "conflicting_evidence", "conflicting")
        .when(~decided, "unknown")
        .when(matched == (F.col("category") == "inclusion"), "met")
        .otherwise("not_met")
    )
    return found.withColumn("reason", reason).select(
        "match_id", "criterion_id", "category", outcome.alias("outcome"), "reason", F.col("fact_ids").alias("evidence_fact_ids"), (~decided).alias("requires_review")
    )


def outcome_of(category: str, outcome: str, open_case: Column) -> Column:
    """The outcome of a group: open cases need review, then exclusions, then unmet inclusions."""
    unmet = lambda c: F.coalesce(F.bool_or((F.col(category) == c) & (F.col(outcome) == "not_met")), F.lit(False))
    return F.when(open_case, "needs_review").when(unmet("exclusion"), "likely_excluded").when(unmet("inclusion"), "not_relevant").otherwise("potential_match")


def aggregate_matches(matches: DataFrame, criteria: DataFrame, results: DataFrame) -> DataFrame:
    """match_id and outcome. Incomplete, unknown, conflicting or review-bound results need review.

    criteria: match_id, criterion_id, requires_human_review. A match without criteria needs review.
    """
    wanted = criteria.select("match_id", "criterion_id", F.col("category"), "requires_human_review", F.lit(True).alias("wanted"))
    given = results.select("match_id", "criterion_id", F.col("outcome"), "requires_review", F.lit(True).alias("given"))
    both = matches.select("match_id").join(wanted.join(given, ["match_id", "criterion_id"], "full_outer"), "match_id", "left")
    not_sure = (
        F.col("wanted").isNull() | F.col("given").isNull() | F.coalesce("requires_human_review", F.lit(False))
        | F.coalesce("requires_review", F.lit(False)) | F.coalesce(F.col("outcome").isin("unknown", "conflicting"), F.lit(False))
    )
    return both.groupBy("match_id").agg(outcome_of("category", "outcome", F.bool_or(not_sure)).alias("outcome"))


def evidence_problems(results: DataFrame, facts: DataFrame) -> DataFrame:
    """Evidence ids that no fact has, ids listed twice, and decided results without evidence."""
    listed = results.select("match_id", "criterion_id", F.explode("evidence_fact_ids").alias("fact_id"))
    missing = listed.join(facts.select("fact_id"), "fact_id", "left_anti").select("match_id", "criterion_id", F.lit("missing_fact").alias("problem"))
    twice = results.where(F.size(F.array_distinct("evidence_fact_ids")) != F.size("evidence_fact_ids")).select("match_id", "criterion_id", F.lit("duplicate_fact").alias("problem"))
    bare = results.where((F.col("outcome") != "unknown") & (F.size("evidence_fact_ids") == 0)).select("match_id", "criterion_id", F.lit("no_evidence").alias("problem"))
    return missing.unionByName(twice).unionByName(bare).distinct()
