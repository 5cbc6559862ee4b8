"""Patient bundles to quality-flagged facts.

bundles: import_id, bundle (JSON text), evaluated_at. One bundle is one row until its entries are exploded;
facts carry ``ordinal``, their place in the reference order (demographics, conditions, observations,
medication statements, medication requests, procedures, allergies).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlark.functions import dates as D
from siftlark.functions import variants as V
from siftlark.functions.hashing import fact_id
from siftlark.functions.text import first_non_blank
from siftlark.sources.shared import stored

# Identifiers of the record format.
PATIENT_SYSTEM = "http://hl7.org/fhir/StructureDefinition/Patient"
RESOURCE_ID = r"^[A-Za-z0-9.-]{1,64}$"
KINDS = {
    "Condition": ("condition", 1), "Observation": ("observation", 2), "MedicationStatement": ("medication", 3),
    "MedicationRequest": ("medication", 4), "Procedure": ("procedure", 5), "AllergyIntolerance": ("allergy", 6),
}


def is_marked(bundle: Column, system: str, code: str) -> Column:
    """Whether the top-level tags hold the exact synthetic-data marker."""
    tags = V.items(bundle, "$.meta.tag")
    marked = F.exists(tags, lambda t: (V.text(t, "$.system") == system) & (V.text(t, "$.code") == code))
    return F.coalesce((V.text(bundle, "$.resourceType") == "Bundle") & marked, F.lit(False))


def _resources(parsed: DataFrame) -> DataFrame:
    return parsed.select("import_id", "evaluated_at", F.posexplode(V.items(F.col("doc"), "$.entry")).alias("entry_no", "entry")).select(
        "import_id", "evaluated_at", "entry_no", V.text(F.col("entry"), "$.fullUrl").alias("full_url"), V.at(F.col("entry"), "$.resource").alias("r")
    ).withColumn("type", V.text(F.col("r"), "$.resourceType"))


def _source_date(r: Column, kind: Column) -> Column:
    return (
        F.when(kind == "Condition", V.text(r, "$.onsetDateTime"))
        .when(kind == "Observation", V.text(r, "$.effectiveDateTime"))
        .when(kind == "MedicationStatement", first_non_blank(V.text(r, "$.effectiveDateTime"), V.text(r, "$.dateAsserted")))
        .when(kind == "MedicationRequest", V.text(r, "$.authoredOn"))
        .when(kind == "Procedure", first_non_blank(V.text(r, "$.performedDateTime"), V.text(r, "$.performedPeriod.start")))
        .when(kind == "AllergyIntolerance", V.text(r, "$.recordedDate"))
    )


def _codings(r: Column, path: str) -> Column:
    """Usable codings in order: those with a system and a code; the concept's text stands in for a display."""
    fallback = V.text(r, f"{path}.text")
    usable = F.filter(V.items(r, f"{path}.coding"), lambda c: V.text(c, "$.system").isNotNull() & V.text(c, "$.code").isNotNull())
    return F.transform(usable, lambda c: F.struct(V.text(c, "$.system").alias("system"), V.text(c, "$.code").alias("value"), F.coalesce(V.text(c, "$.display"), fallback).alias("display")))


def _coded_status(r: Column, path: str) -> Column:
    return F.get(F.filter(F.transform(V.items(r, f"{path}.coding"), lambda c: V.text(c, "$.code")), lambda c: c.isNotNull()), 0)


def _ranges(r: Column) -> Column:
    side = lambda x, s: F.when(V.number(x, f"$.{s}.value").isNotNull(), F.struct(V.number(x, f"$.{s}.value").alias("value"), V.text(x, f"$.{s}.unit").alias("unit")))
    built = F.transform(V.items(r, "$.referenceRange"), lambda x: F.struct(side(x, "low").alias("low"), side(x, "high").alias("high"), V.text(x, "$.text").alias("text")))
    return F.filter(built, lambda x: x["low"].isNotNull() | x["high"].isNotNull() | x["text"].isNotNull())


def _issue(code: str | Column, field: str) -> Column:
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(field).alias("field"))


def check_bundles(bundles: DataFrame, marker: tuple[str, str]) -> DataFrame:
    """import_id and why a bundle cannot be imported (null: it can)."""
    parsed = bundles.select("import_id", "evaluated_at", F.try_parse_json("bundle").alias("doc"))
    resources = stored(_resources(parsed), "checked_entries")
    patient = resources.where("type = 'Patient'").groupBy("import_id").agg(
        F.count("*").alias("n_patients"), F.min(V.text(F.col("r"), "$.id")).alias("patient_id"), F.min("full_url").alias("patient_url")
    )
    linked = resources.where(F.col("type").isin(*KINDS)).join(patient, "import_id")
    field = F.when(F.col("type") == "AllergyIntolerance", V.text(F.col("r"), "$.patient.reference")).otherwise(V.text(F.col("r"), "$.subject.reference"))
    known = F.array_contains(F.array(F.col("patient_id"), F.concat(F.lit("Patient/"), "patient_id"), F.coalesce("patient_url", "patient_id")), field)
    concept = F.when(F.col("type").isin("MedicationStatement", "MedicationRequest"), F.size(_codings(F.col("r"), "$.medicationCodeableConcept"))).otherwise(F.size(_codings(F.col("r"), "$.code")))
    # Observations without a number never become facts, so only their numbers bind them to a coding.
    factual = (F.col("type") != "Observation") | V.number(F.col("r"), "$.valueQuantity.value").isNotNull()
    flaw = (
        F.when(factual & ~F.coalesce(known, F.lit(False)), "foreign_reference")
        .when(~F.coalesce(V.text(F.col("r"), "$.id").rlike(RESOURCE_ID), F.lit(False)), "invalid_resource_id")
        .when(factual & (concept == 0), "uncoded_resource")
    )
    flaws = linked.select("import_id", flaw.alias("flaw")).where("flaw IS NOT NULL").groupBy("import_id").agg(F.min("flaw").alias("flaw"))
    return parsed.join(patient, "import_id", "left").join(flaws, "import_id", "left").select(
        "import_id",
        F.when(F.col("doc").isNull(), "invalid_json")
        .when(~is_marked(F.col("doc"), *marker), "not_marked_synthetic")
        .when(F.coalesce("n_patients", F.lit(0)) != 1, "not_one_patient")
        .when(~F.coalesce(F.col("patient_id").rlike(RESOURCE_ID), F.lit(False)), "invalid_patient_id")
        .otherwise(F.col("flaw")).alias("problem"),
    )


def normalize_bundles(bundles: DataFrame) -> DataFrame:
    """Facts of accepted bundles with quality issues."""
    # Entries are parsed once and written; patients and coded resources both read them.
    resources = stored(_resources(bundles.select("import_id", "evaluated_at", F.parse_json("bundle").alias("doc"))), "bundle_entries")
    r, kind = F.col("r"), F.col("type")
    patients = resources.where("type = 'Patient'").select("import_id", "evaluated_at", V.text(r, "$.id").alias("patient_id"), "r")
    given = lambda code, path: F.struct(F.lit(code).alias("code"), V.text(r, path).alias("text"))
    demographics = (
        patients.select("*", F.posexplode(F.array(given("administrative-gender", "$.gender"), given("birth-date", "$.birthDate"))).alias("i", "d"))
        .where("d.text IS NOT NULL")
        .select(
            "import_id", "evaluated_at", "patient_id", F.lit("demographic").alias("kind"), F.lit("Patient").alias("resource_type"), F.col("patient_id").alias("resource_id"),
            V.text(r, "$.meta.versionId").alias("version_id"), F.struct(F.lit(PATIENT_SYSTEM).alias("system"), F.col("d.code").alias("value"), F.lit(None).cast("string").alias("display")).alias("code"),
            F.col("d.code").alias("property"), F.struct(F.lit(0).alias("g"), F.lit(0).alias("e"), F.col("i").alias("c")).alias("ordinal"),
            F.col("d.text").alias("text"), F.when(F.col("d.code") == "birth-date", F.col("d.text")).alias("source_date"),
        )
    )
    group = F.create_map(*[x for k, (_, g) in KINDS.items() for x in (F.lit(k), F.lit(g))])
    name = F.create_map(*[x for k, (n, _) in KINDS.items() for x in (F.lit(k), F.lit(n))])
    number = V.number(r, "$.valueQuantity.value")
    codings = F.when(kind.isin("MedicationStatement", "MedicationRequest"), _codings(r, "$.medicationCodeableConcept")).otherwise(_codings(r, "$.code"))
    coded = (
        resources.where(kind.isin(*KINDS) & ((kind != "Observation") | number.isNotNull()))
        .join(patients.select("import_id", "patient_id"), "import_id")
        .select("*", F.posexplode(codings).alias("i", "code"))
        .select(
            "import_id", "evaluated_at", "patient_id", name[kind].alias("kind"), kind.alias("resource_type"), V.text(r, "$.id").alias("resource_id"),
            V.text(r, "$.meta.versionId").alias("version_id"), "code", F.concat(F.lit("coding-"), F.col("i").cast("string")).alias("property"),
            F.struct(group[kind].alias("g"), F.col("entry_no").alias("e"), F.col("i").alias("c")).alias("ordinal"),
            _source_date(r, kind).alias("source_date"), V.text(r, "$.status").alias("status"), V.text(r, "$.intent").alias("intent"),
            _coded_status(r, "$.clinicalStatus").alias("clinical_status"), _coded_status(r, "$.verificationStatus").alias("verification_status"),
            F.when(kind == "Observation", number).alias("numeric_value"), F.when(kind == "Observation", V.text(r, "$.valueQuantity.unit")).alias("unit"),
            F.when(kind == "Observation", _ranges(r)).alias("reference_ranges"),
        )
    )
    facts = demographics.unionByName(coded, allowMissingColumns=True)
    facts = facts.withColumn("date", D.partial_date(F.col("source_date"))).withColumn("fact_id", fact_id(F.col("import_id"), F.col("resource_type"), F.col("resource_id"), F.col("property")))
    # Values that disagree for one code and one source date are all flagged; sets are combined before the shuffle.
    twins = W.partitionBy("import_id", "patient_id", "code.system", "code.value", F.when((F.col("kind") == "observation") & F.col("date").isNotNull(), F.col("source_date")).otherwise(F.col("fact_id")))
    conflict = (F.col("kind") == "observation") & F.col("date").isNotNull() & (F.min("numeric_value").over(twins) != F.max("numeric_value").over(twins))
    dated = F.col("kind") != "demographic"
    observed = F.col("kind") == "observation"
    issues = F.array(
        F.when(dated & F.col("date").isNull(), _issue(F.when(F.col("source_date").isNotNull(), "invalid").otherwise("missing"), "date")),
        F.when(dated & D.is_stale(F.col("date.normalized_date"), F.to_date("evaluated_at")), _issue("stale", "date")),
        F.when(observed & F.col("unit").isNull(), _issue("missing", "valueQuantity.unit")),
        F.when(observed & F.col("status").isNull(), _issue("missing", "status")),
        F.when(F.coalesce(conflict, F.lit(False)), _issue("conflicting", "valueQuantity.value")),
    )
    return facts.withColumn("effective_at", F.when(dated, F.col("date.normalized_at"))).withColumn("quality_issues", F.filter(issues, lambda i: i.isNotNull()))


def conflicting_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``conflicting``: whether values of their group differ. Least and greatest value are combined before the shuffle, so a large group is no hot spot there."""
    groups = rows.groupBy(*keys).agg((F.min(value) != F.max(value)).alias("conflicting"))
    return rows.join(groups, keys)


def import_issues(bundles: DataFrame, facts: DataFrame) -> DataFrame:
    """Missing demographics, unusable observations and the issues of facts, in that order."""
    resources = _resources(bundles.select("import_id", "evaluated_at", F.parse_json("bundle").alias("doc")))
    r = F.col("r")
    rows = lambda d, group, pos, issue: d.select("import_id", F.struct(F.lit(group).alias("g"), pos.alias("p")).alias("ordinal"), issue["code"].alias("code"), issue["field"].alias("field"))
    people = resources.where("type = 'Patient'").select("import_id", F.posexplode(F.array(
        F.when(V.text(r, "$.gender").isNull(), _issue("missing", "gender")), F.when(V.text(r, "$.birthDate").isNull(), _issue("missing", "birthDate")))).alias("p", "x")).where("x IS NOT NULL")
    found = V.at(r, "$.valueQuantity")
    absent = found.isNull() | (V.kind(found) == "VOID")
    values = resources.where((F.col("type") == "Observation") & V.number(r, "$.valueQuantity.value").isNull()).select("import_id", "entry_no", _issue(F.when(absent, "missing").otherwise("invalid"), "valueQuantity.value").alias("x"))
    own = facts.select("import_id", (F.col("ordinal.g") * 1_000_000 + F.col("ordinal.e") * 100 + F.col("ordinal.c")).alias("fact_no"), F.posexplode("quality_issues").alias("i", "x"))
    return (
        rows(people, 0, F.col("p").cast("long"), F.col("x"))
        .unionByName(rows(values, 1, F.col("entry_no").cast("long"), F.col("x")))
        .unionByName(rows(own, 2, F.col("fact_no").cast("long") * 10 + F.col("i"), F.col("x")))
        .orderBy("import_id", "ordinal")
    )


def rule_facts(facts: DataFrame) -> DataFrame:
    """Facts in the form that rules read."""
    return facts.select(
        "patient_id", "import_id", "fact_id", "kind", F.struct("code.system", "code.value").alias("code"), "text", "numeric_value", "status", "unit", "effective_at",
        F.transform("quality_issues", lambda i: i["code"]).alias("issue_codes"),
    )


def source_resources(bundles: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts with the JSON of the bundle entry that they came from, found by import, type and id."""
    entries = _resources(bundles.select("import_id", "evaluated_at", F.parse_json("bundle").alias("doc")))
    named = entries.select("import_id", F.col("type").alias("resource_type"), V.text(F.col("r"), "$.id").alias("resource_id"), F.to_json("r").alias("source_resource"))
    return facts.join(named, ["import_id", "resource_type", "resource_id"], "left")
