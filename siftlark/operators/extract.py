"""Registry studies to searchable fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlark.functions import variants as V
from siftlark.functions.hashing import canonical_hash

NCT_ID = r"^NCT\d{8}$"
P = "$.protocolSection"


def _wrong(doc: Column, path: str, wanted: str) -> Column:
    """Present with another type than the wanted one."""
    found = V.kind(V.at(doc, path))
    return F.coalesce((found != wanted) & (found != "VOID"), F.lit(False))


def _texts(values: Column) -> Column:
    return F.transform(values, lambda x: V.text(x, "$"))


def extract_trials(studies: DataFrame, document: str = "raw_study") -> DataFrame:
    """All columns of ``studies`` with the trial's fields and ``problem`` (null if well formed). Absent is null or []."""
    d = F.col("doc")
    interventions = V.items(d, f"{P}.armsInterventionsModule.interventions")
    locations = V.items(d, f"{P}.contactsLocationsModule.locations")
    built = F.transform(interventions, lambda i: F.struct(V.text(i, "$.name").alias("name"), V.text(i, "$.type").alias("type"), V.text(i, "$.description").alias("description"), _texts(V.items(i, "$.otherNames")).alias("other_names")))
    places = F.transform(locations, lambda x: F.struct(*[V.text(x, f"$.{k}").alias(n) for k, n in (("facility", "facility"), ("status", "status"), ("city", "city"), ("state", "state"), ("zip", "postal_code"), ("country", "country"))]))
    modules = ("statusModule", "conditionsModule", "armsInterventionsModule", "designModule", "eligibilityModule", "contactsLocationsModule")
    lists = ("conditionsModule.conditions", "armsInterventionsModule.interventions", "designModule.phases", "contactsLocationsModule.locations")
    malformed = F.lit(False)
    for m in modules:
        malformed = malformed | _wrong(d, f"{P}.{m}", "OBJECT")
    for path in lists:
        malformed = malformed | _wrong(d, f"{P}.{path}", "ARRAY")
    for path in ("conditionsModule.conditions", "designModule.phases"):
        malformed = malformed | F.exists(_texts(V.items(d, f"{P}.{path}")), lambda x: x.isNull())
    posted = f"{P}.statusModule.lastUpdatePostDateStruct"
    day = F.try_to_date(V.text(d, f"{posted}.date"), "yyyy-MM-dd")
    state = (
        F.when(V.kind(V.at(d, P)).isNull() | (V.kind(V.at(d, P)) != "OBJECT"), "invalid")
        .when(V.at(d, f"{P}.statusModule").isNull() | V.at(d, posted).isNull(), "missing")
        .when(day.isNotNull(), "available")
        .otherwise("invalid")
    )
    nct = V.text(d, f"{P}.identificationModule.nctId")
    return studies.withColumn("doc", F.try_parse_json(document)).select(
        *studies.columns,
        nct.alias("nct_id"),
        F.coalesce(V.text(d, f"{P}.identificationModule.briefTitle"), V.text(d, f"{P}.identificationModule.officialTitle")).alias("title"),
        _texts(V.items(d, f"{P}.conditionsModule.conditions")).alias("conditions"),
        built.alias("interventions"),
        V.text(d, f"{P}.statusModule.overallStatus").alias("status"),
        _texts(V.items(d, f"{P}.designModule.phases")).alias("phases"),
        V.text(d, f"{P}.eligibilityModule.eligibilityCriteria").alias("eligibility_text"),
        V.text(d, f"{P}.eligibilityModule.minimumAge").alias("minimum_age"),
        V.text(d, f"{P}.eligibilityModule.maximumAge").alias("maximum_age"),
        V.text(d, f"{P}.eligibilityModule.sex").alias("sex"),
        places.alias("locations"),
        F.when(state == "available", day.cast("timestamp")).alias("source_updated_at"),
        state.alias("source_update_state"),
        F.when(d.isNull(), "invalid_json")
        .when(~F.coalesce(nct.rlike(NCT_ID), F.lit(False)), "invalid_nct_id")
        .when(malformed, "malformed_field")
        .when(F.exists(built, lambda i: i["name"].isNull()), "unnamed_intervention").alias("problem"),
    )


MATCHING = ("title", "conditions", "interventions", "status", "phases", "eligibility_text", "minimum_age", "maximum_age", "sex", "locations")


def with_hashes(trials: DataFrame, document: str = "raw_study") -> DataFrame:
    """source_hash of the whole document and matching_hash of the fields that matter for matching."""
    fields = F.to_json(F.struct("nct_id", F.struct(*MATCHING).alias("matching_fields")), {"ignoreNullFields": "false"})
    return trials.withColumn("source_hash", canonical_hash(F.col(document))).withColumn("matching_hash", canonical_hash(fields))


def metadata_of(trials: DataFrame) -> DataFrame:
    """All columns with countries (of locations) and intervention_types in first-seen order; blank values are skipped."""
    named = lambda values: F.array_distinct(F.filter(values, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
    return trials.withColumns({
        "countries": named(F.transform("locations", lambda x: x["country"])),
        "intervention_types": named(F.transform("interventions", lambda i: i["type"])),
    })


def embedding_document() -> Column:
    """Title, conditions, interventions (name, description, other names) and eligibility, blank parts left out; null if empty."""
    flat = F.transform("interventions", lambda i: F.concat_ws(" ", i["name"], i["description"], F.array_join(i["other_names"], " ")))
    parts = F.filter(F.array("title", F.array_join("conditions", " "), F.array_join(flat, " "), "eligibility_text"), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))
