"""Queries of readers, guards and loads over files that are written from the driver's tables, and the same rows in DuckDB SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlark.functions import table_functions
from siftlark.functions import text as T
from siftlark.operators import evaluation, extract, fhir, parser, review
from siftlark.plans import adapters as A
from siftlark.plans.evaluation_queries import bundles
from siftlark.plans.registry import PARSED_SQL, eligibility_texts, query
from siftlark.sources import loading, readers, writers
from siftlark.sources.shared import shared_path, stored

#: Studies of an archive, bundles of a folder's file and vectors of a file.
A_FILE = 500


def archives(spark, sf_dir) -> str:
    """Customers as study records, ``A_FILE`` keys to an archive; every seventh one lacks its id. Each archive has a file that is no record."""
    key = F.col("c_custkey")
    number = F.when(key % 7 != 0, F.concat(F.lit("<nct_id> NCT"), F.lpad(key.cast("string"), 8, "0"), F.lit(" </nct_id>"))).otherwise("")
    drug = F.concat(F.lit("<intervention><intervention_name>Drug "), (key % 5).cast("string"), F.lit("</intervention_name></intervention>"))
    body = F.concat(
        F.lit("<clinical_study><id_info>"), number, F.lit("</id_info><brief_title>Study of "), F.col("c_mktsegment"), F.lit("</brief_title><condition>"), F.col("c_mktsegment"),
        F.lit("</condition>"), F.when(key % 3 == 0, F.lit("<condition>Second &amp; last</condition>")).otherwise(""), drug,
        F.lit("<eligibility><criteria><textblock>Adults &lt; 90</textblock></criteria></eligibility></clinical_study>"),
    )
    archive = F.concat(F.lit("part-"), F.floor(key / A_FILE).cast("string"), F.lit(".zip"))
    rows = A.table(spark, sf_dir, "customer").select(archive.alias("archive"), key.alias("member_no"), F.concat(F.lit("d/"), F.lpad(key.cast("string"), 10, "0"), F.lit(".xml")).alias("member"), body.alias("content"))
    notes = rows.select("archive").distinct().select("archive", F.lit(-1).cast("long").alias("member_no"), F.lit("readme.txt").alias("member"), F.lit("no record").alias("content"))
    path = shared_path(spark, "archives")
    writers.write_archives(rows.withColumn("member_no", F.col("member_no").cast("long")).unionByName(notes), path)
    return path


STUDY_SQL = """SELECT CASE WHEN c_custkey % 7 <> 0 THEN 'NCT' || lpad(c_custkey::VARCHAR, 8, '0') END AS doc_id, 'Study of ' || c_mktsegment AS title,
    c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '|Second & last' ELSE '' END AS conditions, 'Drug ' || c_custkey % 5 AS intervention, 'Adults < 90' AS eligibility_text, CASE WHEN c_custkey % 7 = 0 THEN 'missing_id' END AS problem FROM customer"""


@query(STUDY_SQL)
def s7_zip_studies(spark, sf_dir):
    """Archives by ranges of their members, each member an XML study."""
    found = readers.parse_study_xml(readers.read_zip_members(spark, archives(spark, sf_dir), a_task=100))
    return found.select("doc_id", "title", F.array_join("conditions", "|").alias("conditions"), F.col("interventions")[0]["name"].alias("intervention"), "eligibility_text", "problem")


@query("""SELECT 'part-' || c_custkey // 500 || '.zip' AS archive, row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) - 1 AS member_no, 'd/' || lpad(c_custkey::VARCHAR, 10, '0') || '.xml' AS member FROM customer""")
def s7_zip_members_sql(spark, sf_dir):
    """The same archives through the table function, in SQL."""
    table_functions.register(spark)
    spark.read.format("binaryFile").load(archives(spark, sf_dir)).select("path").createOrReplaceTempView("s7_archives")
    return spark.sql(r"SELECT regexp_extract(a.path, '([^/]+)$', 1) AS archive, m.member_no, m.member FROM s7_archives a, LATERAL zip_members(a.path, '.xml') m")


@query(f"""WITH {PARSED_SQL} SELECT doc_id, category, source_text, source_start, source_start + length(source_text) AS source_end, operator, years, review_reasons FROM crits""")
def t9_parse_eligibility_sql(spark, sf_dir):
    """Criteria of a table of texts by the table function, in SQL."""
    table_functions.register(spark)
    eligibility_texts(spark, sf_dir).createOrReplaceTempView("t9_texts")
    found = spark.sql("SELECT * FROM parse_eligibility_of(TABLE(SELECT doc_id, eligibility_text FROM t9_texts))")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "category", "source_text", "source_start", "source_end", "operator", "years", F.array_join("review_reasons", ",").alias("review_reasons"))


@query(r"""SELECT item_id::VARCHAR AS query_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM benchmark""")
def s9_topics(spark, sf_dir):
    """Benchmark items as topics of an XML file."""
    path = shared_path(spark, "topics")
    items = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("_number"), F.concat(F.lit("\n  "), "text", F.lit("\n")).alias("_VALUE"))
    items.write.format("xml").option("rootTag", "topics").option("rowTag", "topic").save(path)
    return readers.read_topics(spark, path)


@query("""SELECT 't' || (doc_id % 40) AS query_id, 'd' || doc_id AS doc_id, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE quality + toxic END AS grade FROM labels WHERE NOT (doc_id % 9 <> 0 AND quality + toxic > 2)""")
def s10_judgments(spark, sf_dir):
    """Labels as lines of judgments, each ninth one corrected further below in its file; broken lines and unknown grades are passed over."""
    path, key = shared_path(spark, "judgments"), F.col("doc_id").cast("string")
    line = lambda grade: F.concat(F.lit("t"), (F.col("doc_id") % 40).cast("string"), F.lit(" 0\td"), key, F.lit("  "), grade)
    lines = F.concat_ws("\n", line((F.col("quality") + F.col("toxic")).cast("string")), F.when(F.col("doc_id") % 9 == 0, line(F.lit("0"))), F.lit("too short"), line(F.lit("7")))
    A.table(spark, sf_dir, "labels").select(lines.alias("value")).write.text(path)
    return readers.read_judgments(spark, path)


@query("""SELECT vec_id, md5(array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE, 6)::DECIMAL(18, 6)::VARCHAR), ',')) AS digest FROM embeddings""")
def s12_vectors(spark, sf_dir):
    """Vectors written as float32 files of ``A_FILE`` records, by id, and read back by ranges."""
    vectors = A.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / A_FILE).alias("part"))

    def write(key, table):
        rows = sorted(zip(table.column("vec_id").to_pylist(), table.column("embedding").to_pylist()))
        raw = np.array([v for _, v in rows], dtype="<f4").tobytes()
        return pa.table({"name": [f"part-{key[0].as_py()}.f32"], "content": pa.array([raw], pa.binary()), "ids": [[i for i, _ in rows]]})

    made = stored(vectors.groupBy("part").applyInArrow(write, "name string, content binary, ids array<long>"), "vector_files")
    path = shared_path(spark, "vectors")
    writers.write_files(made, path)
    names = [r.name.removesuffix(".f32") for r in made.select("name").collect()]
    ids = made.select(F.regexp_extract("name", r"^(.*)\.f32$", 1).alias("field"), F.posexplode("ids").alias("row_no", "vec_id"))
    found = readers.read_vectors(spark, path, 64, tuple(names)).join(ids, ["field", "row_no"])
    digits = F.transform("embedding", lambda x: F.round(x.cast("double"), 6).cast("decimal(18,6)").cast("string"))
    return found.select("vec_id", F.md5(F.array_join(digits, ",")).alias("digest"))


@query("""SELECT 's' || s_suppkey || '.json' AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'changed' ELSE 'missing' END AS problem FROM supplier WHERE s_suppkey % 5 IN (0, 1)""")
def p12_checksums(spark, sf_dir):
    """A file for every supplier, of which each fifth is not what the manifest says and the next one is not there."""
    key = F.col("s_suppkey")
    content = F.to_json(F.struct("s_suppkey", "s_name"))
    rows = stored(A.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key.cast("string"), F.lit(".json")).alias("name"), content.alias("content"), (key % 5).alias("state")), "files")
    path = shared_path(spark, "checked_files")
    writers.write_files(rows.where("state <> 1"), path)
    manifest = rows.select("name", F.sha2(F.when(F.col("state") == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")), 256).alias("sha256"))
    return readers.checksum_problems(spark, path, manifest)


@query("""SELECT 'i' || s_suppkey || '.json' AS import_id, CASE s_suppkey % 8 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'not_marked_synthetic' WHEN 2 THEN 'not_one_patient' WHEN 3 THEN 'invalid_patient_id' WHEN 4 THEN 'foreign_reference'
WHEN 5 THEN 'invalid_resource_id' WHEN 6 THEN 'uncoded_resource' END AS problem FROM supplier""")
def p1_bundle_guards(spark, sf_dir):
    """Bundles read from files of their own, each eighth one with the same fault, and the guard that finds it."""
    key, state = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 8
    patient = lambda name: F.concat(F.lit('{"resource":{"resourceType":"Patient","id":"'), name, F.lit('"}}'))
    one = patient(F.when(state == 3, F.lit("bad id!")).otherwise(F.concat(F.lit("p"), key)))
    people = F.when(state == 2, F.concat_ws(",", one, patient(F.lit("other")))).otherwise(one)
    subject = F.when(state == 4, F.lit("Patient/nobody")).when(state == 3, F.lit("bad id!")).otherwise(F.concat(F.lit("Patient/p"), key))
    coding = F.when(state == 6, F.lit("[]")).otherwise(F.lit('[{"system":"s","code":"c"}]'))
    condition = F.concat(
        F.lit('{"resource":{"resourceType":"Condition","id":"'), F.when(state == 5, F.lit("no id?")).otherwise("k1"), F.lit('","subject":{"reference":"'), subject, F.lit('"},"code":{"coding":'), coding, F.lit("}}}")
    )
    body = F.concat(F.lit('{"resourceType":"Bundle",'), F.when(state != 1, F.lit('"meta":{"tag":[{"system":"s","code":"synthetic"}]},')).otherwise(""), F.lit('"entry":['), people, F.lit(","), condition, F.lit("]}"))
    path = shared_path(spark, "bundle_files")
    writers.write_files(A.table(spark, sf_dir, "supplier").select(F.concat(F.lit("i"), key, F.lit(".json")).alias("name"), F.when(state == 0, F.lit("{broken")).otherwise(body).alias("content")), path)
    read = readers.read_bundles(spark, path).withColumn("evaluated_at", F.lit("2026-01-01").cast("timestamp"))
    return fhir.check_bundles(read, ("s", "synthetic")).select("import_id", "problem")


@query("SELECT o_orderkey, o_custkey FROM orders")
def s14_ordered_load(spark, sf_dir):
    """Orders loaded in the order of their keys, in two loads; a third one that starts over is refused."""
    path = shared_path(spark, "ordered_orders")
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    middle = rows.agg(F.floor((F.min("o_orderkey") + F.max("o_orderkey")) / 2)).first()[0]
    for part in (rows.where(F.col("o_orderkey") <= middle), rows.where(F.col("o_orderkey") > middle)):
        loading.load_in_order(part.orderBy("o_orderkey"), path, "o_orderkey")
    refused = False
    try:
        loading.load_in_order(rows.orderBy("o_orderkey"), path, "o_orderkey")
    except ValueError:
        refused = True
    return spark.read.schema(rows.schema).parquet(path).where(F.lit(refused))


@query("SELECT o_custkey, max(o_orderkey) % 2 AS load_no FROM (SELECT o_custkey, CASE WHEN bool_or(o_orderkey % 2 = 0) THEN 0 ELSE 1 END AS o_orderkey FROM orders GROUP BY o_custkey) GROUP BY o_custkey")
def s20_appended_keys(spark, sf_dir):
    """Customers of even orders, then those of all orders: the keys that each append added."""
    path = shared_path(spark, "appended")
    rows = A.table(spark, sf_dir, "orders").select("o_custkey", F.lit(1).alias("one"), "o_orderkey")
    first = loading.append_returning(rows.where("o_orderkey % 2 = 0").select("o_custkey", "one"), path, ["o_custkey"]).withColumn("load_no", F.lit(0))
    second = loading.append_returning(rows.select("o_custkey", "one"), path, ["o_custkey"]).withColumn("load_no", F.lit(1))
    return first.unionByName(second)


@query(f"""WITH {PARSED_SQL} SELECT doc_id, source_text, source_start + CASE WHEN doc_id % 4 = 0 THEN 1 WHEN doc_id % 4 = 1 THEN -100000 ELSE 0 END AS source_start FROM crits WHERE doc_id % 4 IN (0, 1)""")
def p6_span_problems(spark, sf_dir):
    """Spans of criteria, moved by a character or out of the text for half of the documents."""
    texts = eligibility_texts(spark, sf_dir)
    shift = F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, -100000).otherwise(0)
    moved = parser.parse_criteria(texts).withColumn("source_start", F.col("source_start") + shift)
    return parser.span_problems(moved.withColumn("source_end", F.col("source_end") + shift), texts).select("doc_id", "source_text", F.col("source_start").cast("long").alias("source_start"))


@query("""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform([lang, ' ' || lang || '  x ', source, '', source], lambda v: trim(regexp_replace(v, '\\s+', ' ', 'g'))), lambda v: v IS NOT NULL AND v <> ''))), ','), '') AS filtered,
concat_ws('-', CASE WHEN lang IS NOT NULL THEN lang END, CASE WHEN source IS NOT NULL AND source IS DISTINCT FROM lang THEN source END) AS joined, CASE WHEN doc_id % 3 = 0 THEN 'evidence_stale' ELSE 'legacy_reason_redacted' END AS reason FROM documents""")
def f6_values_and_reasons(spark, sf_dir):
    """Filter values, distinct joins and redacted reasons of every document."""
    values = F.filter(F.array("lang", F.concat(F.lit(" "), "lang", F.lit("  x ")), "source", F.lit(""), "source"), lambda v: v.isNotNull())
    rows = A.table(spark, sf_dir, "documents").select("doc_id", values.alias("v"), F.filter(F.array("lang", "source", "lang"), lambda v: v.isNotNull()).alias("d"), F.when(F.col("doc_id") % 3 == 0, "evidence_stale").otherwise(F.concat(F.lit("said by "), "source")).alias("why"))
    return rows.select("doc_id", F.array_join(T.filter_values(F.col("v")), ",").alias("filtered"), T.distinct_join(F.col("d"), "-").alias("joined"), review.redacted_reason("why").alias("reason"))


@query("""SELECT 'i' || k || ':' || t AS fact_id, coalesce(status, '') AS status, coalesce(clinical_status, '') AS clinical_status, display FROM (SELECT c_custkey AS k, unnest([{'t': 'Condition:k' || c_custkey, 's': NULL, 'c': CASE WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'resolved' END, 'd': NULL},
{'t': 'MedicationRequest:m' || c_custkey, 's': 'active', 'c': NULL, 'd': NULL}, {'t': 'Procedure:p' || c_custkey, 's': 'completed', 'c': NULL, 'd': NULL}]) AS x FROM customer) q, LATERAL (SELECT x.t || ':coding-0' AS t, x.s AS status, x.c AS clinical_status, x.d AS display)""")
def t12_coded_status(spark, sf_dir):
    """Statuses and displays of conditions, medications and procedures of every bundle."""
    facts = fhir.normalize_bundles(bundles(spark, sf_dir)).where("kind IN ('condition', 'medication', 'procedure')")
    return facts.select("fact_id", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("clinical_status", F.lit("")).alias("clinical_status"), F.col("code.display").alias("display"))


@query("""SELECT o_custkey AS topic, 'missing' AS problem FROM (SELECT unnest(range(1, 51)) AS o_custkey) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1 OR c_custkey > 20)
UNION ALL SELECT c_custkey, 'beside_protocol' FROM customer WHERE (c_custkey > 50 OR c_custkey < 1) AND (c_custkey % 2 = 1 OR c_custkey > 20) UNION ALL SELECT c_custkey, 'not_in_ranking_1' FROM customer WHERE c_custkey % 3 = 0 AND (c_custkey % 2 = 1 OR c_custkey > 20)""")
def u6_split_problems(spark, sf_dir):
    """Customers as topics, held against the protocol of fifty topics and a ranking that lacks every third one."""
    topics = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("topic")).where("topic % 2 = 1 OR topic > 20")
    return evaluation.split_problems(topics, topics.where("topic % 3 <> 0"))


def hashed_studies(spark, sf_dir) -> DataFrame:
    """Parts as studies with a field that does not matter for matching, and their hashes."""
    key = F.col("p_partkey").cast("string")
    module = F.struct(F.struct(F.concat(F.lit("NCT"), F.lpad(F.floor(F.col("p_partkey") / 2).cast("long").cast("string"), 8, "0")).alias("nctId"), F.lit("Title").alias("briefTitle")).alias("identificationModule"), F.struct(F.array("p_type").alias("conditions")).alias("conditionsModule"))
    body = F.to_json(F.struct(module.alias("protocolSection"), F.concat(F.lit("n"), key).alias("note")))
    studies = A.table(spark, sf_dir, "part").select(body.alias("raw_study"), "p_partkey")
    return extract.with_hashes(extract.extract_trials(studies)).select("nct_id", "source_hash", "matching_hash", "conditions")


@query("""SELECT 'NCT' || lpad((p_partkey // 2)::VARCHAR, 8, '0') AS nct_id, count(*) AS n_sources, count(DISTINCT p_type) AS n_matching FROM part GROUP BY 1""")
def h2_matching_hash(spark, sf_dir):
    """Two versions of each study: their sources differ, and what matters for matching differs only where the condition does."""
    return hashed_studies(spark, sf_dir).groupBy("nct_id").agg(F.count_distinct("source_hash").alias("n_sources"), F.count_distinct("matching_hash").alias("n_matching"))
