"""Readers and writers."""

from __future__ import annotations

import zipfile

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STUDY_ID = r"^NCT\d{8}$"
MAX_PAGES = 10
# The studies of the demonstration collection.
DEMO_STUDIES = ("NCT02434107", "NCT01610531", "NCT00849407")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file: import_id (file name) and bundle."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("import_id"), F.col("value").alias("bundle"))


def read_zip_members(spark: SparkSession, path: str, suffix: str = ".xml", a_task: int = 2000) -> DataFrame:
    """archive, member_no, member, content of the members of ZIP archives, in archive order.

    The archives' directories are listed first, then ranges of at most ``a_task`` members are dealt to tasks, which read their
    members by position through Arrow's file systems. No archive is ever one row, whatever its size.
    """
    from pyarrow import fs

    def opened(archive: str):
        store, name = fs.FileSystem.from_uri(archive)
        return zipfile.ZipFile(store.open_input_file(name))

    def ranges(batches):
        for batch in batches:
            for archive in batch.column("path").to_pylist():
                with opened(archive) as source:
                    n = sum(x.endswith(suffix) for x in source.namelist())
                starts = list(range(0, n, a_task))
                yield pa.RecordBatch.from_pydict({"path": pa.array([archive] * len(starts), pa.string()), "first": pa.array(starts, pa.int64())})

    def members(batches):
        for batch in batches:
            for archive, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                with opened(archive) as source:
                    names = [x for x in source.namelist() if x.endswith(suffix)]
                    for number in range(first, min(first + a_task, len(names))):
                        body = source.read(names[number]).decode("utf-8")
                        yield pa.RecordBatch.from_pydict({"archive": [archive], "member_no": [number], "member": [names[number]], "content": [body]})

    files = spark.read.format("binaryFile").load(path).select("path")
    listed = files.mapInArrow(ranges, "path string, first long")
    return listed.repartition(spark.sparkContext.defaultParallelism, "path", "first").mapInArrow(members, "archive string, member_no long, member string, content string")


def parse_study_xml(members: DataFrame) -> DataFrame:
    """Trial fields of archive members; a member without an id is marked as a problem."""
    schema = (
        "struct<id_info:struct<nct_id:string>,brief_title:string,condition:array<string>,"
        "intervention:array<struct<intervention_name:string,description:string>>,eligibility:struct<criteria:struct<textblock:string>>>"
    )
    x = F.col("x")
    named = F.transform(F.coalesce(x["intervention"], F.array()), lambda i: F.struct(i["intervention_name"].alias("name"), F.lit(None).cast("string").alias("type"), i["description"].alias("description"), F.array().cast("array<string>").alias("other_names")))
    return members.withColumn("x", F.from_xml("content", schema)).select(
        F.trim(x["id_info"]["nct_id"]).alias("doc_id"),
        x["brief_title"].alias("title"),
        F.coalesce(x["condition"], F.array().cast("array<string>")).alias("conditions"),
        named.alias("interventions"),
        x["eligibility"]["criteria"]["textblock"].alias("eligibility_text"),
        F.when(F.coalesce(F.trim(x["id_info"]["nct_id"]), F.lit("")) == "", "missing_id").alias("problem"),
    )


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """query_id and text of the topics of an XML file."""
    found = spark.read.format("xml").option("rowTag", "topic").schema("_number string, _VALUE string").load(path)
    return found.select(F.col("_number").alias("query_id"), F.trim(F.regexp_replace("_VALUE", r"\s+", " ")).alias("text"))


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, grade of a four-column text; of repeated pairs the last line counts."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.size(parts) == 4).select(parts[0].alias("query_id"), parts[2].alias("doc_id"), parts[3].cast("int").alias("grade"), "line_no")
    return rows.where(F.col("grade").isin(0, 1, 2)).groupBy("query_id", "doc_id").agg(F.max_by("grade", "line_no").alias("grade"))


def page_range_problem(study_id: str | None, search: str | None, first: int | None, last: int | None) -> str | None:
    """Exactly one of a study, a search or a page range; a range has at most ``MAX_PAGES`` pages."""
    import re

    chosen = sum(x is not None for x in (study_id, search)) + (study_id is None and search is None and (first is not None or last is not None))
    if chosen != 1:
        return "choose exactly one of study, search or page range"
    if study_id is not None and not re.match(STUDY_ID, study_id):
        return "invalid study id"
    first, last = first or 1, last or first or 1
    return None if 1 <= first <= last <= MAX_PAGES else "invalid page range"


def read_study_pages(spark: SparkSession, path: str, first: int = 1, last: int = MAX_PAGES) -> DataFrame:
    """Studies of saved search pages (``page-N.json``): page_no and raw_study; a page whose studies are no array is an error row."""
    pages = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)[^/]*$", 1).cast("int").alias("page_no"), F.try_parse_json("value").alias("page")
    )
    listed = F.try_variant_get("page", "$.studies", "array<variant>")
    chosen = pages.where(F.col("page_no").between(first, min(last, MAX_PAGES)))
    return chosen.select("page_no", F.when(listed.isNull(), "invalid_page").alias("problem"), F.explode_outer(listed).alias("study")).select("page_no", "problem", F.to_json("study").alias("raw_study"))


def append_new(rows: DataFrame, path: str, keys: list[str], expected_order: str | None = None) -> int:
    """Append rows whose keys a Parquet table lacks; running it again adds nothing. Returns the rows added.

    Spark's committer makes the files visible when the whole job has succeeded; two loads into one table must not run at the same time. With ``expected_order`` the rows must rise strictly by that column from what the table holds.
    """
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(keys)
    try:
        held = spark.read.parquet(path)
    except AnalysisException:
        held = None
    if held is not None:
        fresh = fresh.join(held.select(*keys), keys, "left_anti")
        if expected_order is not None:
            last = held.agg(F.max(expected_order)).first()[0]
            if last is not None and not fresh.where(F.col(expected_order) <= last).isEmpty():
                raise ValueError(f"rows must follow {last} in {expected_order}")
    before = fresh.observe(seen := _observation(), F.count("*").alias("n"))
    before.write.mode("append").parquet(path)
    return seen.get["n"]


def load_empty(rows: DataFrame, path: str) -> int:
    """Fill a table that must not hold rows yet."""
    try:
        taken = not rows.sparkSession.read.parquet(path).isEmpty()
    except AnalysisException:
        taken = False
    if taken:
        raise ValueError(f"{path} is not empty")
    return append_new(rows, path, rows.columns[:1])


def demo_jobs(spark: SparkSession, requested_at: str) -> DataFrame:
    """The demonstration collection as queued jobs."""
    rows = [(f"demo-{no}", study, "sync", "queued", no) for no, study in enumerate(DEMO_STUDIES, 1)]
    jobs = spark.createDataFrame(rows, "job_id string, study_id string, kind string, status string, ordinal int")
    return jobs.withColumn("at", F.lit(requested_at).cast("timestamp"))


def read_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A frozen JSON dataset of one object; any other document is an error."""
    found = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"), "value")
    bad = found.where(F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False)) == F.lit(False))
    if not bad.isEmpty():
        raise ValueError(f"{path} holds a document that is no JSON object")
    return found.select(F.from_json("value", schema).alias("d")).select("d.*")


#: Vectors of a task that reads a file of vectors.
VECTORS_A_TASK = 100_000


def read_vectors(spark: SparkSession, path: str, dimensions: int, fields: tuple[str, ...] = ("full_text",)) -> DataFrame:
    """row_no, field and embedding of row-major float32 files ``<field>.f32``.

    Every record is one vector, so a file is dealt by ranges of ``VECTORS_A_TASK`` records, which tasks read through Arrow's file
    systems. A file that does not end with a whole record is an error.
    """
    width = 4 * dimensions

    def decode(batches):
        from pyarrow import fs

        for batch in batches:
            for field, file, first, n in zip(*(batch.column(c).to_pylist() for c in ("field", "file", "first", "n"))):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as source:
                    source.seek(first * width)
                    flat = np.frombuffer(source.read(n * width), "<f4")
                offsets = pa.array(np.arange(0, len(flat) + 1, dimensions, dtype=np.int32))
                rows = pa.array(np.arange(first, first + n, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([rows, pa.array([field] * n, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["row_no", "field", "embedding"])

    files = spark.read.format("binaryFile").load([f"{path}/{field}.f32" for field in fields])
    sized = files.select(F.regexp_extract("path", r"([^/]+)\.f32$", 1).alias("field"), F.col("path").alias("file"), "length")
    whole = F.when(F.col("length") % width == 0, F.col("length") / width).otherwise(F.raise_error(F.concat(F.lit("not a whole number of vectors: "), F.col("file")))).cast("long")
    counted = sized.withColumn("count", whole).where("count > 0")
    ranges = counted.select("field", "file", "count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(VECTORS_A_TASK).cast("long"))).alias("first"))
    dealt = ranges.select("field", "file", "first", F.least(F.lit(VECTORS_A_TASK), F.col("count") - F.col("first")).alias("n"))
    parted = dealt.repartition(spark.sparkContext.defaultParallelism, "field", "first")
    return parted.mapInArrow(decode, "row_no long, field string, embedding array<float>")


def marked_bundles(bundles: DataFrame, marker: tuple[str, str]) -> DataFrame:
    """Single-patient bundles that bear the synthetic-data tag, added where it is missing; all else of them stays.

    Others are left out, as are bundles whose ``meta`` is no object or whose ``meta.tag`` is no list.
    """
    resources = "filter(transform(cast(variant_get(doc, '$.entry') as array<variant>), e -> try_variant_get(e, '$.resource.resourceType', 'string')), t -> t = 'Patient')"
    parsed = bundles.withColumn("doc", F.try_parse_json("bundle")).where("doc IS NOT NULL AND try_variant_get(doc, '$.resourceType', 'string') = 'Bundle'")
    single = parsed.where(f"size({resources}) = 1")
    kind = lambda path: F.coalesce(F.regexp_extract(F.schema_of_variant(F.try_variant_get("doc", path, "variant")), r"^(\w+)", 1), F.lit(""))
    single = single.where(kind("$.meta").isin("", "OBJECT") & kind("$.meta.tag").isin("", "ARRAY"))
    tags = F.coalesce(F.try_variant_get("doc", "$.meta.tag", "array<variant>"), F.array().cast("array<variant>"))
    field = lambda t, name: F.try_variant_get(t, f"$.{name}", "string")
    marked = F.exists(tags, lambda t: F.coalesce((field(t, "system") == marker[0]) & (field(t, "code") == marker[1]), F.lit(False)))
    tag = F.parse_json(F.to_json(F.struct(F.lit(marker[0]).alias("system"), F.lit(marker[1]).alias("code"))))
    inner = lambda fields: F.regexp_replace(F.to_json(fields), r"^\{|\}$", "")
    joined = lambda *parts: F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ","), F.lit("}"))
    rest = F.map_filter(F.coalesce(F.try_variant_get("doc", "$.meta", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, v: k != "tag")
    meta = joined(inner(rest), F.concat(F.lit('"tag":'), F.to_json(F.concat(tags, F.array(tag)))))
    fields = F.map_filter(F.expr("variant_get(doc, '$', 'map<string,variant>')"), lambda k, v: k != "meta")
    body = joined(inner(fields), F.concat(F.lit('"meta":'), meta))
    return single.withColumn("bundle", F.when(marked, F.col("bundle")).otherwise(body)).drop("doc")


def write_report(report: DataFrame, path: str) -> None:
    """A small report as JSON lines in one file, keys in order."""
    report.select(*sorted(report.columns)).coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


def _observation():
    from pyspark.sql import Observation

    return Observation()


def write_index(documents: DataFrame, encode, path: str, dimensions: int) -> int:
    """Encode documents (doc_id, document) that the vector index lacks and append them: resumable by construction.

    ``encode`` maps a list of texts to vectors; an empty text gets the zero vector.
    """

    def encoded(batches):
        for batch in batches:
            texts = batch.column("document").to_pylist()
            vectors = [v if t else [0.0] * dimensions for t, v in zip(texts, encode([t or "" for t in texts]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(vectors, pa.list_(pa.float32()))], ["doc_id", "embedding"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return append_new(documents.select("doc_id", "document").mapInArrow(encoded, f"doc_id {kind}, embedding array<float>"), path, ["doc_id"])


def checksum_problems(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files of a manifest (name, sha256) that are missing or differ."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("found"))
    both = manifest.join(files, "name", "left")
    return both.where(~F.coalesce(F.col("found") == F.col("sha256"), F.lit(False))).select("name", F.when(F.col("found").isNull(), "missing").otherwise("changed").alias("problem"))
