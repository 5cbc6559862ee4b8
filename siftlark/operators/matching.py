"""Match runs of many patients at once: full-text and semantic pools, fusion, rerank, manifest, lifecycle and assembly.

Covers Q1, Q2, Q4, Q7-Q10, K1, K9, K11, J1-J4, J16, J17, L4-L6, A13, A15, D4, D5, F16, F17, F20, F21, H3, U5, U7, W7, W10, Q12.

Tables
- runs: query_id, as_of timestamp, vector array<float> (null: the encoder gave none), encoder_ready boolean
- terms: query_id, pos, text, fact_id, kind
- catalogue: doc_id, title, conditions[], interventions[], eligibility_text, ingested_at, superseded_at
- embeddings: doc_id, model, embedding array<float>
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftlark.functions import dates as D
from siftlark.functions import text as T
from siftlark.functions.hashing import canonical_hash
from siftlark.operators import fulltext, nearest, retrieval, rules
from siftlark.operators.rules import BIRTH_DATE, RECORDED_SEX, outcome_of
from siftlark.sources.shared import stored, uncounted

#: Query vectors that are compared with the catalogue in one scan.
BLOCK = 2048
# Names of methods and policies in stored records.
CATALOGUE_POLICY = "immutable-trial-version-as-of-v1"
FUSION, RERANKER = "reciprocal-rank-fusion-v1", "structured-evidence-reranker-v2"
RETRIEVAL_FIELDS = ("conditions", "title", "interventions", "eligibility")


def bounded(side: DataFrame, most: int = retrieval.BROADCAST_ROWS) -> DataFrame:
    """``side`` marked for broadcast if it was counted to be small, else kept from it."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else uncounted(side)


def visible(as_of: Column) -> Column:
    return (F.col("ingested_at") <= as_of) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > as_of))


# --- full-text candidates ------------------------------------------------------------------------


def lexical_candidates(documents: DataFrame, queries: DataFrame, limit: int = retrieval.LIMITS["lexical"]) -> DataFrame:
    """query_id, doc_id, cover_rank and rank of the best documents that a query finds and that its instant sees.

    documents: doc_id, strings (all strings of the record) or text, ingested_at, superseded_at; queries: query_id, text in the language of
    ``fulltext``, as_of. All matching documents are ranked before the limit; ties (to nine decimals) go to the smaller id.
    """
    return fulltext.search(documents, queries, limit)


# --- semantic candidates -------------------------------------------------------------------------


def _blocks(queries: DataFrame) -> Iterator[list]:
    """Rows of queries, written once, ``BLOCK`` of them or so at a time."""
    n = max(-(-queries.count() // BLOCK), 1)
    if n == 1:
        yield queries.collect()
        return
    written = stored(queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n))), "query_blocks")
    for block in range(n):
        yield written.where(F.col("block") == block).drop("block").collect()


def semantic_candidates(embeddings: DataFrame, queries: DataFrame, limit: int = retrieval.LIMITS["semantic"]) -> DataFrame:
    """query_id, doc_id, score and rank by cosine, exact, over what each query's instant sees.

    embeddings: doc_id, embedding, ingested_at, superseded_at; queries: query_id, vector, as_of. Queries are
    taken in blocks of ``BLOCK``; every block is one scan that compares batches of vectors with all its
    queries and passes on the best of each task. Vectors without length or of another size than the
    query's are no candidates. Scores equal to 12 decimals tie. What a task holds depends on ``BLOCK`` and ``limit``, on neither table (``nearest``).
    """
    spark, id_type = embeddings.sparkSession, embeddings.schema["doc_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    vectors_held = embeddings.select("doc_id", "embedding", F.unix_micros("ingested_at").alias("born"), F.unix_micros("superseded_at").alias("gone"))
    asked = queries.where("vector IS NOT NULL").select("query_id", "vector", F.unix_micros("as_of").alias("as_of"))
    found = None
    for rows in _blocks(asked):
        ids = [r.query_id for r in rows]
        vectors = [np.asarray(r.vector, dtype=float) for r in rows]
        sent = spark.sparkContext.broadcast((ids, vectors, np.array([r.as_of for r in rows], dtype=np.int64)))

        def scan(batches, sent=sent):
            ids, vectors, as_of = sent.value
            lengths = np.array([np.linalg.norm(v) for v in vectors])
            widths = np.array([len(v) for v in vectors])
            of_width = {w: np.flatnonzero((widths == w) & (lengths > 0)) for w in set(widths.tolist()) - {0}}
            units = {w: np.stack([vectors[i] / lengths[i] for i in at]) for w, at in of_width.items() if len(at)}
            row_of = np.zeros(len(ids), dtype=int)
            for at in of_width.values():
                row_of[at] = np.arange(len(at))
            kept, never = nearest.Best(len(ids), limit), np.iinfo(np.int64).max
            for batch in batches:
                size = batch.column("embedding").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                born, gone = (batch.column(c).fill_null(never).to_numpy(zero_copy_only=False) for c in ("born", "gone"))
                names = nearest.ids_of(batch.column("doc_id"))
                for width in set(size.tolist()) & units.keys():
                    at = np.flatnonzero(size == width)
                    flat = nearest.floats(batch.column("embedding").take(pa.array(at)), width)
                    norm = np.linalg.norm(flat, axis=1)

                    def scores(mine, part, low, at=at, norm=norm, width=width):
                        rows = slice(low, low + len(part))
                        with np.errstate(invalid="ignore", divide="ignore"):
                            found = np.round(units[width][row_of[mine]] @ part.T / norm[rows][None, :], 12)
                        seen = (born[at][rows][None, :] <= as_of[mine][:, None]) & (gone[at][rows][None, :] > as_of[mine][:, None])
                        return np.where(seen & np.isfinite(found), found, -np.inf)

                    kept.add(of_width[width], names[at], flat, scores)
            for q, d, s in kept.rows():
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()], type_of_query), nearest.id_column(d, type_of_doc), pa.array(s, pa.float64())], ["query_id", "doc_id", "score"])

        type_of_doc = to_arrow_type(embeddings.schema["doc_id"].dataType)
        type_of_query = pa.string() if query_type == "string" else pa.int64()
        part = retrieval.ranked(vectors_held.mapInArrow(scan, f"query_id {query_type}, doc_id {id_type}, score double"), limit)
        # More than one block: each is written before the next is planned.
        part = part if len(rows) < BLOCK // 2 and found is None else stored(part, "nearest")
        found = part if found is None else found.unionByName(part)
    return found


def embedded_catalogue(catalogue: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Versions with their embedding of one model."""
    return catalogue.join(uncounted(embeddings.where(F.col("model") == model).select("doc_id", "embedding")), "doc_id")


def coverage_at(catalogue: DataFrame, embedded: DataFrame, instants: DataFrame) -> DataFrame:
    """as_of, current and embedded versions, and whether all of at least one are embedded, for any number of instants.

    A sweep over time: each version adds one when it comes and takes one when it goes, so the counts at an instant are
    sums of all that was before. Steps and instants are sorted once, by ranges; each range sums its own rows and adds what the ranges before it hold.
    """
    asked = stored(instants.select(F.unix_micros("as_of").alias("t")).where("t IS NOT NULL").distinct(), "instants")
    has = embedded.select("doc_id").distinct().withColumn("has", F.lit(1))
    born, gone = F.unix_micros("ingested_at").alias("born"), F.unix_micros("superseded_at").alias("gone")
    alive = catalogue.select("doc_id", born, gone).where("born IS NOT NULL AND (gone IS NULL OR gone > born)").join(uncounted(has), "doc_id", "left")
    came = alive.select(F.col("born").alias("t"), F.lit(1).alias("n"), F.coalesce("has", F.lit(0)).alias("has"))
    went = alive.where("gone IS NOT NULL").select(F.col("gone").alias("t"), F.lit(-1).alias("n"), (-F.coalesce("has", F.lit(0))).alias("has"))
    steps = came.unionByName(went).groupBy("t").agg(F.sum("n").alias("n"), F.sum("has").alias("has"), F.lit(0).alias("ask"))
    both = steps.unionByName(asked.select("t", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("has"), F.lit(1).alias("ask")))
    ranges = int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    swept = stored(both.repartitionByRange(ranges, "t", "ask").withColumn("range", F.spark_partition_id()), "sweep")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # over as many rows as there are ranges
    sums = swept.groupBy("range").agg(F.sum("n").alias("n"), F.sum("has").alias("has"))
    carried = sums.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "has")])
    within = W.partitionBy("range").orderBy("t", "ask")
    counts = swept.join(F.broadcast(carried), "range").select(
        "t", "ask", *[(F.sum(c).over(within) + F.col(f"{c}_before")).alias(name) for c, name in (("n", "current"), ("has", "embedded"))]
    )
    found = counts.where("ask = 1").select(F.timestamp_micros("t").alias("as_of"), "current", "embedded")
    return found.withColumn("complete", (F.col("current") > 0) & (F.col("current") == F.col("embedded")))


def fielded_semantic(held: DataFrame, queries: DataFrame, fields: dict[str, tuple[int, int]], weights: dict[str, float], limit: int = retrieval.LIMITS["semantic"], by_rank: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank by dot products of the parts of the vectors that belong to fields.

    The score is the weighted sum of the fields' products, or of reciprocal ranks within each field's best ``limit``. Sums are made where the
    products are, and of each task, query and ranking only the best ``limit`` go on. held: doc_id, embedding; queries: query_id, vector.
    """
    spark, found = held.sparkSession, None
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {held.schema['doc_id'].dataType.simpleString()}, field string, score double"
    for rows in _blocks(queries.select("query_id", "vector")):
        sent = spark.sparkContext.broadcast(([r.query_id for r in rows], np.array([r.vector for r in rows], dtype=float).reshape(len(rows), -1)))

        def scan(batches, sent=sent):
            ids, asked = sent.value
            named = [name for name in fields if name in weights]
            kept = {name: nearest.Best(len(ids), limit) for name in (named if by_rank else [""])}
            every = np.arange(len(ids))
            for batch in batches if len(ids) else ():
                matrix = nearest.floats(batch.column("embedding"), asked.shape[1])
                dot = lambda name, mine, part: np.round(asked[mine, slice(*fields[name])] @ part[:, slice(*fields[name])].T, 12)
                for name, best in kept.items():
                    if by_rank:
                        scores = lambda mine, part, low, name=name: dot(name, mine, part)
                    else:
                        scores = lambda mine, part, low: sum(weights[n] * dot(n, mine, part) for n in named)
                    best.add(every, nearest.ids_of(batch.column("doc_id")), matrix, scores)
            for name, best in kept.items():
                for q, d, s in best.rows():
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()]), nearest.id_column(d, type_of_doc), pa.array([name] * len(d), pa.string()), pa.array(s)], ["query_id", "doc_id", "field", "score"])

        type_of_doc = to_arrow_type(held.schema["doc_id"].dataType)
        part = held.mapInArrow(scan, kinds)
        if by_rank:
            order = W.partitionBy("query_id", "field").orderBy(F.desc("score"), "doc_id")
            part = part.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
            weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("field")]
            part = part.groupBy("query_id", "doc_id").agg(F.sum(weight / (retrieval.RRF_K + F.col("place"))).alias("score"))
        part = retrieval.ranked(part.select("query_id", "doc_id", "score"), limit)
        part = part if len(rows) < BLOCK // 2 and found is None else stored(part, "fielded")
        found = part if found is None else found.unionByName(part)
    return found


# --- the run -------------------------------------------------------------------------------------


def searched_strings() -> Column:
    """The strings of a catalogue row, for one that does not bring all strings of its record as ``strings``."""
    text = F.array().cast("array<string>")
    listed = F.flatten(F.transform(F.coalesce("interventions", F.array()), lambda i: F.concat(F.array(i["name"], i["description"]), F.coalesce(i["other_names"], text))))
    return F.concat(F.array("title"), F.coalesce("conditions", text), listed, F.array("eligibility_text"))


def run_matches(
    runs: DataFrame,
    terms: DataFrame,
    catalogue: DataFrame,
    embedded: DataFrame,
    passes: Column | None = None,
    limits: dict[str, int] = retrieval.LIMITS,
    cancelled: Callable[[], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(candidates, stages) of all runs; see ``staged_run``."""
    return staged_run(runs, terms, catalogue, embedded, passes, limits, cancelled)[:2]


def staged_run(
    runs: DataFrame,
    terms: DataFrame,
    catalogue: DataFrame,
    embedded: DataFrame,
    passes: Column | None = None,
    limits: dict[str, int] = retrieval.LIMITS,
    cancelled: Callable[[], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(candidates, stages, rows of each stage by the name of its count) of all runs.

    candidates: query_id, doc_id, rank, tier, input_rank, structured_status and the scores that led there.
    stages: query_id, status, mode, degradation_reasons, the six stage counts and the coverage at the run's instant.
    ``passes`` is the metadata filter over catalogue columns; it applies after the pools were cut, as ranks
    do not depend on it. The semantic pool needs a complete catalogue and a ready encoder. Every stage is
    written once, and the next ones and the counts read it. ``cancelled`` gives the runs (query_id) that somebody has cancelled by now; it is asked
    between stages, and what such runs have so far goes no further.
    """

    def still(frame: DataFrame) -> DataFrame:
        return frame if cancelled is None else frame.join(cancelled().select("query_id").distinct(), "query_id", "left_anti")

    asked = terms.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    started = stored(runs.join(uncounted(asked), "query_id", "left").join(bounded(coverage_at(catalogue, embedded, runs)), "as_of"), "started")
    passed = uncounted(catalogue.where(F.lit(True) if passes is None else passes).select("doc_id"))
    strings = F.col("strings") if "strings" in catalogue.columns else searched_strings().alias("strings")
    texts = catalogue.select("doc_id", strings, "ingested_at", "superseded_at")

    pool = stored(lexical_candidates(texts, still(started).where("text IS NOT NULL"), limits["lexical"]), "lexical_pool")
    scored = retrieval.score_fields(retrieval.trial_fields(catalogue.join(uncounted(pool.select("doc_id").distinct()), "doc_id", "left_semi")), terms, pool.join(passed, "doc_id").select("query_id", "doc_id"))
    lexical = stored(retrieval.ranked(scored, limits["lexical"]), "lexical")
    ready = still(started).where("text IS NOT NULL AND complete AND encoder_ready")
    near = stored(semantic_candidates(embedded, ready, limits["semantic"]), "semantic_pool")
    # The rank within what passed the filter is the one that is fused.
    semantic = stored(retrieval.ranked(near.drop("rank").join(passed, "doc_id"), limits["semantic"]), "semantic")
    fused = stored(still(retrieval.fuse_rrf(lexical, semantic, limits["fused"])), "fused")
    final = stored(still(retrieval.rerank_structured(fused, catalogue, terms, limits["review"])), "reranked")

    kept = fused.select("query_id", "doc_id", "lexical_rank", "semantic_rank", F.col("score").alias("fusion_score"))
    scores = lexical.select("query_id", "doc_id", F.col("score").alias("lexical_score"), "matched_terms", *[f"{f}_matches" for f in RETRIEVAL_FIELDS], "fact_ids")
    cosine = semantic.select("query_id", "doc_id", F.col("score").alias("semantic_score"))
    candidates = final.join(uncounted(kept), ["query_id", "doc_id"]).join(uncounted(scores), ["query_id", "doc_id"], "left").join(uncounted(cosine), ["query_id", "doc_id"], "left")
    candidates = still(candidates.join(uncounted(terms.groupBy("query_id").agg(F.count("*").alias("query_term_count"))), "query_id", "left"))

    named = {"lexical_pool": pool, "lexical_after_filters": lexical, "semantic_pool": near, "semantic_after_filters": semantic, "fused": fused, "persisted": final}
    rows = None
    for name, frame in named.items():
        part = frame.select("query_id", F.lit(name).alias("stage"))
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy("query_id").agg(*[F.count_if(F.col("stage") == n).alias(n) for n in named])
    stages = started.join(uncounted(counts), "query_id", "left").select(
        "query_id", "as_of", F.col("text").isNotNull().alias("has_terms"), "complete", "encoder_ready", "current", "embedded", *[F.coalesce(n, F.lit(0)).alias(n) for n in named]
    )
    mode = retrieval.retrieval_mode(F.col("has_terms"), F.col("semantic_pool"), F.col("complete"), F.col("encoder_ready"))
    stages = stages.withColumn("mode", mode).withColumn("degradation_reasons", degradation_reasons(F.col("mode"))).withColumn("status", F.lit("completed"))
    if cancelled is not None:
        stopped = cancelled().select("query_id").distinct().withColumn("stopped", F.lit(True))
        stages = stages.join(stopped, "query_id", "left").withColumn("status", F.when(F.col("stopped"), "cancelled").otherwise("completed")).drop("stopped")
    return candidates, stages, named


def assess_matches(
    matches: DataFrame, runs: DataFrame, criteria: DataFrame, facts: DataFrame, cancelled: Callable[[], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(results, outcomes) of the criteria of every match.

    matches: query_id, doc_id; runs: query_id, import_id, as_of; criteria: doc_id, criterion_id, category, rule, requires_human_review; facts: of
    imports, as ``rules`` reads them. Only facts of the run's import count. What is asked often is evaluated once: the rules of all
    matches of an import on a day come down to distinct ones, and their results go out to every match and criterion that holds such a rule.
    results: query_id, doc_id, criterion_id, category, outcome, reason, evidence_fact_ids, requires_review. outcomes: query_id, doc_id, n_results, outcome;
    a match without criteria, or with one that cannot be decided, needs review.
    """

    def still(frame: DataFrame) -> DataFrame:
        return frame if cancelled is None else frame.join(cancelled().select("query_id").distinct(), "query_id", "left_anti")

    held = still(matches.select("query_id", "doc_id")).join(uncounted(runs.select("query_id", "import_id", F.to_date("as_of").alias("as_of"))), "query_id")
    rule_key = F.sha2(F.to_json(F.struct("category", "rule")), 256)
    keyed = criteria.select("doc_id", "criterion_id", "category", "rule", "requires_human_review", rule_key.alias("rule_key"))
    asked = stored(held.join(uncounted(keyed), "doc_id"), "asked_criteria")
    unit = F.concat_ws("|", "import_id", F.col("as_of").cast("string"))
    units = asked.select(unit.alias("match_id"), "import_id", "as_of", F.col("rule_key").alias("criterion_id"), "category", "rule").dropDuplicates(["match_id", "criterion_id"])
    told = stored(rules.evaluate_criteria(units, facts), "evaluated_rules")
    told = told.select(F.col("match_id").alias("unit"), F.col("criterion_id").alias("rule_key"), "outcome", "reason", "evidence_fact_ids", "requires_review")
    results = asked.withColumn("unit", unit).join(uncounted(told), ["unit", "rule_key"]).select(
        "query_id", "doc_id", "criterion_id", "category", "outcome", "reason", "evidence_fact_ids", (F.col("requires_review") | F.coalesce("requires_human_review", F.lit(False))).alias("requires_review")
    )
    results = still(results)
    both = held.select("query_id", "doc_id").join(uncounted(results), ["query_id", "doc_id"], "left")
    doubtful = F.bool_or(F.col("criterion_id").isNull() | F.col("requires_review") | F.col("outcome").isin("unknown", "conflicting"))
    outcomes = both.groupBy("query_id", "doc_id").agg(F.count("criterion_id").alias("n_results"), outcome_of("category", "outcome", doubtful).alias("match_outcome"))
    return results, still(outcomes)


def degradation_reasons(mode: Column) -> Column:
    why = (
        F.when(mode == "insufficient_evidence", "no_usable_retrieval_facts")
        .when(mode == "lexical_only_partial_semantic_catalogue", "semantic_vector_coverage_incomplete")
        .when(mode == "lexical_only_model_unavailable", "semantic_model_unavailable")
        .when(mode == "lexical_only_no_semantic_candidates", "semantic_branch_returned_no_candidates")
    )
    return F.when(why.isNull(), F.array().cast("array<string>")).otherwise(F.array(why))


def ranked_id_lists(lexical: DataFrame, semantic: DataFrame, fused: DataFrame, final: DataFrame) -> DataFrame:
    """query_id with the ids of each stage in order: the read-only view of a run, which stores nothing."""
    out = None
    for name, frame in (("lexical_ids", lexical), ("semantic_ids", semantic), ("hybrid_ids", fused), ("final_ids", final)):
        part = frame.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(name))
        out = part if out is None else out.join(uncounted(part), "query_id", "full_outer")
    return out


def documented_age(facts: DataFrame, on: str = "as_of") -> DataFrame:
    """patient_id and age_years, null unless exactly one flawless full birth date is documented. facts: patient_id, kind, code, text, issue_codes and the date ``on``."""
    full = (F.col("kind") == "demographic") & (F.col("code.value") == BIRTH_DATE) & (F.size("issue_codes") == 0) & (F.length("text") == 10)
    born = F.try_to_date(F.min("born"), "yyyy-MM-dd")
    rows = facts.withColumn("born", F.when(full, F.col("text")))
    return rows.groupBy("patient_id").agg(F.when(F.min("born") == F.max("born"), D.age_years(born, F.max(on))).alias("age_years"))


def documented_sex(facts: DataFrame) -> DataFrame:
    """patient_id and recorded_sex, null unless the flawless facts name exactly one of male and female."""
    said = T.collapse(F.lower("text"))
    known = (F.col("kind") == "demographic") & (F.col("code.value") == RECORDED_SEX) & (F.size("issue_codes") == 0) & said.isin("male", "female")
    rows = facts.withColumn("said", F.when(known, said))
    return rows.groupBy("patient_id").agg(F.when(F.min("said") == F.max("said"), F.min("said")).alias("recorded_sex"))


def build_queries(facts: DataFrame, terms: DataFrame, on: str = "as_of") -> DataFrame:
    """query_id, lexical_text, condition labels, age and sex of each patient with facts."""
    asked = terms.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("lexical_text"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "condition", F.struct("pos", "text")))), lambda x: x["text"]).alias("conditions"),
    )
    people = documented_age(facts, on).join(documented_sex(facts), "patient_id").withColumnRenamed("patient_id", "query_id")
    empty = F.array().cast("array<string>")
    return people.join(asked, "query_id", "left").select("query_id", F.coalesce("lexical_text", F.lit("")).alias("lexical_text"), F.coalesce("conditions", empty).alias("conditions"), "age_years", "recorded_sex")


def manifests(facts: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, the manifest of what the query used and left out, and its hash.

    facts: query_id, fact_id, kind, issue_codes. An omitted fact is given its issues, or else its kind as
    the reason.
    """
    used = terms.select("query_id", "fact_id", F.col("kind").alias("term_kind"), F.lit(True).alias("used"))
    both = facts.join(uncounted(used), ["query_id", "fact_id"], "left")
    reasons = F.when(F.size("issue_codes") > 0, F.array_sort("issue_codes")).otherwise(F.array(F.concat(F.lit("unsupported_retrieval_fact_kind:"), "kind")))
    out = F.col("used").isNull()
    found = both.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(~out, F.col("fact_id")))).alias("included_fact_ids"),
        F.array_sort(F.collect_list(F.when(out, F.col("fact_id")))).alias("omitted_fact_ids"),
        F.array_sort(F.collect_list(F.when(out, F.struct("fact_id", reasons.alias("why"))))).alias("why"),
        F.array_sort(F.collect_list("term_kind")).alias("term_kinds"),
    )
    manifest = F.struct("included_fact_ids", "omitted_fact_ids", F.map_from_entries("why").alias("omitted_fact_reasons"), "term_kinds")
    return found.select("query_id", manifest.alias("manifest")).withColumn("query_manifest_hash", canonical_hash(F.to_json("manifest")))


def executions(stages: DataFrame, manifests: DataFrame) -> DataFrame:
    """The stored record of each run: mode, reasons, manifest with hash, stage counts, coverage, catalogue instant."""
    counts = F.struct("lexical_pool", "lexical_after_filters", "semantic_pool", "semantic_after_filters", "fused", "persisted")
    return stages.join(uncounted(manifests), "query_id", "left").select(
        "query_id", "mode", "degradation_reasons", "query_manifest_hash", F.col("manifest").alias("query_manifest"), counts.alias("counts"),
        F.struct(F.col("current").alias("current_trials"), F.col("embedded").alias("embedded_trials")).alias("semantic_coverage"),
        F.struct("as_of", F.lit(CATALOGUE_POLICY).alias("policy")).alias("catalogue"),
    )


def review_safe(executed: DataFrame) -> DataFrame:
    """Run records as reviewers see them: fact ids become counts."""
    m = F.col("query_manifest")
    ids = lambda name: F.coalesce(F.size(m[name]), F.lit(0)).alias(name.removesuffix("_ids") + "_count")
    summary = F.when(m.isNotNull(), F.struct(ids("included_fact_ids"), ids("omitted_fact_ids"), F.coalesce(m["term_kinds"], F.array().cast("array<string>")).alias("term_kinds")))
    return executed.select("query_id", "mode", "degradation_reasons", "query_manifest_hash", "counts", "semantic_coverage", "catalogue", summary.alias("query_summary"))


def score_components(candidates: DataFrame) -> DataFrame:
    """query_id, doc_id and the four parts of a candidate's scores; a part with any value missing or out of range is null."""
    c = F.col
    whole = lambda name, least: c(name).isNotNull() & (c(name) >= least)
    fields = F.filter(F.array(*[F.when(c(f"{f}_matches") > 0, F.lit(f)) for f in RETRIEVAL_FIELDS]), lambda x: x.isNotNull())
    facts = F.array_distinct(F.filter(F.coalesce("fact_ids", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))
    lexical = whole("lexical_score", 0) & whole("matched_terms", 0) & whole("query_term_count", 0)
    semantic = c("semantic_score").between(-1.0, 1.0) & whole("semantic_rank", 1)
    fusion = (c("fusion_score") > 0) & whole("input_rank", 1)
    support = c("tier").between(0, 3) & whole("input_rank", 1) & whole("rank", 1) & c("structured_status").isin("direct_support", "unknown")
    part = lambda ok, *columns: F.when(F.coalesce(ok, F.lit(False)), F.struct(*columns))
    return candidates.select(
        "query_id",
        "doc_id",
        part(lexical, c("lexical_score").alias("score"), c("matched_terms").alias("matched_term_count"), "query_term_count", fields.alias("matched_fields"), facts.alias("matched_fact_ids")).alias("lexical"),
        part(semantic, c("semantic_score").alias("score"), c("semantic_rank").alias("rank")).alias("semantic"),
        part(fusion, F.lit(FUSION).alias("method"), c("fusion_score").alias("score"), c("input_rank").alias("rank"), F.lit(retrieval.RRF_K).alias("rank_constant")).alias("fusion"),
        part(support, F.lit(RERANKER).alias("method"), c("structured_status").alias("status"), c("tier").alias("support_tier"), "input_rank", "rank").alias("structured"),
    )


# --- lifecycle -----------------------------------------------------------------------------------


def latest_completed_imports(imports: DataFrame) -> DataFrame:
    """The last completed import of each patient by completion, then creation, then id."""
    order = F.struct("completed_at", "created_at", "import_id")
    return imports.where("status = 'completed'").groupBy("patient_id").agg(F.max_by("import_id", order).alias("import_id"))


def create_runs(requests: DataFrame, imports: DataFrame, limits: dict[str, int] = retrieval.LIMITS) -> DataFrame:
    """Queued runs of requests (run_id, patient_id, created_at) with their frozen configuration; ``problem`` says why there is none."""
    settings = F.struct(*[F.lit(v).alias(f"{k}_limit") for k, v in limits.items()], F.lit(retrieval.RRF_K).alias("rank_constant"), F.lit(FUSION).alias("fusion"), F.lit(RERANKER).alias("reranker"))
    missing = F.col("import_id").isNull()
    return requests.join(latest_completed_imports(imports), "patient_id", "left").select(
        "run_id", "patient_id", "import_id", "created_at", F.when(~missing, "queued").alias("status"), settings.alias("configuration"), F.when(missing, "no_completed_import").alias("problem")
    )


def new_cancellations(requests: DataFrame, runs: DataFrame, cancelled: DataFrame) -> DataFrame:
    """run_id of requests that are new and whose run is queued or running; asking twice adds nothing."""
    open_runs = runs.where(F.col("status").isin("queued", "running")).select("run_id")
    return requests.select("run_id").distinct().join(open_runs, "run_id", "left_semi").join(cancelled.select("run_id"), "run_id", "left_anti")


def not_cancelled(work: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Work of runs that nobody cancelled; asked again between stages, so a run stops at the next stage."""
    return work.join(cancelled.select("run_id"), "run_id", "left_anti")


def sync_summary(syncs: DataFrame, *keys: str) -> DataFrame:
    """The latest sync and the last success by (created_at, id). syncs: keys, sync_id, status, created_at, completed_at."""
    order = F.struct("created_at", "sync_id")
    done = F.col("status") == "completed"
    return syncs.groupBy(*keys).agg(F.max_by("sync_id", order).alias("latest_sync"), F.max_by("status", order).alias("latest_status"), F.max(F.when(done, F.col("completed_at"))).alias("last_success_at"))


# --- assembly ------------------------------------------------------------------------------------


def candidate_counts(runs: DataFrame, matches: DataFrame) -> DataFrame:
    counts = matches.groupBy("run_id").agg(F.count("*").alias("candidate_count"))
    return runs.join(counts, "run_id", "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))


def criteria_in_order(criteria: DataFrame) -> DataFrame:
    """Criteria with their place in the text: by start of the span, then id."""
    return criteria.withColumn("place", F.row_number().over(W.partitionBy("version_id").orderBy("source_start", "criterion_id")))


def assemble_results(matches: DataFrame, versions: DataFrame, results: DataFrame, criteria: DataFrame, corrections: DataFrame) -> DataFrame:
    """Matches in candidate order with their version and the displayed outcome over current criterion results.

    matches: match_id, run_id, version_id, candidate_rank; versions: version_id, title; results: result_id, match_id,
    criterion_id, outcome, requires_review; criteria: criterion_id, category; corrections: result_id,
    correction_id, created_at, corrected. A match whose version is missing is left out; one without
    results, or with a result that is bound to review or undecided, needs review.
    """
    last = corrections.groupBy("result_id").agg(F.max_by("corrected", F.struct("created_at", "correction_id")).alias("corrected"))
    current = results.join(criteria.select("criterion_id", "category"), "criterion_id").join(last, "result_id", "left").withColumn("current_outcome", F.coalesce("corrected", "outcome"))
    both = matches.join(versions.select("version_id", "title"), "version_id").join(current.select("match_id", "result_id", "category", "current_outcome", "requires_review"), "match_id", "left")
    doubtful = F.bool_or(F.col("result_id").isNull() | F.col("requires_review") | F.col("current_outcome").isin("unknown", "conflicting"))
    keys = ("run_id", "match_id", "version_id", "candidate_rank", "title")
    return both.groupBy(*keys).agg(F.count("result_id").alias("n_results"), outcome_of("category", "current_outcome", doubtful).alias("outcome"))


def detail_context(results: DataFrame, criteria: DataFrame, matches: DataFrame, runs: DataFrame, imports: DataFrame, facts: DataFrame, parser_runs: DataFrame) -> DataFrame:
    """Each result with its criterion, match, run, import, parser run (if any) and cited facts of that import.

    ``problem`` marks a criterion of another version than the match's, and cited facts that the import lacks.
    """
    chain = (
        results.join(criteria.withColumnRenamed("version_id", "criterion_version"), "criterion_id")
        .join(matches.select("match_id", "run_id", "version_id"), "match_id")
        .join(runs.select("run_id", "import_id"), "run_id")
        .join(imports.select("import_id", "patient_id"), "import_id")
        .join(parser_runs.select(F.col("version_id").alias("criterion_version"), "parser_version"), "criterion_version", "left")
    )
    cited = chain.select("result_id", "import_id", F.explode("evidence_fact_ids").alias("fact_id"))
    known = cited.join(facts.select("import_id", "fact_id", F.lit(True).alias("known")), ["import_id", "fact_id"], "left")
    evidence = known.groupBy("result_id").agg(F.count("*").alias("n_cited"), F.count("known").alias("n_known"))
    lost = F.coalesce(F.col("n_cited") > F.col("n_known"), F.lit(False))
    return chain.join(evidence, "result_id", "left").select(
        "result_id", "criterion_id", "match_id", "run_id", "import_id", "patient_id", "parser_version", F.coalesce("n_known", F.lit(0)).alias("n_evidence"),
        F.when(F.col("criterion_version") != F.col("version_id"), "criterion_of_other_version").when(lost, "evidence_not_in_import").alias("problem"),
    )
