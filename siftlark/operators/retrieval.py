"""Candidate retrieval for many queries at once (F1-F9, J5-J8, A7-A9, K3-K5, Q3, Q5-Q7, Q11, W3-W7); whole runs are in ``matching``.

Tables
- documents: doc_id, title, conditions[], interventions[{name, type, description, other_names[]}], eligibility_text,
  and for filters status, phases[], countries[]
- terms: query_id, pos, text, fact_id, kind
Ranks are row numbers by score, ties by id, so that every result is reproducible. Top-k is a window with a
rank limit, which Spark evaluates before the shuffle as well (WindowGroupLimit).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftlark.functions import text as T
from siftlark.operators.nearest import Best, id_column, ids_of
from siftlark.sources.shared import uncounted

# Field weights of scoring, the constant of reciprocal rank fusion and the pool limits.
FIELD_WEIGHTS = {"conditions": 4, "title": 3, "interventions": 2, "eligibility": 1}
RRF_K = 60
#: Rows up to which a side of a join is broadcast, after they were counted.
BROADCAST_ROWS = 200_000
#: Best rows of all topics that a task may keep, and documents it scores at once.
KEPT_ROWS, DOCS_AT_ONCE = 1_000_000, 1024
LIMITS = {"lexical": 400, "semantic": 400, "fused": 250, "review": 100}
TIERS = {"conditions": 3, "interventions": 2, "title": 1}


def as_of(versions: DataFrame, instant: Column) -> DataFrame:
    """Versions visible at an instant: ingested by then and not yet superseded."""
    return versions.where((F.col("ingested_at") <= instant) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > instant)))


def build_query_terms(facts: DataFrame) -> DataFrame:
    """Terms of usable facts: active conditions, active medications, completed procedures."""
    issues = F.transform("quality_issues", lambda i: i["code"])
    stale_only = (F.col("kind") == "condition") & (F.col("value.clinical_status") == "active") & (F.array_distinct(issues) == F.array(F.lit("stale")))
    usable = (F.size("quality_issues") == 0) | stale_only
    wanted = (
        ((F.col("kind") == "condition") & (F.col("value.clinical_status") == "active"))
        | ((F.col("kind") == "medication") & (F.col("value.status") == "active"))
        | ((F.col("kind") == "procedure") & (F.col("value.status") == "completed"))
    )
    term = T.first_non_blank(F.col("code.display"), F.col("code.value"))
    return facts.where(usable & wanted).select(
        F.col("patient_id").alias("query_id"), F.col("ordinal").alias("pos"), term.alias("text"), "fact_id", "kind"
    )


def trial_fields(documents: DataFrame) -> DataFrame:
    """doc_id and the normalised text of each searched field."""
    flat = F.flatten(
        F.transform(
            F.coalesce("interventions", F.array()),
            lambda i: F.concat(F.filter(F.array(i["name"], i["description"]), lambda x: x.isNotNull()), F.coalesce(i["other_names"], F.array().cast("array<string>"))),
        )
    )
    return documents.select(
        "doc_id",
        T.normalize(F.coalesce("title", F.lit(""))).alias("title"),
        T.joined(F.col("conditions")).alias("conditions"),
        T.joined(flat).alias("interventions"),
        T.normalize(F.coalesce("eligibility_text", F.lit(""))).alias("eligibility"),
    )


def and_match(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id) where the document holds every word of the query; a query without words matches nothing. No word is an operator here."""
    from siftlark.operators import fulltext

    quoted = F.array_join(F.transform(T.words(T.normalize(F.coalesce("text", F.lit("")))), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")
    return fulltext.search(documents.select("doc_id", "text"), queries.select("query_id", quoted.alias("text"))).select("query_id", "doc_id")


def metadata_filter(statuses: Column, phases: Column, countries: Column, wanted: dict[str, list[str]], intervention_types: Column | None = None) -> Column:
    """Strict, case-folded; a filter that is not set passes everything, and one that is set rejects documents without its values."""
    if unknown := set(wanted) - {"statuses", "phases", "countries", "intervention_types"}:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    if wanted.get("intervention_types") and intervention_types is None:
        raise ValueError("a filter on intervention_types needs their column")
    fold = lambda a: F.transform(a, lambda x: T.normalize(x))
    fold_value = lambda v: " ".join(v.casefold().split())
    passed = F.lit(True)
    if wanted.get("statuses"):
        passed = passed & T.normalize(statuses).isin([fold_value(s) for s in wanted["statuses"]])
    for name, column in (("phases", phases), ("countries", countries), ("intervention_types", intervention_types)):
        if wanted.get(name):
            passed = passed & F.arrays_overlap(fold(column), F.array(*[F.lit(fold_value(v)) for v in wanted[name]]))
    return F.coalesce(passed, F.lit(False))


def score_fields(fields: DataFrame, terms: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Weighted field score of each (query, document) that any term matches by substring.

    Each term counts once, for its heaviest matching field. With a ``pool`` of (query_id, doc_id), only
    its pairs are scored; without one, all documents are read once by an automaton of all terms. Both are equi-joins.
    """
    from siftlark.operators.containment import terms_in

    term = T.normalize(F.col("term_text"))
    asked = terms.select("query_id", "pos", F.col("text").alias("term_text"), "fact_id").withColumn("term_text", term).where("term_text <> ''")
    order = sorted(FIELD_WEIGHTS, key=FIELD_WEIGHTS.get, reverse=True)
    if pool is None:
        hits = terms_in(fields, asked.select(F.col("term_text").alias("term")), order).withColumnRenamed("term", "term_text").join(asked, "term_text")
    else:
        best = F.coalesce(*[F.when(F.contains(F.col(f), F.col("term_text")), F.lit(f)) for f in order])
        hits = fields.join(uncounted(pool), "doc_id").join(uncounted(asked), "query_id").withColumn("field", best).where("field IS NOT NULL")
    return _scored_hits(hits, order)


def _scored_hits(hits: DataFrame, order: list[str]) -> DataFrame:
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(FIELD_WEIGHTS[f])) for f in order])
    ids = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fact_id"))), lambda x: x["fact_id"]))
    return hits.groupBy("query_id", "doc_id").agg(
        F.sum(weight.cast("double")).alias("score"),
        F.count("*").alias("matched_terms"),
        *[F.count_if(F.col("field") == f).alias(f"{f}_matches") for f in order],
        ids.alias("fact_ids"),
    )


def best_by_fields(fields: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """The rows of ``ranked(score_fields(fields, terms), limit)``, without scoring every document that a query matches (see ``top_terms``)."""
    from siftlark.operators import top_terms
    from siftlark.operators.containment import terms_in

    asked = terms.select("query_id", "pos", T.normalize(F.col("text")).alias("term_text"), "fact_id").where("term_text <> ''")
    order = sorted(FIELD_WEIGHTS, key=FIELD_WEIGHTS.get, reverse=True)
    hits = terms_in(fields, asked.select(F.col("term_text").alias("term")), order).withColumnRenamed("term", "term_text")
    documents, queries, rest = top_terms.split_hits(hits, asked, order)
    found = top_terms.best(documents, queries, [FIELD_WEIGHTS[f] for f in order], limit)
    of_hit = lambda place: F.size(F.filter("hit", lambda t: t["field"] == place)).cast("long")
    tids = F.transform("hit", lambda t: t["tid"])
    ids = F.array_distinct(F.transform(F.filter("listed", lambda t: F.array_contains(F.col("tids"), t["tid"])), lambda t: t["fact_id"]))
    found = found.withColumn("tids", tids).select(
        "query_id", "doc_id", "score", F.size("hit").cast("long").alias("matched_terms"), *[of_hit(i).alias(f"{f}_matches") for i, f in enumerate(order)], ids.alias("fact_ids")
    )
    if rest is not None:
        found = found.unionByName(_scored_hits(rest, order))
    return ranked(found, limit)


def ranked(scored: DataFrame, limit: int, score: str = "score", rank: str = "rank") -> DataFrame:
    """The first ``limit`` documents of each query by score, ties by id."""
    order = W.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= limit)


def coverage(versions: DataFrame, embedded: DataFrame) -> DataFrame:
    """How many current versions have an embedding; complete if all of at least one do."""
    counts = versions.join(embedded.select("version_id", F.lit(1).alias("has")), "version_id", "left").agg(F.count("*").alias("current"), F.count("has").alias("embedded"))
    return counts.withColumn("complete", (F.col("current") > 0) & (F.col("current") == F.col("embedded")))


def retrieval_mode(has_terms: Column, semantic: Column, covered: Column, encoder_ready: Column) -> Column:
    """hybrid, one of three lexical-only modes, or insufficient_evidence."""
    return (
        F.when(~has_terms, "insufficient_evidence")
        .when(~covered, "lexical_only_partial_semantic_catalogue")
        .when(~encoder_ready, "lexical_only_model_unavailable")
        .when(semantic == 0, "lexical_only_no_semantic_candidates")
        .otherwise("hybrid")
    )


def fuse_rrf(lexical: DataFrame, semantic: DataFrame, limit: int = LIMITS["fused"], weights: tuple[float, float] = (1.0, 1.0), k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, doc_id, rank)."""
    at = lambda d, s: d.select("query_id", "doc_id", F.col("rank").alias(f"{s}_rank"))
    ranks = at(lexical, "lexical").join(uncounted(at(semantic, "semantic")), ["query_id", "doc_id"], "full_outer")
    part = lambda s, w: F.coalesce(F.lit(w) / (k + F.col(f"{s}_rank")), F.lit(0.0))
    scored = ranks.withColumn("score", part("lexical", weights[0]) + part("semantic", weights[1]))
    return ranked(scored, limit)


def rerank_structured(fused: DataFrame, documents: DataFrame, terms: DataFrame, limit: int = LIMITS["review"]) -> DataFrame:
    """Order by structured support: a condition term in conditions 3, other terms in interventions 2, any in title 1.

    Support needs whole words in sequence. Documents without support keep their fused order (tier 0).
    """
    # Words are taken once from each document and term; what the pairs compare are finished strings.
    fields = trial_fields(documents).select("doc_id", *[T.padded(F.col(f)).alias(f) for f in TIERS])
    asked = terms.select("query_id", F.when(F.size(T.words(F.col("text"))) > 0, T.padded(F.col("text"))).alias("run"), "kind")
    near = fused.select("query_id", "doc_id", F.col("rank").alias("input_rank")).join(uncounted(fields), "doc_id").join(uncounted(asked), "query_id", "left")
    condition = F.coalesce(F.col("kind") == "condition", F.lit(False))
    tier = (
        F.when(condition & F.contains(F.col("conditions"), F.col("run")), TIERS["conditions"])
        .when(~condition & F.contains(F.col("interventions"), F.col("run")), TIERS["interventions"])
        .when(F.contains(F.col("title"), F.col("run")), TIERS["title"])
        .otherwise(0)
    )
    tiers = near.groupBy("query_id", "doc_id", "input_rank").agg(F.coalesce(F.max(tier), F.lit(0)).alias("tier"))
    order = W.partitionBy("query_id").orderBy(F.desc("tier"), "input_rank", "doc_id")
    status = F.when(F.col("tier") > 0, "direct_support").otherwise("unknown")
    return tiers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).withColumn("structured_status", status)


def token_overlap(fields: DataFrame, topics: DataFrame, weights: dict[str, float], limit: int) -> DataFrame:
    """Corpus-scale baseline: weight of each field times its tokens that the topic holds, by an inverted join on tokens.

    Where few topics are asked, tasks keep the best documents of each topic, so that memory does not grow with the documents;
    only ids of several rows, whose scores are sums over them, and missing ones are still scored by the join.
    """
    asked = topics.select("query_id", F.explode(T.token_set(F.col("text"))).alias("token"))
    rows = asked.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) <= BROADCAST_ROWS and len({r.query_id for r in rows}) * limit <= KEPT_ROWS:
        several = fields.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id")
        if several.isEmpty():
            return ranked(_best_overlaps(fields, rows, asked.schema["query_id"].dataType.simpleString(), weights, limit), limit)
        again = several.withColumnRenamed("doc_id", "several_id")
        same = F.col("doc_id").eqNullSafe(F.col("several_id"))
        best = _best_overlaps(fields.join(again, same, "left_anti"), rows, asked.schema["query_id"].dataType.simpleString(), weights, limit)
        return ranked(best.unionByName(_overlaps(fields.join(again, same, "left_semi"), F.broadcast(asked), weights)), limit)
    # Topics are few beside documents: if counted to be so, their tokens go to the documents, which then need no shuffle by token.
    return ranked(_overlaps(fields, F.broadcast(asked) if len(rows) <= BROADCAST_ROWS else asked, weights), limit)


def _overlaps(fields: DataFrame, asked: DataFrame, weights: dict[str, float]) -> DataFrame:
    """query_id, doc_id and score of all pairs that share a token."""
    exploded = None
    for field, weight in weights.items():
        part = fields.select("doc_id", F.explode(T.token_set(F.col(field))).alias("token"), F.lit(float(weight)).alias("weight"))
        exploded = part if exploded is None else exploded.unionByName(part)
    return exploded.join(asked, "token").groupBy("query_id", "doc_id").agg(F.sum("weight").alias("score"))


def _best_overlaps(fields: DataFrame, asked: list, kind: str, weights: dict[str, float], limit: int) -> DataFrame:
    """query_id, doc_id and score of the best documents of each topic in each task; every row of ``fields`` is a document of its own."""
    names = list(dict.fromkeys(r.query_id for r in asked))
    place = {name: at for at, name in enumerate(names)}
    tokens = sorted({r.token for r in asked})
    token_no = {token: at for at, token in enumerate(tokens)}
    pairs = np.array(sorted((token_no[r.token], place[r.query_id]) for r in asked), dtype=np.int64).reshape(-1, 2)
    told = fields.sparkSession.sparkContext.broadcast((names, tokens, np.searchsorted(pairs[:, 0], np.arange(len(tokens) + 1)), pairs[:, 1]))
    parts = list(weights.values())
    id_type = fields.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        names, tokens, starts, topics = told.value
        best, kinds = Best(len(names), limit), None
        every, held = np.arange(len(names)), pa.array(tokens, pa.string())
        for batch in batches:
            kinds = batch.schema.field("doc_id").type
            for low in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(low, DOCS_AT_ONCE)
                n, met = part.num_rows, []
                for at, weight in enumerate(parts):
                    column = part.column(f"tokens_{at}")
                    doc = np.repeat(np.arange(n), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                    no = pc.index_in(column.flatten(), value_set=held).fill_null(-1).to_numpy(zero_copy_only=False)
                    doc, no = doc[no >= 0], no[no >= 0]
                    sizes = starts[no + 1] - starts[no]
                    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    met.append((topics[np.repeat(starts[no], sizes) + inside], np.repeat(doc, sizes), np.full(sizes.sum(), float(weight))))
                topic, doc, weight = (np.concatenate(x) for x in zip(*met))

                def scores(mine, rows, low):
                    here = (topic >= mine[0]) & (topic <= mine[-1])
                    cell = (topic[here] - mine[0]) * n + doc[here]
                    found = np.bincount(cell, weight[here], len(mine) * n)
                    found[np.bincount(cell, minlength=len(found)) == 0] = -np.inf
                    return found.reshape(len(mine), n)

                best.add(every, ids_of(part.column("doc_id")), np.arange(n), scores)
        if kinds is not None and names:
            for q, d, score in best.rows():
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q], arrow_kind), id_column(d, kinds), pa.array(score)], ["query_id", "doc_id", "score"])

    arrow_kind = to_arrow_type(fields.sparkSession.createDataFrame([], f"query_id {kind}").schema["query_id"].dataType)
    rows = fields.select("doc_id", *[T.token_set(F.col(field)).alias(f"tokens_{at}") for at, field in enumerate(weights)])
    return rows.mapInArrow(scan, f"query_id {kind}, doc_id {id_type}, score double")


def weighted_fusion_sweep(lexical: DataFrame, semantic: DataFrame, weights: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """Fusion under every weight of a small table (config, w_lexical, w_semantic)."""
    at = lambda d, s: d.select("query_id", "doc_id", F.col("rank").alias(f"{s}_rank"))
    ranks = at(lexical, "lexical").join(at(semantic, "semantic"), ["query_id", "doc_id"], "full_outer")
    part = lambda s: F.coalesce(F.col(f"w_{s}") / (k + F.col(f"{s}_rank")), F.lit(0.0))
    scored = ranks.crossJoin(weights).withColumn("score", part("lexical") + part("semantic"))
    order = W.partitionBy("config", "query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
