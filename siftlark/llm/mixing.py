"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are counted into cells (source, language, topic) of token weight. Every sweep scales the
cells so that each margin in turn has its target share of the token budget, but no cell above what it holds:
such cells are taken whole, and the others of their category make up for them. Sweeps go on until no cell moves by
more than ``TOLERANCE`` of the budget, at most ``SWEEPS`` times. A category that holds less than its target is
infeasible: it is taken whole, and the others of its margin share what it lacks by their targets, so that every margin sums to the
budget. ``margins_report`` tells target, aim, available, expected and sampled share of every category, and whether its aim is met
beside those of the other margins.

The raked weight divided by what a cell holds is its documents' probability. Sampling is systematic: each
cell is cut by a hash of the id into strata of about ``STRATUM`` documents, which are ordered by length; a
document is taken where the running total of probabilities passes a whole number. So counts and
tokens of a stratum meet their expectation to within a document, and a sample is the same in every run.

All steps aggregate and join the table of cells, which is small beside the documents: a source with
a third of all rows is at most (languages x topics) cells after map-side aggregation, and its strata are as small as others.

Defined results
- A null or empty text has 0 tokens: it belongs to its cell and its probability is its cell's.
- A null source or language is the category ``(none)``.
- A margin's explicit targets apply to categories that are present; categories without one keep
  their observed share, and the margin is scaled to sum to 1. A tempered margin takes observed
  shares to a power.
- A cell without tokens has probability 1 if it cannot be scaled (nothing to balance).
- Rows of one id draw the same number, so repeated rows of a cell share their fate; an id whose rows lie in different cells is kept
  whole if one of them is drawn. Rows without an id draw by their text, so that many of them do not fall in one stratum.
- An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siftlark.llm.common import SPACE, materialize, text_of


@dataclass(frozen=True)
class Margin:
    """Targets of one column: explicit shares, or observed shares to the power ``temper``."""

    column: str
    shares: dict[str, float] = field(default_factory=dict)
    temper: float | None = None


MARGINS = (
    Margin("source", temper=0.5),
    Margin("lang", shares={"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}),
    Margin("topic", shares={"article": 0.55, "brief": 0.2, "long": 0.2, "markup": 0.04}),
)
BUDGET, SWEEPS, TOLERANCE, STRATUM, SEED = 0.5, 24, 1e-9, 1000, "mix-1"
#: Up to so many cells, counted, are raked on the driver; more are raked by aggregates and joins. Both give the same weights.
LOCAL_CELLS = 100_000
#: A cell is full from this share of its tokens.
FULL = 1 - 1e-9


def n_tokens() -> Column:
    """White-space separated words, the unit of weight."""
    return F.when(text_of().rlike(r"[^\x20\x09-\x0D]"), F.size(F.split(F.trim(F.regexp_replace(text_of(), SPACE, " ")), " "))).otherwise(0).cast("long")


def topic() -> Column:
    """A rule for a document's kind, in place of a topic model's label."""
    signs = F.length(F.regexp_replace(text_of(), r"[^#*$%&|<>]+", ""))
    return F.when(signs * 10 > F.col("n_tokens"), "markup").when(F.col("n_tokens") < 100, "brief").when(F.col("n_tokens") < 1000, "article").otherwise("long")


def targets(cells: DataFrame, margin: Margin) -> DataFrame:
    """Share of each category that is present, summing to 1."""
    seen = cells.groupBy(margin.column).agg(F.sum("tokens").alias("tokens"))
    total = F.lit(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] or 1)
    observed = F.col("tokens") / total
    if margin.temper is not None:
        wanted = F.pow(observed, F.lit(margin.temper))
    else:
        wanted = observed
        for name, share in margin.shares.items():
            wanted = F.when(F.col(margin.column) == name, F.lit(share)).otherwise(wanted)
    shares = materialize(seen.select(margin.column, wanted.alias("target")), "margin")
    whole = shares.agg(F.sum("target")).first()[0] or 1.0
    return shares.select(margin.column, (F.col("target") / F.lit(whole)).alias("target"))


def aims(cells: DataFrame, margin: Margin, goal: float) -> DataFrame:
    """Tokens aimed at in each category: its target of ``goal``, but no more than it holds; the others make up for that.

    Targets are raised to one level. It is found over categories in the order of what they hold for each share of target: with the first k
    of them taken whole, the others reach some level, and that grows as long as the next one could not follow. So it is the greatest of all.
    """
    held = cells.groupBy(margin.column).agg(F.sum("tokens").cast("double").alias("held")).join(targets(cells, margin), margin.column)
    order = W.orderBy(F.col("held") / F.col("target"), margin.column)  # over categories, of which there are few
    left = F.lit(goal) - F.coalesce(F.sum("held").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    levels = held.where("target > 0").withColumn("level", left / F.sum("target").over(order.rowsBetween(0, W.unboundedFollowing)))
    level = levels.agg(F.max("level")).first()[0]
    aim = F.col("held") if level is None else F.least("held", F.col("target") * F.lit(level))
    return held.select(margin.column, aim.alias("aim"))


def rake(cells: DataFrame, margins: tuple[Margin, ...] = MARGINS, sweeps: int = SWEEPS, budget: float = 1.0) -> DataFrame:
    """Cells with a weight in tokens, at most what each holds, whose margins meet their aims of ``budget`` of all tokens where they can."""
    goal = budget * float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    wanted = [(m.column, aims(cells, m, goal)) for m in margins]
    if cells.count() <= LOCAL_CELLS:
        return _rake_locally(cells, wanted, sweeps, budget, goal)
    weighed = cells.withColumn("weight", F.col("tokens") * F.lit(float(budget)))
    for _ in range(sweeps):
        moved = weighed.withColumn("before", F.col("weight"))
        for column, aim in wanted:
            full = F.col("weight") >= F.col("tokens") * F.lit(FULL)
            held = F.sum(F.when(full, F.col("weight")).otherwise(0.0))
            sums = moved.groupBy(column).agg(F.sum("weight").alias("whole"), held.alias("held")).join(aim, column)
            room = F.col("whole") - F.col("held")
            grown = F.least(F.col("tokens").cast("double"), F.col("weight") * (F.col("aim") - F.col("held")) / room)
            weight = F.when(F.col("whole") >= F.col("aim"), F.when(F.col("whole") > 0, F.col("weight") * F.col("aim") / F.col("whole")).otherwise(0.0)).when(~full & (room > 0), grown).otherwise(F.col("weight"))
            moved = materialize(moved.join(sums, column).withColumn("weight", weight).drop("whole", "held", "aim"), "raked")
        most = moved.agg(F.max(F.abs(F.col("weight") - F.col("before")))).first()[0]
        weighed = moved.drop("before")
        if most is None or most <= TOLERANCE * goal:
            break
    return weighed


def _rake_locally(cells: DataFrame, wanted: list[tuple[str, DataFrame]], sweeps: int, budget: float, goal: float) -> DataFrame:
    rows = cells.collect()
    schema = StructType([*cells.schema.fields, StructField("weight", DoubleType())])
    if not rows:
        return cells.sparkSession.createDataFrame([], schema)
    tokens = np.array([float(r.tokens or 0) for r in rows])
    weight = tokens * float(budget)
    sides = []
    for column, aim in wanted:
        found = {r[column]: r.aim for r in aim.collect()}
        place = {name: i for i, name in enumerate(found)}
        sides.append((np.array([place[r[column]] for r in rows]), np.array(list(found.values()), dtype=float)))
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(sweeps):
            before = weight
            for at, aim in sides:
                full = weight >= tokens * FULL
                whole = np.bincount(at, weight, len(aim))[at]
                held = np.bincount(at, np.where(full, weight, 0.0), len(aim))[at]
                due, room = aim[at], whole - held
                shrunk = np.where(whole > 0, weight * due / whole, 0.0)
                grown = np.where(~full & (room > 0), np.minimum(tokens, weight * (due - held) / room), weight)
                weight = np.where(whole >= due, shrunk, grown)
            if np.abs(weight - before).max() <= TOLERANCE * goal:
                break
    return cells.sparkSession.createDataFrame([(*r, float(w)) for r, w in zip(rows, weight)], schema)


def probabilities(raked: DataFrame) -> DataFrame:
    """Cells with the probability that gives each its raked weight."""
    return raked.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("tokens"))).otherwise(F.lit(1.0)))


def draw(text: Column) -> Column:
    """A number in [0, 1) from a text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "-"), text)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def draw_key() -> Column:
    """What a document's number is drawn from: its id, or its text."""
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("null-"), F.md5(text_of())))


def mix(docs: DataFrame, margins: tuple[Margin, ...] = MARGINS, budget: float = BUDGET) -> DataFrame:
    """doc_id, cell, tokens, probability and whether it is sampled, for every document."""
    return _mixed(docs, margins, budget).drop("draw_key")


def _mixed(docs: DataFrame, margins: tuple[Margin, ...], budget: float) -> DataFrame:
    category = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), category("source"), category("lang"), n_tokens().alias("n_tokens"), "text", draw_key().alias("draw_key"))
    rows = materialize(rows.select("doc_id", "source", "lang", topic().alias("topic"), "n_tokens", "draw_key"), "mix_rows")
    names = [m.column for m in margins]
    cells = materialize(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "cells")
    chances = materialize(probabilities(rake(cells, margins, budget=budget)), "chances").select(*names, "probability", "n_docs")
    placed = rows.join(chances, names).withColumn("drawn", draw(F.col("draw_key")))
    placed = placed.withColumn("stratum", F.floor(F.col("drawn") * F.ceil(F.col("n_docs") / F.lit(float(STRATUM)))))
    order = W.partitionBy(*names, "stratum").orderBy("n_tokens", "drawn", "doc_id")
    offset = draw(F.concat_ws("|", *names, F.col("stratum").cast("string")))
    passed = lambda place: F.floor(place * F.col("probability") + offset)
    place = F.dense_rank().over(order)
    sampled = passed(place) > passed(place - 1)
    return placed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), sampled.alias("sampled"), "draw_key")


def margins_report(mixed: DataFrame, margins: tuple[Margin, ...] = MARGINS, budget: float = BUDGET) -> DataFrame:
    """margin, category and its target, aim, available, expected and sampled share of the token budget.

    ``feasible``: the category holds its target. ``met``: raking reached its aim within a thousandth of the budget, beside the other margins.
    """
    taken = F.sum(F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)).alias("taken")
    expected = F.sum(F.col("n_tokens") * F.col("probability")).alias("expected")
    cells = materialize(mixed.groupBy(*[m.column for m in margins]).agg(F.sum("n_tokens").alias("tokens"), taken, expected), "mixed_cells")
    goal = budget * float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] or 1)
    share = lambda c: (F.sum(c) / F.lit(goal))
    found = None
    for m in margins:
        seen = cells.groupBy(m.column).agg(share("tokens").alias("available"), share("taken").alias("sampled"), share("expected").alias("expected"))
        both = seen.join(targets(cells, m), m.column).join(aims(cells, m, goal).withColumn("aim", F.col("aim") / F.lit(goal)), m.column)
        part = both.select(
            F.lit(m.column).alias("margin"), F.col(m.column).alias("category"), "target", "aim", "available", "expected", "sampled",
            (F.col("available") >= F.col("target")).alias("feasible"), (F.abs(F.col("expected") - F.col("aim")) <= 0.001).alias("met"),
        )
        found = part if found is None else found.unionByName(part)
    return found


def sample_documents(docs: DataFrame, margins: tuple[Margin, ...] = MARGINS, budget: float = BUDGET) -> DataFrame:
    """The sampled rows of ``docs``, with all their columns."""
    taken = _mixed(docs, margins, budget).where("sampled").select(F.col("draw_key").alias("taken_key")).distinct()
    return docs.join(taken, draw_key() == taken["taken_key"], "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(margins: tuple[Margin, ...] = MARGINS, budget: float = BUDGET, sweeps: int = SWEEPS) -> str:
    """The same in DuckDB SQL, a common table expression for every step."""
    names = ", ".join(m.column for m in margins)
    steps = [
        r"counted AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text,"
        r" len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents)",
        r"docs AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, coalesce(doc_id::VARCHAR, 'null-' || md5(text)) AS draw_key, CASE WHEN length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) * 10 > n_tokens THEN 'markup'"
        r" WHEN n_tokens < 100 THEN 'brief' WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS topic FROM counted)",
        f"cells AS MATERIALIZED (SELECT {names}, sum(n_tokens)::DOUBLE AS tokens, count(*) AS n_docs FROM docs GROUP BY ALL)",
        f"goal AS MATERIALIZED (SELECT {budget} * sum(tokens) AS goal FROM cells)",
    ]
    for m in margins:
        share = "tokens / (SELECT sum(tokens) FROM cells)"
        if m.temper is not None:
            wanted = f"pow(sum(tokens) / (SELECT sum(tokens) FROM cells), {m.temper})"
        else:
            cases = " ".join(f"WHEN {m.column} = '{k}' THEN {v}" for k, v in m.shares.items())
            wanted = f"CASE {cases} ELSE sum({share}) END"
        steps.append(f"want_{m.column} AS (SELECT {m.column}, {wanted} AS target FROM cells GROUP BY {m.column})")
        held = f"SELECT {m.column}, sum(tokens) AS held, any_value(target) / (SELECT sum(target) FROM want_{m.column}) AS target FROM cells JOIN want_{m.column} USING ({m.column}) GROUP BY {m.column}"
        steps.append(f"held_{m.column} AS MATERIALIZED ({held})")
        level = "(goal - coalesce(sum(held) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(target) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        steps.append(f"level_{m.column} AS (SELECT max(level) AS level FROM (SELECT *, {level} AS level FROM held_{m.column}, goal WHERE target > 0 WINDOW o AS (ORDER BY held / target, {m.column})))")
        steps.append(f"aim_{m.column} AS MATERIALIZED (SELECT {m.column}, coalesce(least(held, target * level), held) AS aim FROM held_{m.column}, level_{m.column})")
    steps.append(f"w0 AS (SELECT {names}, tokens, n_docs, tokens * {budget} AS weight FROM cells)")
    k = 0
    for _ in range(sweeps):
        for m in margins:
            full = f"weight >= tokens * {FULL!r}"
            sums = f"(SELECT *, sum(weight) OVER c AS whole, sum(CASE WHEN {full} THEN weight ELSE 0 END) OVER c AS held FROM w{k} WINDOW c AS (PARTITION BY {m.column}))"
            grown = "least(tokens, weight * (aim - held) / (whole - held))"
            weight = f"CASE WHEN whole >= aim THEN CASE WHEN whole > 0 THEN weight * aim / whole ELSE 0 END WHEN NOT ({full}) AND whole - held > 0 THEN {grown} ELSE weight END"
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT {names}, tokens, n_docs, {weight} AS weight FROM {sums} JOIN aim_{m.column} USING ({m.column}))")
            k += 1
    steps.append(f"chances AS (SELECT {names}, n_docs, CASE WHEN tokens > 0 THEN least(1.0, weight / tokens) ELSE 1.0 END AS probability FROM w{k})")
    drawn = lambda text: f"('0x' || substr(md5('{SEED}-' || {text}), 1, 13))::BIGINT / {float(1 << 52)}"
    steps.append(f"drawn AS (SELECT *, {drawn("draw_key")} AS d FROM docs JOIN chances USING ({names}))")
    steps.append(f"strata AS (SELECT *, floor(d * ceil(n_docs / {float(STRATUM)}))::BIGINT AS stratum FROM drawn)")
    steps.append(f"placed AS (SELECT *, dense_rank() OVER (PARTITION BY {names}, stratum ORDER BY n_tokens, d, doc_id) AS place, {drawn(f"concat_ws('|', {names}, stratum)")} AS off FROM strata)")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability, floor(place * probability + off) > floor((place - 1) * probability + off) AS sampled FROM placed"
    )


ORACLE = oracle()
