"""Quality rules by weak supervision: rules vote or abstain, EM estimates how far to trust each.

Main path: DataFrame functions only. Every document becomes counts, every rule a vote (1 good,
0 bad, null abstains), and the corpus a histogram of vote patterns with at most ``3 ** rules``
rows whatever its size. Expectation-maximisation runs on that histogram: the state carried from
step to step is one row of sums. The posterior then is a sum of per-rule log-likelihood ratios,
again a plain column expression.

The generative model has, for each rule, P(bad vote | bad) and P(bad vote | good) among documents
on which it votes, and abstention says nothing. Beta priors keep a rule that never fires, a
one-document corpus and an all-good corpus well defined, and bound each rule's rates so that the
two classes cannot swap.

Repeated five-word windows are compared by 64-bit hashes within one document.

Defined results
- Null and empty texts have no words: all counts 0, base failed, not kept.
- Null ``doc_id`` stays null; repeated rows are each scored; ties cannot arise.
- An empty table gives an empty result. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.llm.common import SPACE, materialize, text_of

WINDOW = 5

# Frequent function words of the corpus languages.
FUNCTION_WORDS = (
    "the of and to in is that for with on as by it be this are was der die das und ist nicht mit von den ein zu auf "
    "le la les de des et en un une que qui dans pour est el los las que y del se por con una para"
)


@dataclass(frozen=True)
class Rule:
    """A vote from the counts: bad where ``bad`` holds, else good where ``good`` holds, else none."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "n_symbols > 0.2 * n_words", "n_symbols <= 0.05 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    Rule("repeated_words", "n_repeat_words > 0.15 * n_words", "n_repeat_words <= 0.05 * n_words"),
    Rule("word_length", "word_chars > 16 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 12 * n_words"),
    Rule("length", "n_words < 15", "n_words >= 40"),
    Rule("capitals", "n_capitals > 0.4 * word_chars", "n_capitals <= 0.15 * word_chars"),
    Rule("exclamation", "n_exclamations > 0.2 * n_words", "n_exclamations <= 0.03 * n_words"),
    Rule("function_words", "n_words >= 40 AND n_function_words = 0", "n_function_words >= 0.05 * n_words"),
)


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules read, each over the whole text."""
    staged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("body")).select(
        "doc_id",
        "body",
        F.when(F.col("body").rlike(r"[^\x20\x09-\x0D]"), F.split(F.trim(F.regexp_replace("body", SPACE, " ")), " ")).otherwise(F.array().cast("array<string>")).alias("words"),
        F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    staged = staged.select("*", F.size("words").cast("long").alias("n_words"), _window_hashes("words").alias("hashes"))
    function_words = F.array(*[F.lit(w) for w in dict.fromkeys(FUNCTION_WORDS.split())])

    def kept_chars(pattern: str) -> Column:
        return F.length(F.regexp_replace("body", pattern, "")).cast("long")

    return staged.select(
        "doc_id",
        "n_words",
        kept_chars(SPACE).alias("word_chars"),
        kept_chars(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0)).otherwise(_covered("hashes")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        kept_chars(r"\P{Lu}+").alias("n_capitals"),
        kept_chars(r"[^!]+").alias("n_exclamations"),
        F.size(F.filter("words", lambda w: F.array_contains(function_words, w))).cast("long").alias("n_function_words"),
    )


def _window_hashes(words: str) -> Column:
    """A hash of each window of five words, by position."""
    last = F.size(words) - WINDOW
    at = lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(WINDOW)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: str) -> Column:
    """Positions of words inside windows that occur twice or more: sort windows, keep runs, add up gaps."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(pairs: Column) -> Column:
        twin = lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"])
        return F.array_sort(F.transform(F.filter(pairs, lambda p, i: F.coalesce(twin(p, i), F.get(pairs, i - 1)["h"] == p["h"], F.get(pairs, i + 1)["h"] == p["h"], F.lit(False))), lambda p: p["i"]))

    def total(found: Column) -> Column:
        gaps = F.transform(found, lambda p, i: F.least(F.coalesce(F.get(found, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)  # noqa: E731  binds a value so that it is computed once
    return once(once(ordered, positions), total)


def vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), F.lit(0)).when(F.expr(rule.good), F.lit(1)).alias(rule.name)


@dataclass(frozen=True)
class LabelModel:
    """P(document is bad), and for each rule P(bad vote | bad) and P(bad vote | good)."""

    bad_share: float
    hit: tuple[float, ...]
    false_hit: tuple[float, ...]

    def log_odds_good(self, rules: tuple[Rule, ...]) -> Column:
        score = F.lit(math.log(1 - self.bad_share) - math.log(self.bad_share))
        for rule, hit, false_hit in zip(rules, self.hit, self.false_hit):
            score = score + F.when(F.col(rule.name) == 0, F.lit(math.log(false_hit / hit))).when(F.col(rule.name) == 1, F.lit(math.log((1 - false_hit) / (1 - hit)))).otherwise(F.lit(0.0))
        return score

    def posterior(self, rules: tuple[Rule, ...]) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds_good(rules)))


#: Strength of the Beta priors in documents, and where they pull to.
#: A bad document trips about one of the eight rules.
PRIOR_DOCS, PRIOR_BAD, PRIOR_HIT, PRIOR_FALSE_HIT = 50.0, 0.1, 0.125, 0.004


def fit(votes: DataFrame, rules: tuple[Rule, ...] = RULES, steps: int = 12) -> LabelModel:
    """EM on the histogram of vote patterns; ``votes`` has one column per rule."""
    names = [r.name for r in rules]
    patterns = materialize(votes.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "vote_patterns")
    model = LabelModel(PRIOR_BAD, (PRIOR_HIT,) * len(rules), (PRIOR_FALSE_HIT,) * len(rules))
    for _ in range(steps):
        weighed = patterns.withColumn("good", model.posterior(rules) * F.col("n")).withColumn("bad", F.col("n") - F.col("good"))
        sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
        for name in names:
            for side in ("good", "bad"):
                sums.append(F.sum(F.when(F.col(name) == 0, F.col(side))).alias(f"{name}_{side}_hits"))
                sums.append(F.sum(F.when(F.col(name).isNotNull(), F.col(side))).alias(f"{name}_{side}_votes"))
        row = {k: v or 0.0 for k, v in weighed.agg(*sums).first().asDict().items()}

        def rate(name: str, side: str, prior: float) -> float:
            return (row[f"{name}_{side}_hits"] + PRIOR_DOCS * prior) / (row[f"{name}_{side}_votes"] + PRIOR_DOCS)

        after = LabelModel(
            min(max((row["bad"] + PRIOR_DOCS * PRIOR_BAD) / (row["n"] + PRIOR_DOCS), 0.01), 0.5),
            tuple(min(max(rate(n, "bad", PRIOR_HIT), 0.05), 0.95) for n in names),
            tuple(min(max(rate(n, "good", PRIOR_FALSE_HIT), 0.0005), 0.04) for n in names),
        )
        moved = max(abs(a - b) for a, b in zip((after.bad_share, *after.hit, *after.false_hit), (model.bad_share, *model.hit, *model.false_hit)))
        model = after
        if moved < 1e-4:
            break
    return model


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """One row per document: counts, whether the base fails, posterior quality and the verdict."""
    counted = materialize(text_counts(docs).select("*", *[vote(r) for r in rules]), "quality_counts")
    model = fit(counted, rules)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (model.posterior(rules) >= least)).alias("kept"),
        F.round(model.posterior(rules), 6).alias("quality"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
