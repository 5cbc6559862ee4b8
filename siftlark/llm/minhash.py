"""Near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every text becomes its set of word shingles, a digest of the set and a MinHash signature. Texts
   with equal sets form a class, a node with a number of its own; copies are never expanded into pairs.
2. Classes are posted under each band of ``BAND`` coordinates and its values. Bands that one class alone has join nothing.
   Wide bands keep texts that merely share a common passage out of each other's lists.
3. Of ``coordinates`` values two sets must share at least ``matches``. If bands are so narrow that this many cannot be spread
   without leaving ``bands_shared`` bands equal, two sets also share one of the ``bands - bands_shared + 1`` bands that are rarest in
   each of them (prefix filter), so only those stay posted; otherwise every shared band is. Wider bands are used only if a pair at
   the threshold has none in common with a probability of at most ``LOSS``.
4. Candidates come in three rounds, so that a group of near copies never turns into all its pairs:
   a. each class with its best leader, the class of its lists whose values are the most shared;
   b. each class with every other leader of its lists, if they are not connected yet;
   c. classes of one list that are still in different components: all pairs of a list of at most
      ``SHORT`` classes, and in longer lists those that share one of their rarest shingles. A linked class holds 80 percent of
      the shingles of either one, so it has at least one of the rarest ``n - 0.8 n + 1`` of them, and nothing is lost. What many texts
      share (a passage, the original of a group of copies) is seldom among the rarest, and classes of one component never meet.
   After each round the pairs that reach ``matches`` are confirmed on the shingle sets of the whole
   texts, and components are contracted. Round c leaves out only pairs that are connected already or
   whose sizes and shingles exclude a link, so no link between components is lost.

A pair of similarity exactly 0.8 has fewer than 79 of 128 matches with probability 5.6e-7 and no band of four in common with
4.8e-8; for 0.85 both are below 1e-10. Distinct shingles of one text are told apart by 64-bit hashes; links are confirmed on the
shingles themselves. Texts are read again for the classes of surviving pairs only.

Defined results
- Null and empty texts and texts without words have no shingles and are linked with nothing.
- A text with fewer words than a shingle is one shingle.
- Repeated rows are in one class. If rows give one id different texts, their classes are linked through
  that id, so every text keeps its own links.
- A null ``doc_id`` is linked with nothing, its component is null and it is kept.
- Ties between leaders go to the class with the smaller number; components do not depend on it.
- Very long texts are read whole. An empty table gives an empty result.
- Columns besides ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.llm.common import join_groups, materialize, text_of
from siftlark.llm.components import components
from siftlark.llm.shingles import Signer, exact_set

WORDS, PERCENT, COORDINATES, MATCHES = 5, 80, 128, 79
BATCH = 200
#: Coordinates of a band at most, and the probability with which bands that are not sure to be shared may lose a pair at the threshold.
BAND, LOSS = 4, 1e-7
#: Pairs of one class that are confirmed in one task before the class is dealt to several.
PAIRS_A_TASK = 500
#: In lists of so few classes the last round tries all pairs; in longer ones, those that share a rare shingle. Both lose no link.
SHORT = 16


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))


def signatures(docs: DataFrame, words: int, coordinates: int) -> DataFrame:
    """doc_id, text_key, n_shingles, digest and signature; digest and signature are null for empty sets."""

    def sign(batches):
        signer = Signer(words, coordinates)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                sets = [signer.hashes(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([signer.digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signer.signature(s) if len(s) else None for s in sets], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "text_key", "n_shingles", "digest", "signature"],
                )

    return _read(docs).mapInArrow(sign, "doc_id long, text_key long, n_shingles long, digest binary, signature array<int>")


def bands_shared(coordinates: int, matches: int, width: int) -> int:
    """How many whole bands are equal at least in two signatures with so many matches: one short of a band's width match in each of the others."""
    bands = coordinates // width
    return matches - coordinates % width - bands * (width - 1)


def band_width(coordinates: int, matches: int, percent: int) -> int:
    """The widest band, up to ``BAND``, that two similar sets are sure to share or lack with a probability of at most ``LOSS``."""
    lost = lambda w: (1 - (percent / 100) ** w) ** (coordinates // w)
    return next(w for w in range(BAND, 0, -1) if w == 1 or bands_shared(coordinates, matches, w) > 0 or lost(w) <= LOSS)


def postings(classes: DataFrame, coordinates: int, matches: int, percent: int) -> DataFrame:
    """node, key, n_shingles, bucket and weight of the rarest shared bands of each class."""
    width = band_width(coordinates, matches, percent)
    bands, needed = coordinates // width, max(bands_shared(coordinates, matches, width), 1)
    # Two bands of one hash would only bring more candidates.
    keys = F.array(*[F.xxhash64(F.lit(k), *[F.get("signature", F.lit(k * width + i)) for i in range(width)]) for k in range(bands)])
    every = classes.select("node", F.explode(keys).alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lists = every.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("found"), F.sum("n").alias("weight"))
    own = F.lit(bands) - F.size("found")
    prefix = F.slice("found", F.lit(1), F.greatest(F.lit(bands - needed + 1) - own, F.lit(0)))
    # Sets of similar size lie in the same or neighbouring buckets.
    bucket = F.floor(F.log("n_shingles") / math.log(100 / percent))
    posted = lists.select("node", "weight", F.explode(prefix).alias("post")).join(classes.select("node", "n_shingles"), "node")
    return posted.select("node", F.col("post.key").alias("key"), "n_shingles", bucket.alias("bucket"), "weight")


def similar_size(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def list_leaders(posted: DataFrame) -> DataFrame:
    """The heaviest class of each list and bucket of size."""
    best = F.max_by(F.struct("node", "n_shingles", "weight"), F.struct("weight", -F.col("node"))).alias("lead")
    return posted.groupBy("key", "bucket").agg(best)


def leader_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """Each class with the leaders of its lists, and how many of its lists each one leads."""
    # Only towards the heavier class, so that a pair is met from one side.
    upward = F.struct("weight", -F.col("node")) < F.struct("lead.weight", -F.col("lead.node"))
    near = list_leaders(posted).select("key", F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket"), "lead")
    met = posted.join(near, ["key", "bucket"]).where((F.col("lead.node") != F.col("node")) & upward & similar_size("n_shingles", "lead.n_shingles", percent))
    return met.groupBy(F.col("node").alias("a"), F.col("lead.node").alias("b")).agg(F.count("*").alias("lists"))


def reaching(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Pairs whose signatures agree in at least ``matches`` coordinates."""
    at = lambda side: classes.select(F.col("node").alias(side), F.col("signature").alias(f"sig_{side}"))
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.join(at("a"), "a").join(at("b"), "b").where(same >= matches).select("a", "b")


def texts_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of every class in ``pairs``, written once."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = classes.select("node", "doc_id", "text_key").join(needed, "node")
    return materialize(_read(docs).join(wanted, ["doc_id", "text_key"]).groupBy("node").agg(F.any_value("text").alias("text")), "pair_texts")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, text_a and text_b. A class with many pairs has its text dealt to several tasks, its pairs with it."""

    def dealt(side: str, frame: DataFrame) -> tuple[DataFrame, DataFrame]:
        counts = frame.groupBy(side).agg(F.ceil(F.count("*") / PAIRS_A_TASK).cast("int").alias("tasks"))
        sent = counts.join(texts.withColumnRenamed("node", side).withColumnRenamed("text", f"text_{side}"), side)
        spread = sent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
        return counts.select(side, F.col("tasks").alias(f"tasks_{side}")), spread.select(side, "salt", f"text_{side}")

    joined = pairs
    for side, other in (("a", "b"), ("b", "a")):
        counts, spread = dealt(side, pairs)
        joined = joined.join(counts, side).withColumn("salt", F.pmod(F.xxhash64(other), F.col(f"tasks_{side}")).cast("int")).join(spread, [side, "salt"]).drop("salt", f"tasks_{side}")
    return joined.select("a", "b", "text_a", "text_b")


def _kept(make, most: int = 50):
    """``make(text)`` by node, with the last ``most`` results at hand."""
    known: dict[int, object] = {}

    def get(node: int, text: str):
        if node not in known:
            if len(known) > most:
                known.clear()
            known[node] = make(text)
        return known[node]

    return get


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose shingle sets are similar enough, counted on the whole texts."""

    def check(batches):
        shingled = _kept(lambda text: exact_set(text, words))
        for batch in batches:
            rows = []
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                for a, b, text_a, text_b in zip(*(part.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                    set_a, set_b = shingled(a, text_a), shingled(b, text_b)
                    both = len(set_a & set_b)
                    if 100 * both >= percent * (len(set_a) + len(set_b) - both):
                        rows.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 2, ["a", "b"])

    return _with_texts(pairs, texts_of(pairs, classes, docs)).mapInArrow(check, "a long, b long")


def mixed_lists(posted: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings of lists that hold several components, with the component and the length of the list."""
    placed = posted.join(labels.select("node", "label"), "node", "left").withColumn("part", F.coalesce("label", "node"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("members")).where("low < high").select("key", "members")
    return placed.drop("label").join(mixed, "key")


def short_list_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """All pairs of lists of at most ``SHORT`` classes."""
    short = mixed.where(F.col("members") <= SHORT)
    left, right = (short.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n_shingles", "part")]) for side in "lr")
    within = (F.col("node_l") < F.col("node_r")) & (F.col("part_l") != F.col("part_r")) & similar_size("n_shingles_l", "n_shingles_r", percent)
    return left.join(right, "key").where(within).select(F.col("node_l").alias("a"), F.col("node_r").alias("b"))


def shingles_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, part, size and element: a row for each shingle of the classes in ``nodes``, whose texts are read again."""

    def read(batches):
        hashed, names = Signer(words, 1).hashes, ["node", "part", "size", "element"]
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                piece = batch.slice(start, BATCH)
                columns: list[list[np.ndarray]] = [[np.empty(0, dtype=np.int64)] for _ in names]
                for node, part, text in zip(*(piece.column(c).to_pylist() for c in ("node", "part", "text"))):
                    found = hashed(text).view(np.int64)
                    for column, value in zip(columns, (node, part, len(found), found)):
                        column.append(np.broadcast_to(np.asarray(value, dtype=np.int64), len(found)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names)

    wanted = classes.select("node", "doc_id", "text_key").join(nodes, "node")
    texts = _read(docs).join(wanted, ["doc_id", "text_key"]).groupBy("node", "part").agg(F.any_value("text").alias("text"))
    return texts.mapInArrow(read, "node long, part long, size long, element long")


def rare_shingles(found: DataFrame, percent: int) -> DataFrame:
    """element, node, part, size and rest (shingles from this one on): the rarest shingles of each class, of which a linked class holds one.

    A linked class has ``percent`` of the shingles of each side at least, so it cannot lack all of the first ones in any order.
    """
    shared = found.groupBy("element").agg(F.count("*").alias("n")).where("n > 1")
    ranked = found.join(shared, "element").groupBy("node", "part", "size").agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("elements"))
    own = F.col("size") - F.size("elements")
    first = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    posts = ranked.select("node", "part", "size", own.alias("own"), F.posexplode(F.slice("elements", F.lit(1), F.greatest(first - own, F.lit(0)).cast("int"))).alias("place", "post"))
    return posts.select("post.element", "node", "part", "size", (F.col("size") - F.col("own") - F.col("place")).alias("rest"))


def rare_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that share a rare shingle and may be linked by their sizes and what follows it.

    Components meet first, so that classes of one component are never held against each other. From its first common
    shingle on, a linked pair still has all the common ones.
    """

    def may_link(low_l: str, high_l: str, rest_l: str, low_r: str, high_r: str, rest_r: str) -> Column:
        common = (F.col(low_l) + F.col(low_r)) * (percent / (100 + percent)) - 1e-6
        return (100 * F.col(high_l) >= percent * F.col(low_r)) & (100 * F.col(high_r) >= percent * F.col(low_l)) & (F.least(rest_l, rest_r) >= common)

    bounds = posts.groupBy("element", "part").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max("rest").alias("rest"))
    mixed = bounds.groupBy("element").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("element")
    bounds = materialize(bounds.join(mixed, "element"), "rare_parts")
    named = lambda frame, side: frame.select("element", *[F.col(c).alias(f"{c}_{side}") for c in frame.columns if c != "element"])
    part_l, part_r = named(bounds, "l"), named(bounds, "r")
    parts = part_l.join(part_r, "element").where((F.col("part_l") < F.col("part_r")) & may_link("low_l", "high_l", "rest_l", "low_r", "high_r", "rest_r"))
    parts = parts.select("element", "part_l", "part_r", "low_r", "high_r", F.col("rest_r").alias("most_r"))
    left = parts.join(named(posts, "l"), ["element", "part_l"]).where(may_link("size_l", "size_l", "rest_l", "low_r", "high_r", "most_r"))
    left = left.select("element", "part_r", "node_l", "size_l", "rest_l")
    both = left.join(named(posts, "r"), ["element", "part_r"]).where(may_link("size_l", "size_l", "rest_l", "size_r", "size_r", "rest_r"))
    return both.select(F.col("node_l").alias("a"), F.col("node_r").alias("b"))


def other_pairs(posted: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of classes that share a list, are in different components and may be linked by the rare shingles that they share."""
    mixed = materialize(mixed_lists(posted, labels), "mixed_lists")
    found = materialize(shingles_of(mixed.where(F.col("members") > SHORT).select("node", "part").distinct(), classes, docs, words), "shingles")
    posts = materialize(rare_shingles(found, percent), "change_posts")
    pairs = rare_pairs(posts, percent).unionByName(short_list_pairs(mixed, percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components."""
    part = labels.select("node", "label")
    return (
        pairs.join(part.select(F.col("node").alias("a"), F.col("label").alias("label_a")), "a", "left")
        .join(part.select(F.col("node").alias("b"), F.col("label").alias("label_b")), "b", "left")
        .where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows = materialize(signatures(docs, words, coordinates), "signatures")
    known = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    grouped = known.groupBy("digest").agg(first, F.count("*").alias("n_rows"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature"))
    # The number of a class is fixed by writing it.
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", "first.doc_id", "first.text_key", "n_rows", "n_shingles", "signature"), "classes")
    placed = materialize(join_groups(known.select("doc_id", "n_shingles", "digest"), classes.select("node", "digest", "n_rows"), "digest", "n_rows").select("doc_id", "n_shingles", "node"), "placed")
    several = placed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    labels = components(materialize(several.join(placed, "doc_id").where("node > a").select("a", F.col("node").alias("b")).distinct(), "links"))

    posted = materialize(postings(classes, coordinates, matches, percent), "postings")
    check = lambda pairs: materialize(confirmed(materialize(reaching(pairs, classes, matches), "pairs"), classes, docs, words, percent), "links")

    met = materialize(leader_pairs(posted, percent), "leader_pairs")
    labels = components(check(met.groupBy("a").agg(F.max_by("b", F.struct("lists", -F.col("b"))).alias("b"))), labels)
    labels = components(check(_apart(met, labels).select("a", "b")), labels)
    labels = components(check(other_pairs(posted, labels, classes, docs, words, percent)), labels)

    part = classes.join(labels.select("node", "label"), "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("part"))
    least = part.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    sizes = placed.groupBy("node").agg(F.count("*").alias("n_rows"))
    decided = materialize(part.join(least, "part").join(sizes, "node").select("node", "component_id", "n_rows"), "class_labels")
    linked = join_groups(placed, decided, "node", "n_rows")
    alone = rows.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component (the smallest id), with all its columns."""
    gone = near_duplicates(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
