"""Spelling variants: words at Levenshtein distance one, grouped under the form that is far more frequent.

The vocabulary is counted with a combine inside each batch, sorted by range and cut into shards of
``SHARD_WORDS`` words, each packed as a compact trie. Rounds of shards of at most ``ROUND_BYTES`` together, as counted,
are broadcast; in each round every word's distance-one automaton is intersected with every shard of the round,
depth-first, and what the shards of a round tell of a word comes down to one row: how many neighbours, and the best of them. A
trie of a range of words ends a search at its root if nothing there fits, so most shards cost a word a step or two.
Rows of the rounds are reduced by word. A word's neighbours are bounded by its length and the alphabet, so no
form is a hot key; chains of forms are followed twice as far with every join, and their counts grow at
least ``RATIO`` times with each step, so that they end.

The vocabulary, not the corpus, decides the cost: it grows about with the square root of the corpus.

Defined results
- A null or empty text has no words. A null ``doc_id`` counts as the text ``null`` where runs lose a character.
- Repeated rows are counted as often as they come. Of equally frequent neighbours the one that is smallest in code-point order is the form.
- Very long texts and very long runs are read whole. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.llm import trie
from siftlark.llm.common import materialize
from siftlark.llm.components import to_roots

LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
#: Of runs in documents, one in so many loses a character, by a hash of both.
MISPRINTS = 31
SHARD_WORDS, TASK_WORDS, ROUND_BYTES = 200_000, 60_000, 32 << 20
#: Words, or characters of words, counted in one table before it is handed on.
KEPT_WORDS, KEPT_CHARS = 300_000, 20_000_000
WORD = pa.schema([("word", pa.string()), ("n", pa.int64())])


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, misprints: int | None = MISPRINTS) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, that are long and frequent enough; ``misprints`` None leaves runs as they are."""
    run = re.compile(r"[A-Za-zÀ-ÿ]{%d,}+" % least_chars)

    def count(batches):
        counts: Counter[str] = Counter()
        chars = 0

        def handed_on():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=WORD)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                runs = Counter(run.findall(text.encode().lower().decode()))
                if misprints:
                    name = b"%d:" % doc_id if doc_id is not None else b"null:"
                    for word in [w for w in runs if zlib.crc32(name + w.encode()) % misprints == 0]:
                        at = zlib.crc32(name + word.encode()) % len(word)
                        left, n = word[:at] + word[at + 1 :], runs.pop(word)
                        if len(left) >= least_chars:
                            counts[left] += n
                            chars += len(left)
                counts.update(runs)
                chars += sum(map(len, runs))
                if len(counts) > KEPT_WORDS or chars > KEPT_CHARS:
                    yield handed_on()
                    counts.clear()
                    chars = 0
        if counts:
            yield handed_on()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def trie_shards(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """shard, size, payload: sorted words of a partition, ``shard_words`` at a time, as packed tries."""

    def pack(batches):
        held: list[str] = []
        counts: list[int] = []

        def shard():
            payload = trie.build(held, counts).packed()
            return pa.RecordBatch.from_pydict({"size": pa.array([len(payload)], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            held += batch.column("word").to_pylist()
            counts += batch.column("n").to_pylist()
            while len(held) >= shard_words:
                rest = held[shard_words:], counts[shard_words:]
                del held[shard_words:], counts[shard_words:]
                yield shard()
                held, counts = rest
        if held:
            yield shard()

    packed = words.mapInArrow(pack, "size long, payload binary")
    return packed.select(F.monotonically_increasing_id().alias("shard"), "size", "payload")


def rounds_of(shards: DataFrame, most_bytes: int = ROUND_BYTES) -> list[list[int]]:
    """Shards by round; a round holds ``most_bytes`` at most, or one shard."""
    found: list[list[int]] = []
    room = 0
    for row in shards.select("shard", "size").orderBy("shard").toLocalIterator():
        if not found or row.size > room:
            found.append([])
            room = most_bytes
        found[-1].append(row.shard)
        room -= row.size
    return found


def _intersect(words: DataFrame, shards: DataFrame, chosen: list[int]) -> DataFrame:
    """word, n, n_near, best_n, best over the ``chosen`` shards."""
    payloads = [bytes(r.payload) for r in shards.where(F.col("shard").isin(chosen)).select("payload").collect()]
    sent = words.sparkSession.sparkContext.broadcast(payloads)

    def search(batches):
        rows = [(w, n) for b in batches for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist())]
        near, best = [0] * len(rows), [None] * len(rows)
        for payload in sent.value:
            shard = trie.unpacked(payload)
            for i, (word, _) in enumerate(rows):
                for found, n in trie.neighbours(shard, word):
                    near[i] += 1
                    if best[i] is None or (-n, found) < best[i]:
                        best[i] = (-n, found)
        best_n = pa.array([b and -b[0] for b in best], pa.int64())
        best_word = pa.array([b and b[1] for b in best], pa.string())
        columns = [pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64()), pa.array(near, pa.int64()), best_n, best_word]
        yield pa.RecordBatch.from_arrays(columns, ["word", "n", "n_near", "best_n", "best"])

    return words.mapInArrow(search, "word string, n long, n_near long, best_n long, best string")


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, n, n_near, and the most frequent of its near words with its count, for all ``words`` (word, n)."""
    counted = materialize(words.select("word", "n"), "vocabulary")
    n_words = counted.count()
    ordered = materialize(counted.repartitionByRange(max(1, -(-n_words // shard_words)), "word").sortWithinPartitions("word"), "sorted_words")
    shards = materialize(trie_shards(ordered, shard_words), "trie_shards")
    # Dealt by hash: words that are dear to search, or many of one beginning, do not meet in one task.
    dealt = materialize(counted.repartition(max(1, -(-n_words // TASK_WORDS)), "word"), "dealt_words")
    told = None
    for k, chosen in enumerate(rounds_of(shards, round_bytes)):
        found = materialize(_intersect(dealt, shards, chosen), f"near_{k}")
        told = found if told is None else told.unionByName(found)
    if told is None:
        return counted.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n"))
    least = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))).alias("least")
    return told.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), least).select("word", "n", "n_near", F.col("least.w").alias("best"), (-F.col("least.m")).alias("best_n"))


def spelling_variants(words: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of all ``words`` (word, n)."""
    near = near_words(words, shard_words, round_bytes)
    is_form = F.col("best_n") >= F.lit(ratio) * F.col("n")
    formed = materialize(near.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    roots = to_roots(formed.where("form IS NOT NULL").select(F.col("word").alias("node"), F.col("form").alias("label")))
    ends = roots.select(F.col("node").alias("word"), F.col("label").alias("root"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB SQL, one fold over its bytes; ``steps`` holds the table of one byte."""
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), (2 * i - 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE = rf"""
WITH RECURSIVE steps AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
seen AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, 'null') || ':' || run AS key, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_CHARS} GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("key")} AS h FROM seen, steps),
made AS (SELECT CASE WHEN h % {MISPRINTS} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
ranked AS (SELECT p.word, p.near, w.n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, encode(p.near)) AS place FROM pairs p JOIN words w ON w.word = p.near),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= {RATIO} * w.n THEN r.near END AS form, CASE WHEN r.n >= {RATIO} * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
walk AS (SELECT word, word AS root, form AS onward FROM forms UNION ALL SELECT walk.word, walk.onward, f.form FROM walk JOIN forms f ON f.word = walk.onward)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk ON walk.word = f.word AND walk.onward IS NULL
"""
