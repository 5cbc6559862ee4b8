"""Information-theoretic sanitisation: personal data, and the terms that give it away.

Protected entities are the values that patterns find: an address, a card or phone number. The corpus tells how much a term
reveals of an entity ``c``. Over distinct passages (a line or sentence, each counted once however many copies there are)

    residual(c | term) = IC(c) - PMI(c; term) = -log2 P(c | term) = log2(n_term / n_joint)

is what remains unknown of ``c`` to a reader who sees the term. A term whose residual is at most ``RESIDUAL_BITS``
for some entity, on the evidence of ``SUPPORT`` joint passages or more, is sensitive wherever it stands. ``sanitized``
replaces entities by their kind and each sensitive term by the most general form above the threshold: its first letters if
their residual is higher than allowed, else nothing.

Documents are read twice. The first reading emits only the passages around entities; their pairs, at most 32 terms for
each entity, are counted, and terms that another entity or none would have to share anyway are ruled out by a lower bound of ``n_term``. The
second emits spans, and those terms that a fixed-size bitmap of the rest lets pass; counts over them are exact, since joins by term and
not the bitmap decide. Frequent terms and entities are pre-aggregated, and rows of a frequent term meet its verdict by ``join_groups``.

Defined results
- A null or empty text has no spans. Null ``doc_id`` and repeated rows: one result each; copies add no evidence.
- Of overlapping spans of different kinds all are listed; in a sanitised text they are one gap, named by the first.
- A residual of exactly the threshold is sensitive. Of entities equally close to a term the one with the smallest hash is told.
- Very long texts are read whole in linear time. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.llm import pii
from siftlark.llm.common import join_groups, materialize, text_of

RESIDUAL_BITS, SUPPORT = 1.0, 3
#: Bits of the bitmap that spares rows of unlisted terms: 4 MB on driver and executors at any size.
SLOTS = 1 << 25
#: Answers of the bitmap, and passages already handed on, that a task remembers.
REMEMBERED = 500_000
GENERAL_CHARS = 3
SPAN = "struct<start:int,kind:int,end:int>"
HIT = "struct<term:string,start:int,end:int,passage:long>"


@dataclass(frozen=True)
class Disclosure:
    """The threshold of sensitive terms."""

    residual_bits: float = RESIDUAL_BITS
    support: int = SUPPORT

    @property
    def most_share(self) -> float:
        """``n_term`` is at most so many times ``n_joint``."""
        return 2.0**self.residual_bits


def _key(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def entity_passages(docs: DataFrame) -> DataFrame:
    """passage, entities, terms: each distinct passage around an entity, once."""

    def read(batches):
        seen: set[int] = set()
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                spans = pii.base_spans(text)
                if not spans:
                    continue
                covered, starts = pii.Covered(spans), [s.start for s in spans]
                for passage in pii.passages(text):
                    inside = spans[np.searchsorted(starts, passage.start) : np.searchsorted(starts, passage.end)]
                    if not inside:
                        continue
                    key = _key(text[passage.start : passage.end])
                    if key in seen:
                        continue
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    terms = {text[a:b].lower() for a, b in passage.terms if not covered(a, b)}
                    if terms:
                        found.append((key, sorted({_key(pii.entity(text, s)) for s in inside}), sorted(terms)))
            columns = list(zip(*found)) or [(), (), ()]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["passage", "entities", "terms"])

    told = _rows(docs).select("text").mapInArrow(read, "passage long, entities array<long>, terms array<string>")
    return materialize(told.dropDuplicates(["passage"]), "entity_passages")


def joint_counts(around: DataFrame, disclosure: Disclosure = Disclosure()) -> DataFrame:
    """term, entity, n_joint: the closest entity of every term that may be sensitive."""
    pairs = around.select(F.explode("entities").alias("entity"), "terms").select("entity", F.explode("terms").alias("term"))
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_joint")).where(F.col("n_joint") >= disclosure.support)
    closest = joint.groupBy("term").agg(F.min(F.struct((-F.col("n_joint")).alias("n"), "entity")).alias("closest"))
    near = around.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    bounded = closest.join(near, "term").where(-F.col("closest.n") * F.lit(disclosure.most_share) >= F.col("n_near"))
    return materialize(bounded.select("term", F.col("closest.entity").alias("entity"), (-F.col("closest.n")).alias("n_joint")), "joint_counts")


def term_bitmap(terms: DataFrame, slots: int = SLOTS) -> np.ndarray | None:
    """Bits of the hashes of ``term``; its size does not depend on the number of terms. None without terms."""
    slot = F.pmod(F.xxhash64("term"), F.lit(slots)) + 1
    rows = terms.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    if not rows:
        return None
    bits = np.zeros(max(1, slots >> 15) * 4096, dtype=np.uint8)
    for row in rows:
        bits[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, dtype=np.uint8)
    return bits


class _Listed:
    """Whether the bitmap lets a term pass in lower case, remembered for the task."""

    def __init__(self, bits: np.ndarray, slots: int):
        self.bits, self.mask, self.known = bits.tobytes(), slots - 1, {}

    def __call__(self, term: str) -> bool:
        if (told := self.known.get(term)) is None:
            import xxhash

            slot = xxhash.xxh64_intdigest(term.lower().encode(), seed=42) & self.mask
            if len(self.known) > REMEMBERED:
                self.known.clear()
            told = self.known[term] = bool(self.bits[slot >> 3] >> (slot & 7) & 1)
        return told


def scan(docs: DataFrame, bits: np.ndarray | None, slots: int = SLOTS, keep_text: bool = False) -> DataFrame:
    """row_no, doc_id, base spans and the terms that the bitmap lets pass, of every row."""
    sent = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)

    def read(batches):
        listed = None if sent is None else _Listed(sent.value, slots)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [pii.base_spans(t) for t in texts]
            hits = [_hits(t, s, listed) for t, s in zip(texts, spans)]
            columns = [
                batch.column("doc_id"),
                pa.array([[s._asdict() for s in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
                pa.array(hits, pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("passage", pa.int64())]))),
            ]
            names = ["doc_id", "base", "hits"]
            if keep_text:
                columns.append(batch.column("text"))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id long, base array<{SPAN}>, hits array<{HIT}>" + ", text string" * keep_text
    return materialize(_rows(docs).mapInArrow(read, schema).withColumn("row_no", F.monotonically_increasing_id()), "sanitize_scan")


def _hits(text: str, spans: list[pii.Span], listed: _Listed | None) -> list[dict]:
    if listed is None or not any(map(listed, set(pii.TERM.findall(text)))):
        return []
    covered, found = pii.Covered(spans), []
    for passage in pii.passages(text):
        key = None
        for a, b in passage.terms:
            if listed(text[a:b]) and not covered(a, b):
                key = _key(text[passage.start : passage.end]) if key is None else key
                found.append({"term": text[a:b].lower(), "start": a, "end": b, "passage": key})
    return found


def _hit_rows(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.size("hits") > 0).select("row_no", F.explode("hits").alias("hit")).select("row_no", "hit.*")


def sensitive_terms(scanned: DataFrame, joint: DataFrame, disclosure: Disclosure = Disclosure()) -> DataFrame:
    """term, entity, n_joint, n_term, n_hits, residual_bits of the terms that give an entity away."""
    hits = _hit_rows(scanned)
    counts = hits.groupBy("term", "passage").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("n_term"), F.sum("n").alias("n_hits"))
    told = joint.join(counts, "term").where(F.col("n_joint") * F.lit(disclosure.most_share) >= F.col("n_term"))
    return materialize(told.withColumn("residual_bits", F.log2(F.col("n_term") / F.col("n_joint"))), "sensitive_terms")


def _with_terms(scanned: DataFrame, sensitive: DataFrame) -> DataFrame:
    """Rows of ``scanned`` with ``found``: their sensitive terms, by start."""
    hits = join_groups(_hit_rows(scanned), sensitive, "term", "n_hits")
    extra = [c for c in ("form",) if c in sensitive.columns]
    by_row = hits.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("start", "end", *extra))).alias("found"))
    held = scanned.where(F.size("hits") > 0).drop("hits").join(by_row, "row_no", "left")
    kind = held.schema["found"].dataType
    return scanned.where(F.size("hits") == 0).drop("hits").withColumn("found", F.lit(None).cast(kind)).unionByName(held)


def find_private(docs: DataFrame, disclosure: Disclosure = Disclosure(), slots: int = SLOTS) -> DataFrame:
    """doc_id, counts by kind, n_term, and the spans of every row: those of the patterns (``base``) and all of them."""
    joint = joint_counts(entity_passages(docs), disclosure)
    scanned = scan(docs, term_bitmap(joint, slots), slots)
    rows = _with_terms(scanned, sensitive_terms(scanned, joint, disclosure))
    found = F.coalesce("found", F.array().cast("array<struct<start:int,end:int>>"))
    terms = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(pii.TERM_KIND).alias("kind"), s["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in pii.KINDS])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{pii.KINDS[k]}") for k in range(pii.TERM_KIND)],
        F.size(terms).cast("long").alias("n_term"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", terms))).alias("spans"),
    )


def general_form(term: str) -> str:
    """The form above a term: a number by its size, a word by its first letters."""
    return term[0] + "0" * (len(term) - 1) if term.isdigit() else term[:GENERAL_CHARS] + "*"


def generalised(docs: DataFrame, around: DataFrame, sensitive: DataFrame, disclosure: Disclosure = Disclosure(), slots: int = SLOTS) -> DataFrame:
    """Sensitive terms with ``form``: the general form if that does not give the entity away, else the empty text."""

    def formed(batches):
        for batch in batches:
            forms = [general_form(t) for t in batch.column("term").to_pylist()]
            yield batch.append_column("general", pa.array(forms, pa.string()))

    columns = sensitive.columns
    named = materialize(sensitive.mapInArrow(formed, sensitive.withColumn("general", F.lit("")).schema), "general_forms")
    forms = named.select("entity", "general").distinct()
    bits = term_bitmap(forms.select(F.col("general").alias("term")), slots)
    if bits is None:
        return named.select(*columns, F.lit("").alias("form"))
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def of_text(text, listed):
        covered = pii.Covered(pii.base_spans(text))
        for passage in pii.passages(text):
            met = {general_form(text[a:b].lower()) for a, b in passage.terms if not covered(a, b)}
            if listed_forms := [form for form in met if listed(form)]:
                key = _key(text[passage.start : passage.end])
                yield from ((form, key) for form in listed_forms)

    def read(batches):
        listed = _Listed(sent.value, slots)
        for batch in batches:
            found = sorted({pair for text in batch.column("text").to_pylist() for pair in of_text(text, listed)})
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([k for _, k in found], pa.int64())], ["general", "passage"])

    met = _rows(docs).select("text").mapInArrow(read, "general string, passage long").distinct().groupBy("general").agg(F.count("*").alias("n_general"))

    def general_terms(batches):
        for batch in batches:
            forms = [sorted({general_form(t) for t in terms}) for terms in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("entities"), pa.array(forms, pa.list_(pa.string()))], ["entities", "generals"])

    held = around.mapInArrow(general_terms, "entities array<long>, generals array<string>").select(F.explode("entities").alias("entity"), "generals")
    joint = held.select("entity", F.explode("generals").alias("general")).groupBy("entity", "general").agg(F.count("*").alias("n_general_joint"))
    safe = forms.join(joint, ["entity", "general"]).join(met, "general").where(F.col("n_general_joint") * F.lit(disclosure.most_share) < F.col("n_general"))
    form = F.when(F.col("safe"), F.col("general")).otherwise(F.lit(""))
    return materialize(named.join(safe.select("entity", "general", F.lit(True).alias("safe")), ["entity", "general"], "left").select(*columns, form.alias("form")), "generalised_terms")


def sanitized(docs: DataFrame, disclosure: Disclosure = Disclosure(), slots: int = SLOTS) -> DataFrame:
    """doc_id and text of every row, without personal data and with sensitive terms generalised or removed."""
    around = entity_passages(docs)
    joint = joint_counts(around, disclosure)
    scanned = scan(docs, term_bitmap(joint, slots), slots, keep_text=True)
    sensitive = generalised(docs, around, sensitive_terms(scanned, joint, disclosure), disclosure, slots)

    def write(batches):
        for batch in batches:
            texts = []
            for text, base, terms in zip(*(batch.column(c).to_pylist() for c in ("text", "base", "found"))):
                gaps = [(s["start"], s["end"], f"[{pii.KINDS[s['kind']].upper()}]") for s in base]
                gaps += [(s["start"], s["end"], s["form"]) for s in terms or ()]
                parts, at = [], 0
                for start, end, put in sorted(gaps):
                    if start >= at:
                        parts += [text[at:start], put]
                    at = max(at, end)
                texts.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _with_terms(scanned, sensitive).select("doc_id", "text", "base", "found").mapInArrow(write, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
