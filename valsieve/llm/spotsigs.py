"""Document fingerprints: SpotSigs, compared through pruned Jaccard.

An anchor is a common word; its signature is the anchor with the next ``CHAIN``
content words (words that are not anchors), taken ``STEP`` apart.  A text is the
set of its signatures, as 32-bit hashes.  A text with words but without anchors
takes every word as an anchor; a chain ends early at the end of the text, so
every text with a word has a signature.  A text without words has none.

``near_pairs`` finds similar documents: two sets can only reach a similarity t
when the shorter has at least t times the signatures of the longer, so sets are
put into ranges of length, and a set meets its own range and the next one.  Inside
a range sets meet on their rarest signatures (a prefix long enough that similar
sets share one), equal sets meet as one class, and a pair is compared in full only
while its best possible Jaccard still reaches t.

Words are split at ASCII white space, folded to lower case and stripped of
punctuation.  Null texts count as empty.  Two texts without words are alike (1).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valsieve.llm.common import pieces, row_key, ship, stage, starts_of, text_of, texts_of, words_of

CHAIN, STEP = 3, 1
SIMILARITY = 0.8
#: Ranges of ids that ``neighbours`` sorts by itself; each should fit a task.
RANGE_BYTES = 16 << 20
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its of on or she that the their there they "
    "this to was were which will with you not no "
    "auf aus bei das dem den der des die ein eine einer für ich im ist mit nach nicht sich sie und von war zu zum zur auch als an "
    "au aux avec ce ces dans de du elle en est et il la le les leur mais ne ou par pas pour que qui sa se son sur un une "
    "al como con del el ella ellos era es esta este los las lo más o para pero por sin su sus y"
).split()
PUNCTUATION = "\"'“”‘’«»()[]{}.,;:!?…*&%$#~_=-/\\|"


def signatures_of(texts: pa.Array, anchors: pa.Array) -> list[np.ndarray]:
    """Sorted distinct signatures of each text."""
    rows, codes, distinct = words_of(pc.utf8_lower(texts), lower=False)
    bare = pc.utf8_trim(distinct, PUNCTUATION)
    hashed = pd.util.hash_array(np.asarray(bare.to_numpy(zero_copy_only=False), dtype=object), categorize=True)
    filled = pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    common = pc.is_in(bare, value_set=anchors).to_numpy(zero_copy_only=False)
    keep = filled[codes] if len(codes) else np.empty(0, bool)
    rows, codes = rows[keep], codes[keep]
    words, anchor = hashed[codes], common[codes]
    starts = starts_of(rows, len(texts))
    content = np.flatnonzero(~anchor)
    # Content words of one row lie together; the next one after each word:
    following = np.searchsorted(content, np.arange(len(rows)), side="right")
    anchored = np.add.reduceat(anchor.astype(np.int64), np.minimum(starts[:-1], max(len(rows) - 1, 0))) if len(rows) else np.zeros(len(texts), int)
    plain = (anchored == 0) | (np.diff(starts) == 0)
    spot = np.flatnonzero(anchor | plain[rows]) if len(rows) else np.empty(0, np.int64)
    total = words[spot].copy()
    factor = np.uint64(0x9E3779B97F4A7C15)
    for k in range(CHAIN):
        at = following[spot] + k * STEP
        place = np.append(content, -1)[np.minimum(at, len(content))]
        same = (place >= 0) & (rows[np.maximum(place, 0)] == rows[spot]) if len(spot) else np.empty(0, bool)
        total = total * factor + np.where(same, words[np.maximum(place, 0)] if len(words) else 0, np.uint64(k + 1))
        total ^= total >> np.uint64(29)
    marks = (total >> np.uint64(32)).astype(np.uint32)
    edges = np.searchsorted(rows[spot], np.arange(len(texts) + 1)) if len(spot) else np.zeros(len(texts) + 1, int)
    return [np.unique(marks[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 when the lengths alone rule ``least`` out."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)) or not len(a) or not len(b):
        return 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    value = both / (len(a) + len(b) - both)
    return value if value >= least else 0.0


def as_text(signatures: np.ndarray) -> str:
    """A fingerprint: the signatures, eight hexadecimal digits each, ascending."""
    return signatures.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by the beginning of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def id_ranges(docs: DataFrame) -> np.ndarray:
    """First ids of the ranges the table is sorted in: about RANGE_BYTES of text each, from the whole table."""
    size = docs.agg(F.sum(F.octet_length(text_of())).alias("bytes")).first().bytes or 0
    count = math.ceil(size / RANGE_BYTES)
    if count < 2:
        return np.empty(0, np.int64)
    steps = [k / count for k in range(1, count)]
    points = docs.agg(F.percentile_approx("doc_id", steps, max(10_000, 20 * count)).alias("points")).first().points
    return np.array(sorted({p for p in points or [] if p is not None}))


def parts_of(ids: pa.Array, points: np.ndarray) -> np.ndarray:
    """Range of each id; missing ids are in the first."""
    missing = pc.is_null(ids).to_numpy(zero_copy_only=False)
    known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    return np.where(missing, 0, np.searchsorted(points, known, side="right")).astype(np.int64)


def neighbours(docs: DataFrame) -> DataFrame:
    """Every row sent once to the task of its range of ids, and the first rows of each range also to the range before.

    Columns: part, late (the row only serves as a follower), doc_id, text.  The
    first row of all serves as follower of the last.  Ranges and their first ids
    are one small row for every RANGE_BYTES of text.
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", text_of().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges = spark.sparkContext.broadcast(id_ranges(narrow))

    def first_ids(batches):
        least: dict[int, tuple] = {}
        for batch in batches:
            for part, doc_id in zip(parts_of(batch.column(0), ranges.value).tolist(), batch.column(0).to_pylist(), strict=True):
                key = (doc_id is not None, doc_id or 0)
                if part not in least or key < least[part]:
                    least[part] = key
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(list(least), pa.int64()), "known": pa.array([k[0] for k in least.values()], pa.bool_()),
            "first": pa.array([k[1] for k in least.values()], pa.int64())})

    found = docs.select("doc_id").mapInArrow(first_ids, "part bigint, known boolean, first bigint")
    rows = sorted((r.part, r.at.known, r.at.first) for r in found.groupBy("part").agg(F.min(F.struct("known", "first")).alias("at")).collect())
    before = {row[0]: (rows[k - 1][0], *row[1:]) for k, row in enumerate(rows)}
    shared = spark.sparkContext.broadcast(before)

    def place(batches):
        for batch in pieces(batches, "text"):
            ids = batch.column("doc_id")
            parts = parts_of(ids, ranges.value)
            known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            value = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            target, first_known, first = (np.array([shared.value[p][k] for p in parts.tolist()]) for k in range(3))
            again = np.flatnonzero((known == first_known) & (~known | (value == first)))
            for rows_, to, late in ((np.arange(len(parts)), parts, False), (again, target[again] if len(again) else again, True)):
                if len(rows_):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to.astype(np.int64)), pa.array([late] * len(rows_)), ids.take(pa.array(rows_)), batch.column("text").take(pa.array(rows_))],
                        names=["part", "late", "doc_id", "text"])

    sent = narrow.mapInArrow(place, f"part bigint, late boolean, doc_id {kind}, text string")
    return sent.repartition("part").sortWithinPartitions("part", "late", F.col("doc_id").asc_nulls_first(), "text")


def fingerprint_batches(batches, anchors):
    """Arrow task over sorted rows: fingerprints of each text and its edited text, and their likeness."""
    anchors = pa.array(anchors, pa.large_string())
    held: tuple | None = None  # the row that waits for its follower: part, doc_id, text, signatures

    def flush(waiting):
        changed = [edited(text, after) for _, text, _, after, _ in waiting]
        other = signatures_of(pa.array(changed, pa.large_string()), anchors)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([w[0] for w in waiting], kind), "n_chars": pa.array([len(w[1]) for w in waiting], pa.int64()),
            "edited_sha256": [hashlib.sha256(c.encode("utf-8")).hexdigest() for c in changed],
            "fingerprint": [as_text(w[2]) for w in waiting], "edited_fingerprint": [as_text(o) for o in other],
            "near_edited": pa.array([pruned_jaccard(w[2], o) for w, o in zip(waiting, other, strict=True)], pa.float64()),
            "near_next": pa.array([pruned_jaccard(w[2], w[4]) for w in waiting], pa.float64())})

    kind = None
    for batch in pieces(batches, "text", 2 << 20):
        kind = batch.column("doc_id").type
        texts = texts_of(batch)
        own = signatures_of(texts, anchors)
        waiting = []
        columns = [batch.column(n).to_pylist() for n in ("part", "late", "doc_id")] + [texts.to_pylist()]
        for part, late, doc_id, text, marks in zip(*columns, own, strict=True):
            if held is not None and held[0] == part:
                waiting.append((held[1], held[2], held[3], text, marks))
            # Of several rows that only serve as followers the first one counts.
            held = (part, doc_id, text, marks) if not late else None
        if waiting:
            yield flush(waiting)


def fingerprints(docs: DataFrame, anchors=tuple(ANCHORS)) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next row by doc_id (missing ids first, ties by text),
    after the last one the first.  Texts travel once.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    names = list(anchors)
    return neighbours(docs).mapInArrow(lambda batches: fingerprint_batches(batches, names), schema)


def near_pairs(docs: DataFrame, similarity: float = SIMILARITY, anchors=tuple(ANCHORS)) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class_id) of equal signature sets, and pairs of classes (a, b, likeness) with a < b."""
    ship(docs.sparkSession)
    names = list(anchors)

    def task(batches):
        known = pa.array(names, pa.large_string())
        for batch in pieces(batches, "text"):
            sets = signatures_of(texts_of(batch), known)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "row_hash": batch.column("row_hash"),
                "marks": pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select(*row_key(), text_of().alias("text")).mapInArrow(task, f"doc_id {kind}, row_hash bigint, marks array<bigint>")
    read = stage(read, "spots")
    classes = stage(read.groupBy("marks").agg(F.min("doc_id").alias("class_id")).withColumn("node", F.monotonically_increasing_id()), "spot-classes")
    membership = read.join(classes, "marks").select("doc_id", "class_id")
    sets = classes.withColumn("length", F.size("marks")).where("length > 0")
    uses = sets.select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count("*").alias("uses"))
    marked = sets.select("node", "length", F.explode("marks").alias("mark")).join(uses, "mark")
    ranked = marked.withColumn("at", F.expr("row_number() OVER (PARTITION BY node ORDER BY uses, mark)"))
    prefix = ranked.where(F.col("at") <= F.col("length") - F.ceil(F.col("length") * similarity) + 1).where("uses > 1")
    # Ranges of length grow by 1 / similarity: similar sets lie in one range or in neighbouring ones.
    reach = F.floor(F.log("length") / math.log(1 / similarity)).cast("int")
    prefix = stage(prefix.select("node", "length", "mark", reach.alias("reach")), "spot-prefixes")
    left = prefix.withColumn("at", F.explode(F.array("reach", F.col("reach") + 1))).select(
        F.col("node").alias("a"), F.col("length").alias("la"), "mark", "at")
    right = prefix.select(F.col("node").alias("b"), F.col("length").alias("lb"), "mark", F.col("reach").alias("at"))
    shorter = (F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b")))
    met = left.join(right, ["mark", "at"]).where(shorter & (F.col("la") >= F.col("lb") * similarity)).select("a", "b").distinct()
    sides = [sets.select(F.col("node").alias(n), F.col("marks").alias(f"marks_{n}"), F.col("class_id").alias(f"class_{n}")) for n in ("a", "b")]
    both = F.size(F.array_intersect("marks_a", "marks_b"))
    likeness = both / (F.size("marks_a") + F.size("marks_b") - both)
    pairs = met.join(sides[0], "a").join(sides[1], "b").withColumn("likeness", likeness).where(F.col("likeness") >= similarity - 1e-12)
    return membership, pairs.select(
        F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"), "likeness")
