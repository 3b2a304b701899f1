"""Near-duplicate join on word n-grams: MinHash banding, then verified pairs.

1. A task turns each whole text into its set of word 5-grams (64-bit hashes), a
   digest of that set and a MinHash signature cut into bands.  Texts with equal
   sets form one class; only one row of a class goes on.
2. Classes are shuffled by band hash.  Buckets with the same members in several
   bands are verified once, in the first such band.
3. Members of a bucket meet with their full sets.  A large bucket is a grid of
   blocks, so a task holds a bounded number of sets, and a bucket of any size is
   verified pair by pair without a row per pair: a task returns for every member
   its number of links and one edge of a spanning forest.  A pair that shares
   several bands counts in the first.
4. Connected classes get the smallest doc_id of their component.

Words are split at ASCII white space and folded A-Z; a text of one to four words
has one n-gram, and a text without words an empty set.  Texts without words form
one class without links; null texts count as empty.  Rows that repeat id and text
are copies.  Missing ids come last when the row to keep is chosen.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valsieve.llm.common import join_hot, pieces, row_key, ship, stage, starts_of, text_of, texts_of, without_rows, words_of

NGRAM = 5
SIMILARITY = 0.8
RECALL = 0.99
HASHES = 128
#: A block holds about so many members and n-grams; larger buckets become a grid of blocks.
BLOCK_MEMBERS, BLOCK_GRAMS = 384, 400_000
#: Bits of the filter that spares texts without candidates the way to the verification.
FILTER_BITS = 1 << 23
WIDE = np.uint64


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows a band can have so that ``recall`` holds at ``similarity``."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - similarity ** rows) ** bands >= recall:
            return bands, rows
    raise ValueError("no banding reaches this recall with so few hashes")


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (finaliser of splitmix64)."""
    x = (x ^ (x >> WIDE(30))) * WIDE(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> WIDE(27))) * WIDE(0x94D049BB133111EB)
    return x ^ (x >> WIDE(31))


def grams_of(texts: pa.Array, size: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word n-gram of many texts, rows ascending."""
    rows, codes, distinct = words_of(texts)
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, WIDE)
    hashed = pd.util.hash_array(np.asarray(distinct.to_numpy(zero_copy_only=False), dtype=object), categorize=False)
    words = mixed(hashed.astype(WIDE))[codes]
    factor = WIDE(0x9E3779B97F4A7C15)
    total = np.zeros(max(0, len(words) - size + 1), WIDE)
    for k in range(size):
        total = total * factor + words[k:len(words) - size + 1 + k] if len(total) else total
    whole = rows[:len(total)] == rows[size - 1:] if len(total) else np.empty(0, bool)
    found_rows, found = rows[:len(total)][whole], mixed(total[whole])
    starts = starts_of(rows, int(rows[-1]) + 1)
    short = np.flatnonzero((np.diff(starts) > 0) & (np.diff(starts) < size))
    if len(short):
        values = []
        for row in short.tolist():
            value = WIDE(starts[row + 1] - starts[row])
            with np.errstate(over="ignore"):
                for word in words[starts[row]:starts[row + 1]]:
                    value = value * factor + word
            values.append(value)
        found_rows, found = np.concatenate([found_rows, short]), np.concatenate([found, mixed(np.array(values, WIDE))])
        order = np.argsort(found_rows, kind="stable")
        found_rows, found = found_rows[order], found[order]
    return found_rows, found


def band_hashes(rows: np.ndarray, grams: np.ndarray, bands: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have n-grams, and their band hashes as signed 64-bit numbers."""
    present, first = np.unique(rows, return_index=True)
    rng = np.random.default_rng(20240607)
    times = rng.integers(0, 1 << 63, bands * height, dtype=np.int64).astype(WIDE) * WIDE(2) + WIDE(1)
    plus = rng.integers(0, 1 << 63, bands * height, dtype=np.int64).astype(WIDE)
    out = np.zeros((len(present), bands), WIDE)
    if len(present):
        for k in range(bands * height):
            least = np.minimum.reduceat(grams * times[k] + plus[k], first)
            out[:, k // height] = mixed(out[:, k // height] * WIDE(31) + least)
    return present, out.view(np.int64)


def sign_batches(batches, bands: int, height: int):
    """Arrow task: the digest, size and band hashes of each text's n-gram set."""
    for batch in pieces(batches, "text"):
        rows, grams = grams_of(texts_of(batch))
        starts = starts_of(rows, batch.num_rows)
        present, hashes = band_hashes(rows, grams, bands, height)
        digests, sizes, listed = [], [], [[]] * batch.num_rows
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            own = np.unique(grams[a:b])
            sizes.append(len(own))
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
        for i, row in enumerate(present.tolist()):
            listed[row] = hashes[i]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "row_hash": batch.column("row_hash"),
            "digest": pa.array(digests, pa.binary()), "grams": pa.array(sizes, pa.int64()),
            "bands": pa.array(listed, pa.list_(pa.int64()))})


def signatures(docs: DataFrame, bands: int, height: int) -> DataFrame:
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_hash bigint, digest binary, grams bigint, bands array<bigint>"
    keyed = docs.select(*row_key(), text_of().alias("text"))
    signed = keyed.mapInArrow(lambda batches: sign_batches(batches, bands, height), schema)
    return stage(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")


def classes_of(signed: DataFrame) -> DataFrame:
    """One row per distinct n-gram set, with a number of its own and its first document."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row", "row_hash")).alias("first")
    grouped = signed.groupBy("digest").agg(first, F.max("grams").alias("grams"), F.first("bands").alias("bands"))
    return stage(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")


def bucket_members(classes: DataFrame) -> DataFrame | None:
    """Members of the buckets to verify: node, its first row, band, bucket, block pair."""
    spots = classes.select("node", "grams", F.posexplode("bands").alias("band", "bucket"))
    buckets = spots.groupBy("band", "bucket").agg(
        F.count("*").alias("members"), F.sum("grams").alias("grams"),
        F.bit_xor(F.xxhash64("node")).alias("mark"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("mark2"),
    ).where("members > 1")
    kept = buckets.groupBy("members", "mark", "mark2").agg(F.min(F.struct("band", "bucket", "grams")).alias("at"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("at.grams") / BLOCK_GRAMS)).cast("int")
    kept = stage(kept.select("at.band", "at.bucket", blocks.alias("blocks")), "buckets")
    if kept.isEmpty():
        return None
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")
    members = spots.drop("grams").join(kept, ["band", "bucket"]).withColumn("own", own)
    members = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    members = members.select("node", "band", "bucket", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    firsts = classes.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.row_hash").alias("row_hash"))
    return stage(members.join(firsts, "node"), "members")


def candidate_filter(members: DataFrame) -> np.ndarray:
    """Bits of the rows to verify: a Bloom filter of ``FILTER_BITS`` bits, made by Spark.

    It only spares work; the join behind it decides.
    """
    spots = members.select("doc_id", "row_hash").distinct().select(
        F.explode(F.array(*[F.pmod(F.xxhash64("doc_id", "row_hash", F.lit(k)), F.lit(FILTER_BITS)) for k in (1, 2)])).alias("bit"))
    words = spots.groupBy(F.expr("bit div 32").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    for word, value in words.collect():  # at most FILTER_BITS / 32 rows
        bits[word] = value
    return bits


def candidate_sets(docs: DataFrame, members: DataFrame, bands: int, height: int) -> DataFrame:
    """Whole n-gram sets of the rows that may meet another one."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(candidate_filter(members))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches):
        bits = shared.value
        for batch in batches:
            spots = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("bit1", "bit2")]
            hit = np.logical_and(*[(bits[s >> 5] >> (s & 31).astype(np.uint32)) & 1 for s in spots]).astype(bool)
            if not hit.any():
                continue
            for part in pieces([batch.filter(pa.array(hit))], "text"):
                rows, grams = grams_of(texts_of(part))
                starts = starts_of(rows, part.num_rows)
                _, hashes = band_hashes(rows, grams, bands, height)
                at, listed, sets = 0, [], []
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    sets.append(np.unique(grams[a:b]).view(np.int64))
                    listed.append(hashes[at] if b > a else [])
                    at += b > a
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "row_hash": part.column("row_hash"),
                    "bands": pa.array(listed, pa.list_(pa.int64())), "set": pa.array(sets, pa.list_(pa.int64()))})

    keyed = docs.select(*row_key(), text_of().alias("text"))
    for k in (1, 2):
        keyed = keyed.withColumn(f"bit{k}", F.pmod(F.xxhash64("doc_id", "row_hash", F.lit(k)), F.lit(FILTER_BITS)))
    return keyed.mapInArrow(task, f"doc_id {kind}, row_hash bigint, bands array<bigint>, `set` array<bigint>")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a bounded list of sets, by blocks of an incidence matrix."""
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses[column] > 1
    owner, column = owner[shared], column[shared]
    names, column = np.unique(column, return_inverse=True)
    common, step = np.zeros((len(sets), len(sets)), np.float32), max(1, (1 << 23) // len(sets))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, len(names), step):
        a, b = np.searchsorted(column, [start, start + step])
        block = np.zeros((len(sets), min(step, len(names) - start)), np.float32)
        block[owner[a:b], column[a:b] - start] = 1
        common += block @ block.T
    return common


def links_within(nodes, own, bands, sets, band: int, low: int, high: int, similarity: float):
    """For every linked member of one block pair: its root in a local forest and its number of links."""
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    common = overlaps(sets).astype(np.float64)
    near = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(near, False)
    if band:
        matrix = np.stack(bands)
        for earlier in range(band):
            near &= matrix[:, earlier][:, None] != matrix[:, earlier][None, :]
    if low != high:
        near &= own[:, None] != own[None, :]
    counts = near.sum(axis=1)
    root = np.arange(len(nodes))
    for i in np.flatnonzero(counts):  # members are in ascending order, so a root is the smallest of its tree
        if root[i] != i:
            continue
        todo = [i]
        while todo:
            fresh = np.flatnonzero(near[todo].any(axis=0) & (root > i))
            fresh = fresh[root[fresh] == fresh]
            root[fresh] = i
            todo = fresh.tolist()
    linked = np.flatnonzero(counts)
    return nodes[linked], nodes[root[linked]], counts[linked]


def verify_batches(batches, similarity: float):
    """Arrow task over rows sorted by group: links of each group, one bounded group at a time."""
    held, key = [], None

    def flush():
        if len(held) < 2:
            return None
        nodes = np.array([h[0] for h in held])
        own = np.array([h[1] for h in held])
        found = links_within(nodes, own, [h[2] for h in held], [h[3] for h in held], key[0], key[2], key[3], similarity)
        if not len(found[0]):
            return None
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["node", "root", "links"])

    for batch in batches:
        columns = [batch.column(n) for n in ("band", "bucket", "low", "high", "node", "own")]
        plain = [c.to_numpy(zero_copy_only=False) for c in columns]
        lists = []
        for name in ("bands", "set"):
            column = batch.column(name)
            lists.append((column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()))
        for i in range(batch.num_rows):
            now = tuple(int(plain[k][i]) for k in range(4))
            if now != key:
                if (done := flush()) is not None:
                    yield done
                held, key = [], now
            node = int(plain[4][i])
            if held and held[-1][0] == node:  # the row is repeated in the input
                continue
            bands, members = [values[at[i]:at[i + 1]].copy() for values, at in lists]
            held.append((node, int(plain[5][i]), bands, members))
    if (done := flush()) is not None:
        yield done


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of each connected component: node, component.

    Labels spread along edges and jump to the label of their label; each round
    is written to the shared folder.
    """
    both = edges.select("node", "root").union(edges.select(F.col("root").alias("node"), F.col("node").alias("root"))).distinct()
    both = stage(both, "edges")
    labels = stage(both.groupBy("node").agg(F.least("node", F.min("root")).alias("label")), "labels")
    while True:
        near = labels.select(F.col("node").alias("root"), F.col("label").alias("offer"))
        offers = both.join(near, "root").groupBy("node").agg(F.min("offer").alias("offer"))
        spread = labels.join(offers, "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        spread = stage(spread, "spread")
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = stage(spread.join(jump, "label").select("node", "old", F.col("further").alias("label")), "labels")
        if moved.where("label <> old").isEmpty():
            return moved.select("node", F.col("label").alias("component"))
        labels = moved.select("node", "label")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``.

    doc_id, row_hash; ``rep_id``: first document with the same n-gram set;
    ``class_id``: first document of the connected component; ``class_size``: rows
    in it; ``n_links``: how many other n-gram sets are at least ``similarity``
    like this one; ``kept``: one row of each component.
    """
    bands, height = choose_bands(similarity, recall)
    signed = signatures(docs, bands, height)
    classes = classes_of(signed)
    members = bucket_members(classes)
    named = classes.select("digest", "node", "first")
    if members is None:
        named = named.withColumns({"component": F.col("node"), "n_links": F.lit(0).cast("bigint")})
    else:
        sets = candidate_sets(docs, members, bands, height).withColumnsRenamed({"doc_id": "set_id", "row_hash": "set_hash"})
        same = members.doc_id.eqNullSafe(sets.set_id) & (members.row_hash == sets.set_hash)  # ids may be missing
        meeting = members.join(sets, same).select("band", "bucket", "low", "high", "node", "own", "bands", "set")
        group = ["band", "bucket", "low", "high"]
        dealt = meeting.repartition(*group).sortWithinPartitions(*group, "node")
        links = stage(dealt.mapInArrow(lambda b: verify_batches(b, similarity), "node bigint, root bigint, links bigint"), "links")
        counted = links.groupBy("node").agg(F.sum("links").alias("n_links"))
        edges = links.where("node <> root").select("node", "root")
        linked = stage(components(edges).join(counted, "node"), "linked")
        named = named.join(linked, "node", "left").withColumns(
            {"component": F.coalesce("component", "node"), "n_links": F.coalesce("n_links", F.lit(0).cast("bigint"))})
    named = stage(named, "named")
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    known = named.join(heads, "component").select("digest", "first", "head", "component", "n_links")
    joined = join_hot(signed.select("doc_id", "row_hash", "row", "digest"), known, "digest", "row")
    return joined.select(
        "doc_id", "row_hash", F.col("first.doc_id").alias("rep_id"), F.col("head.doc_id").alias("class_id"), "n_links",
        (F.col("row") == F.col("head.row")).alias("kept"), "component")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: the first document of each component."""
    decided = near_duplicates(docs, similarity).groupBy("doc_id", "row_hash").agg(
        F.max("kept").alias("kept"), F.count("*").alias("copies")).where("not kept or copies > 1")
    return without_rows(docs, stage(decided, "near-decisions"))


