"""Near duplicates by a chosen-path set similarity join.

1. A task turns each whole text into its set of word 2-shingles (64-bit hashes),
   a digest of the set and ``COORDINATES`` minwise tokens.  Texts with equal sets
   form one class; one row of a class goes on.
2. Each tree begins with all classes in its root.  A node chooses one or two of the
   coordinates (1 / similarity of them on average), and its classes go to the
   child of each chosen minwise token, so that a pair at the wanted similarity
   keeps one common path on average.  A class alone in a node is done there,
   a node of at most ``SMALL`` classes is a leaf, and larger ones branch again, as
   often as ``choose_depth`` says for the number of classes.  The number of trees follows from the target
   recall at that depth.
3. Classes of a leaf are compared with each other by a byte of each of their minwise tokens.  Pairs
   whose estimate is within four standard deviations of the wanted similarity
   are tied, and a node that still is large after the last step ties all its classes.
   What is tied, directly or over others, is one cluster; every pair with a common leaf that
   may be linked lies within one.
4. Links are confirmed on full sets, once per cluster.  A cluster that fits one block
   is compared pair by pair in one task.  In a larger one all classes are first
   compared with ``HUBS`` of them; what hangs together then needs no comparison
   within, so only classes outside the main part meet the others, block by
   block.  A task returns one edge a class at most, never all pairs.
5. Connected classes get the smallest doc_id among their documents.

Words are split at ASCII white space and folded A-Z.  A text of one word has one
shingle; null, empty and blank texts have none and are linked with nothing.  Rows
that repeat a text, an id or both are linked with each other through their set.
Missing ids come last when the smallest is taken: a component without any id has
the component_id null, and a row without id is kept only there.
"""

from __future__ import annotations

import hashlib
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valsieve.llm.common import join_hot, pieces, row_key, ship, stage, starts_of, text_of, texts_of
from valsieve.llm.jaccard_join import grams_of, mixed, overlaps

SHINGLE, PERCENT, RECALL = 2, 80, 0.99
COORDINATES, SKETCH, SMALL, HUBS = 64, 32, 512, 4
#: Tasks that the rows of one set are dealt to at least.
SALTS = 4
#: Steps of a tree at least; each step is to leave a tenth of the unlike texts of a node together.
DEPTH, APART = 3, 0.1
#: Rounds of a component search; labels halve their distance in each, so this is never met.
ROUNDS = 64
#: Classes and shingles of a block.
BLOCK_MEMBERS, BLOCK_SHINGLES = 768, 1_000_000
#: A cluster of more blocks is compared with its hubs first; one of fewer sends its sets to so many tasks at most.
FEW_BLOCKS = 3
#: Narrow rows that are counted and then broadcast rather than making the sets move: some 10 MB.
BROADCAST_ROWS = 200_000
#: The filter that spares texts without a cluster the way to the confirmation: bits a row, and bits at most.
FILTER_BITS_EACH, FILTER_BITS = 16, 1 << 27
WIDE = np.uint64


def survival(similarity: float, depth: int) -> float:
    """The chance that a pair of this similarity shares a node ``depth`` steps below a root."""
    second, chance = 1 / similarity - 1, 1.0
    for _ in range(depth):
        one = similarity * chance
        chance = (1 - second) * one + second * (1 - (1 - one) ** 2)
    return chance


def choose_depth(classes: int) -> int:
    """Steps after which a node with ``APART`` of the unlike texts of each step before is small."""
    return max(DEPTH, ceil(log(max(classes, 1) / SMALL) / log(1 / APART)))


def choose_trees(similarity: float, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Independent trees until a pair at ``similarity`` shares a leaf with probability ``recall``."""
    if not 0.5 < similarity < 1:
        raise ValueError("nodes choose one or two tokens: the similarity lies between 0.5 and 1")
    return ceil(log(1 - recall) / log(1 - survival(similarity, depth)))


def least_agreement(similarity: float, coordinates: int = SKETCH) -> int:
    """Equal minwise tokens that a pair at ``similarity`` has but for four standard deviations."""
    return max(1, int(coordinates * similarity - 4 * sqrt(coordinates * similarity * (1 - similarity))))


def minwise(rows: np.ndarray, shingles: np.ndarray, count: int) -> np.ndarray:
    """Minwise tokens of each row, two bytes of each (0 where it has no shingle)."""
    out = np.zeros((count, COORDINATES), ">u2")
    present, first = np.unique(rows, return_index=True)
    rng = np.random.default_rng(20250413)
    times = rng.integers(0, 1 << 63, COORDINATES, dtype=np.int64).astype(WIDE) * WIDE(2) + WIDE(1)
    plus = rng.integers(0, 1 << 63, COORDINATES, dtype=np.int64).astype(WIDE)
    if len(present):
        for k in range(COORDINATES):
            least = np.minimum.reduceat(shingles * times[k] + plus[k], first)
            out[present, k] = mixed(least) >> WIDE(48)
    return out


def sign_batches(batches):
    """Arrow task: digest, size and minwise tokens of each text's set."""
    for batch in pieces(batches, "text"):
        rows, shingles = grams_of(texts_of(batch), SHINGLE)
        starts = starts_of(rows, batch.num_rows).tolist()
        tokens, digests, sizes = minwise(rows, shingles, batch.num_rows), [], []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            own = np.unique(shingles[a:b])
            sizes.append(len(own))
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "row_hash": batch.column("row_hash"), "digest": pa.array(digests, pa.binary()),
            "size": pa.array(sizes, pa.int64()), "tokens": pa.array([row.tobytes() for row in tokens], pa.binary()),
            "sketch": pa.array([row.tobytes() for row in tokens[:, :SKETCH].astype(np.uint8)], pa.binary())})


def signatures(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_hash bigint, digest binary, size bigint, tokens binary, sketch binary"
    keyed = docs.select(*row_key(), text_of().alias("text"))
    return stage(keyed.mapInArrow(sign_batches, schema).withColumn("row", F.monotonically_increasing_id()), "path-signatures")


def classes_of(signed: DataFrame) -> DataFrame:
    """One row per distinct set with a number of its own, the row that stands for it and its smallest id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_hash")).alias("first")
    grouped = signed.where("size > 0").groupBy("digest").agg(first, F.max("size").alias("size"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    return stage(grouped.withColumn("node", F.monotonically_increasing_id()), "path-classes")


def children(path: Column, tokens: Column, second: float) -> Column:
    """The children that a node deals its classes to: hashes of the path, a coordinate and its minwise token."""
    one = F.pmod(F.xxhash64(path, F.lit(11)), F.lit(COORDINATES)).cast("int")
    other = F.pmod(one + 1 + F.pmod(F.xxhash64(path, F.lit(13)), F.lit(COORDINATES - 1)), F.lit(COORDINATES)).cast("int")
    both = F.pmod(F.xxhash64(path, F.lit(17)), F.lit(1 << 20)) < int(second * (1 << 20))
    child = lambda k: F.xxhash64(path, k, F.substring(tokens, 2 * k + 1, F.lit(2)))
    return F.when(both, F.array(child(one), child(other))).otherwise(F.array(child(one)))


def branch(classes: DataFrame, trees: int, depth: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Members (node, path) of the leaves, and of the nodes that are large after ``depth`` steps."""
    narrow, leaves = classes.select("node", "tokens"), []
    rows = narrow.withColumn("path", F.explode(F.array(*[F.xxhash64(F.lit("tree"), F.lit(k)) for k in range(trees)])))
    for _ in range(depth):
        below = rows.select("node", F.explode(children(F.col("path"), F.col("tokens"), 1 / similarity - 1)).alias("path"))
        met = below.groupBy("path").agg(F.count("*").alias("members")).where("members > 1")
        together = stage(below.join(met, "path"), "path-members")
        leaves.append(together.where(F.col("members") <= SMALL).select("node", "path"))
        large = together.where(F.col("members") > SMALL).select("node", "path")
        if large.isEmpty():
            break
        rows = large.join(narrow, "node")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out, large


def forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of ties the first row of its tree."""
    root = np.arange(len(near))
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        if root[i] != i:
            continue
        todo = [i]
        while len(todo):
            fresh = np.flatnonzero(near[todo].any(axis=0) & (root > i))
            fresh = fresh[root[fresh] == fresh]
            root[fresh] = i
            todo = fresh
    return root


def groups_of(batches, keys: tuple[str, ...], plain: tuple[str, ...], lists: tuple[str, ...]):
    """Rows of sorted batches, one group of equal keys at a time: a list of columns, lists as arrays of arrays."""
    held, now = [], None
    for batch in batches:
        at = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for column in at:
            change[1:] |= column[1:] != column[:-1]
        cuts = np.flatnonzero(change).tolist()
        values = [batch.column(n).to_numpy(zero_copy_only=False) for n in plain]
        nested = [(c.flatten().to_numpy(zero_copy_only=False), (c.offsets.to_numpy() - c.offsets[0].as_py()).tolist()) for c in (batch.column(n) for n in lists)]
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a == b:
                continue
            key = tuple(int(column[a]) for column in at)
            if held and key != now:
                yield held
                held = []
            now = key
            held.append([v[a:b].copy() for v in values] + [[v[o[i]:o[i + 1]].copy() for i in range(a, b)] for v, o in nested])
    if held:
        yield held


def edges_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    node, root = (np.concatenate([f[i] for f in found]) for i in range(2))
    return pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())})


def tie_batches(batches, percent: int, agree: int):
    """Arrow task over members sorted by leaf: a forest of the classes of each leaf that may be linked."""
    found, size = [], 0
    for group in groups_of(batches, ("path",), ("node", "size", "sketch"), ()):
        node, sizes, sketches = (np.concatenate([g[i] for g in group]) for i in range(3))
        tokens = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(node), SKETCH)
        near = 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
        np.fill_diagonal(near, False)
        step = max(1, (1 << 22) // (len(node) * SKETCH))
        for a in range(0, len(node), step):
            near[a:a + step] &= (tokens[a:a + step, None, :] == tokens[None, :, :]).sum(axis=2) >= agree
        root = forest(near)
        tied = np.flatnonzero(root != np.arange(len(root)))
        if len(tied):
            found.append((node[tied], node[root[tied]]))
            size += len(tied)
        if size > 100_000:
            yield edges_batch(found)
            found, size = [], 0
    if found:
        yield edges_batch(found)


def clusters_of(classes: DataFrame, leaves: DataFrame, large: DataFrame, percent: int) -> DataFrame | None:
    """Classes with a possible partner: node, cluster, size; nothing where there is none."""
    agree = least_agreement(percent / 100)
    dealt = leaves.join(classes.select("node", "size", "sketch"), "node").repartition("path").sortWithinPartitions("path", "node")
    ties = dealt.select("path", "node", "size", "sketch").mapInArrow(lambda b: tie_batches(b, percent, agree), "node bigint, root bigint")
    heads = large.groupBy("path").agg(F.min("node").alias("root"))
    all_ties = stage(ties.unionByName(large.join(heads, "path").where("node <> root").select("node", "root")).distinct(), "path-ties")
    if all_ties.isEmpty():
        return None
    named = components(all_ties).select("node", F.col("component").alias("cluster"))
    return stage(named.join(classes.select("node", "size", "first"), "node"), "path-clusters")


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of each connected component: node, component.

    Each round takes the least label of all neighbours, then the label of that label, and
    is written once to the shared folder.
    """
    both = stage(edges.select("node", "root").union(edges.select(F.col("root").alias("node"), F.col("node").alias("root"))).distinct(), "path-edges")
    labels = both.groupBy("node").agg(F.least("node", F.min("root")).alias("label"))
    for _ in range(ROUNDS):
        near = labels.select(F.col("node").alias("root"), F.col("label").alias("offer"))
        offers = both.join(near, "root").groupBy("node").agg(F.min("offer").alias("offer"))
        spread = labels.join(offers, "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = stage(spread.join(jump, "label").select("node", "old", F.col("further").alias("label")), "path-labels")
        if moved.where("label <> old").isEmpty():
            return moved.select("node", F.col("label").alias("component"))
        labels = moved.select("node", "label")
    raise RuntimeError("components did not settle")


def key_filter(members: DataFrame) -> np.ndarray:
    """A Bloom filter over the rows that stand for clustered classes, sized from their number; it only spares work."""
    bits = 1 << 16
    while bits < min(FILTER_BITS, FILTER_BITS_EACH * members.count()):
        bits *= 2
    spots = members.select(F.explode(F.array(*[F.pmod(F.xxhash64("first.doc_id", "first.row_hash", F.lit(k)), F.lit(bits)) for k in (1, 2)])).alias("bit"))
    words = spots.groupBy(F.expr("bit div 32").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits"))
    out = np.zeros(bits // 32, np.uint32)
    for batch in words.toArrow().to_batches():  # at most FILTER_BITS / 32 rows
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
    return out


def full_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """node, cluster, set: the whole sets of the clustered classes, written once."""
    spark = docs.sparkSession
    words = key_filter(members)
    bits, shared = 32 * len(words), spark.sparkContext.broadcast(words)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches):
        held = shared.value
        for batch in batches:
            spots = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("bit1", "bit2")]
            hit = np.logical_and(*[(held[s >> 5] >> (s & 31).astype(np.uint32)) & 1 for s in spots]).astype(bool)
            for part in pieces([batch.filter(pa.array(hit))], "text"):
                rows, shingles = grams_of(texts_of(part), SHINGLE)
                starts = starts_of(rows, part.num_rows).tolist()
                own = [np.unique(shingles[a:b]).view(np.int64) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"set_id": part.column("doc_id"), "set_hash": part.column("row_hash"), "set": pa.array(own, pa.list_(pa.int64()))})

    keyed = docs.select(*row_key(), text_of().alias("text")).withColumns(
        {f"bit{k}": F.pmod(F.xxhash64("doc_id", "row_hash", F.lit(k)), F.lit(bits)) for k in (1, 2)})
    found = keyed.mapInArrow(task, f"set_id {kind}, set_hash bigint, `set` array<bigint>")
    members = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    same = members["first.doc_id"].eqNullSafe(found.set_id) & (members["first.row_hash"] == found.set_hash)
    # rows that repeat id and text have equal sets; any of them stands for the class
    return stage(members.join(found, same).select("node", "cluster", "set"), "path-sets")


def hub_links(sets: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """Links (node, root, bit) of ``HUBS`` classes of each large cluster, drawn by hash, each itself included."""
    drawn = [F.min(F.struct(F.xxhash64("node", F.lit(k)), "node"))["node"].alias(f"hub{k}") for k in range(HUBS)]
    hubs = large.groupBy("cluster").agg(*drawn).select("cluster", F.posexplode(F.array(*[f"hub{k}" for k in range(HUBS)])).alias("turn", "hub"))
    hubs = stage(hubs, "path-hubs")  # ``HUBS`` narrow rows a large cluster: Spark knows their size
    own = sets.join(hubs.where("turn = 0").select("cluster"), "cluster", "left_semi")
    chosen = sets.drop("cluster").join(hubs, F.col("node") == F.col("hub")).groupBy("cluster").agg(F.collect_list(F.struct("turn", "hub", "set")).alias("hubs"))
    met = join_hot(own, chosen, "cluster", "node").select("node", "set", F.explode("hubs").alias("h"))
    common = F.size(F.array_intersect("set", "h.set"))
    linked = met.where(100 * common >= percent * (F.size("set") + F.size("h.set") - common))
    return stage(linked.select("node", F.col("h.hub").alias("root"), F.expr("shiftleft(1, h.turn)").alias("bit")), "path-hub-links")


def with_outer(large: DataFrame, links: DataFrame) -> DataFrame:
    """Whether each class lies outside the main part of its large cluster: what hangs together with the hub of most links.

    A class has a mask of the hubs that it is linked with.  A cluster has few
    different masks; hubs with a class in common are one part.
    """
    masks = links.groupBy("node").agg(F.bit_or("bit").alias("mask"))
    state = large.join(masks, "node", "left").select("node", "cluster", "size", F.coalesce("mask", F.lit(0)).alias("mask"))
    bits = [F.sum(F.col("mask").bitwiseAND(1 << k)) / (1 << k) for k in range(HUBS)]
    shape = state.groupBy("cluster").agg(F.collect_set("mask").alias("masks"), F.array(*bits).alias("counts"))
    main = F.element_at(F.array(*[F.lit(1 << k) for k in range(HUBS)]), F.array_position("counts", F.array_max("counts")).cast("int"))
    for _ in range(HUBS - 1):
        main = F.aggregate("masks", main, lambda held, mask: F.when(held.bitwiseAND(mask) != 0, held.bitwiseOR(mask)).otherwise(held))
    named = join_hot(state, shape.select("cluster", main.alias("main")), "cluster", "node")
    return named.select("node", "cluster", "size", (F.col("mask").bitwiseAND(F.col("main")) == 0).alias("outer"))


def cells_of(parts: DataFrame) -> DataFrame:
    """node, cluster, low, high: the block pairs in which each class meets those that it isn't known to hang together with.

    Blocks of outer classes come first.  They meet all blocks; blocks of the main
    part meet those of outer classes only.
    """
    def blocks(mine: Column) -> Column:
        count, shingles = (F.coalesce(F.sum(F.when(mine, v)), F.lit(0)) for v in (F.lit(1), F.col("size")))
        return F.greatest(F.ceil(count / BLOCK_MEMBERS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    shape = parts.groupBy("cluster").agg(blocks(F.col("outer")).alias("outers"), blocks(~F.col("outer")).alias("inners")).where("outers > 0")
    placed = join_hot(parts, shape, "cluster", "node").where("outers > 0")
    spot = F.pmod(F.xxhash64("node", F.lit(5)), F.when(F.col("outer"), F.col("outers")).otherwise(F.col("inners"))).cast("int")
    placed = placed.withColumn("own", F.when(F.col("outer"), spot).otherwise(F.col("outers") + spot))
    meets = F.when(F.col("outer"), F.col("outers") + F.col("inners") - 1).otherwise(F.col("outers") - 1)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), meets)))
    return placed.select("node", "cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def confirm_batches(batches, percent: int):
    """Arrow task over members sorted by block pair: a forest of links confirmed on full sets."""
    for group in groups_of(batches, ("cluster", "low", "high"), ("node",), ("set",)):
        node = np.concatenate([g[0] for g in group])
        sets = [s for g in group for s in g[1]]
        node, once = np.unique(node, return_index=True)  # a row may be repeated in the input
        if len(node) < 2:
            continue
        sets = [sets[i] for i in once.tolist()]
        sizes = np.array([len(s) for s in sets])
        common = np.rint(overlaps(sets)).astype(np.int64)
        near = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        np.fill_diagonal(near, False)
        root = forest(near)
        linked = np.flatnonzero(root != np.arange(len(root)))
        if len(linked):
            yield edges_batch([(node[linked], node[root[linked]])])


def confirmed(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Edges (node, root) that connect what is linked within clusters."""
    sets, group = full_sets(docs, members), ["cluster", "low", "high"]
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    shape = stage(members.groupBy("cluster").agg(blocks.cast("int").alias("blocks")).where("blocks > 1"), "path-large")
    # the sets of a cluster of one block go to its task as they are
    meeting = sets.join(shape, "cluster", "left_anti").select("cluster", F.lit(0).alias("low"), F.lit(0).alias("high"), "node", "set")
    known, larger = None, shape.where(F.col("blocks") > FEW_BLOCKS).select("cluster")
    if not shape.isEmpty():
        some = members.join(shape, "cluster", "left_semi").select("node", "cluster", "size")
        outer = some.withColumn("outer", F.lit(True))
        if not larger.isEmpty():
            large = some.join(larger, "cluster", "left_semi")
            known = hub_links(sets, large, percent)
            outer = outer.join(larger, "cluster", "left_anti").unionByName(with_outer(large, known))
        cells = cells_of(stage(outer, "path-outer"))
        of_large = sets.join(shape, "cluster", "left_semi").drop("cluster")
        meeting = meeting.unionByName(cells.join(of_large, "node").select(*group, "node", "set"))
    dealt = meeting.repartition(*group).sortWithinPartitions(*group, "node")
    links = dealt.select(*group, "node", "set").mapInArrow(lambda b: confirm_batches(b, percent), "node bigint, root bigint")
    return stage(links if known is None else links.unionByName(known.select("node", "root").where("node <> root")), "path-links")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Two texts are linked when ``100 * intersection >= percent * union`` of their sets;
    ``recall``: the chance that two classes at just that similarity meet.  Other columns of ``docs`` are
    not read.
    """
    signed = signatures(docs)
    classes = classes_of(signed)
    depth = choose_depth(classes.count())
    leaves, large = branch(classes, choose_trees(percent / 100, recall, depth), depth, percent / 100)
    members = clusters_of(classes, leaves, large, percent)
    named = classes.select("node", "digest", "first")
    if members is None:
        heads = named.select("digest", F.col("first.doc_id").alias("component_id"))
    else:
        links = confirmed(docs, members, percent)
        parts = named.join(components(links), "node", "left").withColumn("part", F.coalesce("component", "node"))
        parts = stage(parts.select("digest", "part", "first"), "path-parts")
        least = parts.groupBy("part").agg(F.min("first").alias("head"))
        heads = parts.join(least, "part").select("digest", F.col("head.doc_id").alias("component_id"))
    out = join_hot(signed.select("doc_id", "digest", "size", "row"), heads, "digest", "row", SALTS)
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
