"""Ranked lexical search: exact inner products by sparse ball trees.

1. A task finds in each whole text how often the terms of the items occur, and
   counts all of its terms.  Totals and document frequencies follow by aggregation.
2. A document is a sparse vector of integer term scores, an item one of term weights; both are
   divided for the trees by the square roots of the weights, which leaves their inner product alone.
   A task cuts its documents into blocks of ``BLOCK_TERMS`` entries and splits each block at the median
   between two distant documents into a tree of balls (centroid, radius).
3. For each item the balls are taken best first.  A subtree goes when the item's product
   with the centroid plus its length times the radius, both rounded
   up, lies below the worst of the item's best scores so far.  Leaves are scored in 64-bit integers.
4. The best of each task meet in a window that keeps ``top`` of each item.

Items are searched in blocks of ``ITEM_BYTES`` of text, so what is sent to the tasks is bounded.
Null texts have no terms.  Items without terms, and all items where no document has a term, have no rows.  Items that
repeat an id are ranked by themselves, and so are documents; missing doc_ids come last among equal scores.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from valsieve.llm.common import pieces, ship, stage, starts_of, text_of, texts_of

TOP = 10
ITEM_BYTES = 4 << 20
#: Vector entries of one tree, documents of a leaf, items looked at together.
BLOCK_TERMS, LEAF, GROUP = 1 << 19, 24, 256
#: Rounding of a bound: the sums behind it have far fewer than 2^20 terms.
ROUNDING = 2.0 ** -30


def term_bytes() -> np.ndarray:
    """Each byte as itself, lower-cased if A-Z, or as a space where it ends a term."""
    out = np.arange(256, dtype=np.uint8)
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        out[low:high + 1] = 0x20
    out[0x41:0x5B] += 0x20
    return out


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of each term of many texts (``large_string`` without nulls), and the distinct terms."""
    texts = pa.concat_arrays([texts, pa.array([], texts.type)])  # offsets of a slice begin at 0 again
    _, offsets, data = texts.buffers()
    told = term_bytes()[np.frombuffer(data or b"", np.uint8)]
    lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(told)))
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if (blank := pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()) >= 0:
        rows, codes = rows[codes != blank], codes[codes != blank]
    return rows, codes, coded.dictionary


def counted(rows: np.ndarray, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and number of each distinct (row, code), by row and code."""
    keys, times = np.unique(rows.astype(np.int64) * width + codes, return_counts=True)
    return keys // width, (keys % width).astype(np.int32), times


class Items(NamedTuple):
    """A bounded block of items as sparse rows over the terms that they use."""

    numbers: np.ndarray
    terms: pa.Array
    starts: np.ndarray
    codes: np.ndarray
    times: np.ndarray


def read_items(rows: DataFrame) -> Items:
    table = rows.toArrow()  # one block of ITEM_BYTES
    texts = table.column("text").combine_chunks()
    texts = pc.fill_null((texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()), "")
    at, codes, terms = terms_of(texts)
    owner, own, times = counted(at, codes, max(1, len(terms)))
    return Items(table.column("item_row").to_numpy(), terms, starts_of(owner, len(texts)), own, times)


def vectors(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """doc_id, n (all terms), codes and times of the wanted terms, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(terms.to_pylist())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches):
        wanted = pa.array(shared.value, pa.large_string())
        for batch in pieces(batches, "text"):
            rows, codes, distinct = terms_of(texts_of(batch))
            known = pc.fill_null(pc.index_in(distinct, value_set=wanted), -1).to_numpy(zero_copy_only=False)[codes] if len(codes) else codes
            owner, own, times = counted(rows[known >= 0], known[known >= 0], max(1, len(wanted)))
            offsets = pa.array(starts_of(owner, batch.num_rows), pa.int32())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array(np.bincount(rows, minlength=batch.num_rows), pa.int64()),
                "codes": pa.ListArray.from_arrays(offsets, pa.array(own, pa.int32())),
                "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))})

    narrow = docs.select("doc_id", text_of().alias("text"))
    return stage(narrow.mapInArrow(task, f"doc_id {kind}, n bigint, codes array<int>, times array<int>"), "term-vectors")


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def rows_of(starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of the chosen sparse rows, and where each row begins among them."""
    sizes = starts[chosen + 1] - starts[chosen]
    begins = np.cumsum(sizes) - sizes
    return np.repeat(starts[chosen] - begins, sizes) + np.arange(int(sizes.sum())), begins


class BallTree:
    """Balls over sparse rows (none empty): heap of nodes with children, centroid and radius."""

    def __init__(self, starts: np.ndarray, codes: np.ndarray, values: np.ndarray, width: int):
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray] = []
        self.centres: list[tuple[np.ndarray, np.ndarray]] = []
        self.radius: list[float] = []
        norms = np.add.reduceat(values * values, starts[:-1])
        todo = [(np.arange(len(starts) - 1), -1, 0)]
        dense = np.zeros(width)
        while todo:
            rows, parent, side = todo.pop()
            at, begins = rows_of(starts, rows)
            own, value = codes[at], values[at]
            used, place = np.unique(own, return_inverse=True)
            centre = np.bincount(place, weights=value) / len(rows)
            square = float(centre @ centre)
            gap = norms[rows] - 2 * np.add.reduceat(value * centre[place], begins) + square
            # the difference of squares may lose digits: what it may lose is added
            spread = float(np.sqrt(np.max(np.maximum(gap, 0) + ROUNDING * (norms[rows] + square))))
            number = len(self.children)
            self.children.append(None)
            self.members.append(rows)
            self.centres.append((used, centre))
            self.radius.append(spread)
            if parent >= 0:
                pair = self.children[parent] or (-1, -1)
                self.children[parent] = (number, pair[1]) if side == 0 else (pair[0], number)
            if len(rows) <= LEAF:
                continue

            def products(row: int, at=at, own=own, value=value, begins=begins) -> np.ndarray:
                mine = slice(starts[row], starts[row + 1])
                dense[codes[mine]] = values[mine]
                out = np.add.reduceat(value * dense[own], begins)
                dense[codes[mine]] = 0
                return out

            far = rows[int(np.argmax(gap))]
            to_far = products(far)
            other = rows[int(np.argmax(norms[rows] - 2 * to_far))]
            order = np.argsort(to_far - products(other), kind="stable")
            half = len(rows) // 2
            todo += [(np.sort(rows[order[half:]]), number, 1), (np.sort(rows[order[:half]]), number, 0)]

    def bounds(self, spots: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """An upper bound of the product of each node's rows with each query, rounded up.

        ``spots``: the column of ``queries`` for each code, or -1.
        """
        centres = np.zeros((len(self.children), queries.shape[1]))
        for k, (used, centre) in enumerate(self.centres):
            at = spots[used]
            centres[k, at[at >= 0]] = centre[at >= 0]
        lengths = np.sqrt((queries * queries).sum(axis=1))
        return (centres @ queries.T + np.outer(self.radius, lengths)) * (1 + ROUNDING) + 1


class Search:
    """All items against blocks of documents; keeps the best of each item."""

    def __init__(self, items: Items, weights: np.ndarray, top: int):
        self.items, self.weights, self.top = items, weights, top
        self.best: list[list[tuple[int, int]]] = [[] for _ in items.numbers]  # (-score, place), ascending
        self.roots = np.sqrt(np.maximum(weights, 0).astype(np.float64))
        self.scored = 0  # rows scored at leaves

    def add(self, places: np.ndarray, starts: np.ndarray, codes: np.ndarray, scores: np.ndarray) -> None:
        """Search one block: sparse rows of integer term scores, none empty, places ascending."""
        width = len(self.weights)
        tree = BallTree(starts, codes, scores * self.roots[codes], width)
        leaves: dict[int, tuple] = {}
        spots, dense = np.full(width, -1), np.zeros(width, np.int64)
        for low in range(0, len(self.best), GROUP):
            high = min(low + GROUP, len(self.best))
            a, b = self.items.starts[low], self.items.starts[high]
            used, column = np.unique(self.items.codes[a:b], return_inverse=True)
            if not len(used):
                continue
            spots[used] = np.arange(len(used))
            queries = np.zeros((high - low, len(used)))
            owner = np.repeat(np.arange(high - low), np.diff(self.items.starts[low:high + 1]))
            queries[owner, column] = self.items.times[a:b] * self.roots[used[column]]
            bounds = tree.bounds(spots, queries).T.tolist()
            spots[used] = -1
            for item in range(low, high):
                mine = slice(self.items.starts[item], self.items.starts[item + 1])
                own = self.items.codes[mine]
                dense[own] = self.items.times[mine] * self.weights[own]
                self.search(item, tree, bounds[item - low], leaves, (places, starts, codes, scores), dense)
                dense[own] = 0

    def search(self, item: int, tree: BallTree, bounds: list[float], leaves: dict, block: tuple, dense: np.ndarray) -> None:
        best = self.best[item]
        least = -best[-1][0] if len(best) == self.top else 1
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= least:
            bound, node = heapq.heappop(heap)
            if (pair := tree.children[node]) is not None:
                for child in pair:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (max(bound, -bounds[child]), child))
                continue
            if node not in leaves:
                at, begins = rows_of(block[1], tree.members[node])
                leaves[node] = block[2][at], block[3][at], begins, block[0][tree.members[node]]
            codes, scores, begins, places = leaves[node]
            exact = np.add.reduceat(scores * dense[codes], begins)
            self.scored += len(places)
            good = np.flatnonzero(exact >= least)
            if len(good):
                best += zip((-exact[good]).tolist(), places[good].tolist(), strict=True)
                best.sort()
                del best[self.top:]
                least = -best[-1][0] if len(best) == self.top else 1


def term_scores(times: np.ndarray, sizes: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The integer score of each entry: its occurrences against the length ``sizes`` of its document."""
    lengths = np.array([25 + (75 * n * documents) // terms for n in sizes.tolist()], dtype=np.int64)
    times = times.astype(np.int64)
    return 1_000_000_000 * times // (1000 * times + 8 * lengths)


def search_block(docs: DataFrame, items: Items, top: int) -> DataFrame:
    """item_row, doc_id, score: the best documents of each task for a bounded block of items."""
    found = vectors(docs, items.terms)
    total = found.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    documents, terms = total[0], total[1] or 1
    seen = dict(found.select(F.explode("codes").alias("code")).groupBy("code").count().collect())  # a row for each term of the block
    weights = np.array([weight(documents, seen.get(k, 0)) for k in range(len(items.terms))], dtype=np.int64)
    plain = items._replace(terms=None)
    shared = docs.sparkSession.sparkContext.broadcast((plain, weights))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches):
        search, ids, place = Search(*shared.value, top), {}, 0
        parts, entries = [], 0

        def flush():
            nonlocal parts, entries
            if parts:
                places, sizes, codes, scores = (np.concatenate([p[i] for p in parts]) for i in range(4))
                search.add(places, np.concatenate([[0], np.cumsum(sizes)]), codes, scores)
                held = {p for best in search.best for _, p in best}
                for p in [p for p in ids if p not in held]:
                    del ids[p]
            parts, entries = [], 0

        for batch in batches:
            lists = batch.column("codes")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            codes, times = lists.flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            scores = term_scores(times, np.repeat(n, sizes), documents, terms) if len(times) else times.astype(np.int64)
            ends, row, values = np.cumsum(sizes), 0, batch.column("doc_id")
            while row < batch.num_rows:
                before = ends[row - 1] if row else 0
                stop = max(row + 1, int(np.searchsorted(ends, before + BLOCK_TERMS - entries, side="right")))
                some = row + np.flatnonzero(sizes[row:stop])
                if len(some):
                    parts.append((place + some, sizes[some], codes[before:ends[stop - 1]], scores[before:ends[stop - 1]]))
                    ids.update(zip((place + some).tolist(), values.take(pa.array(some)).to_pylist(), strict=True))
                    entries += int(ends[stop - 1] - before)
                if entries >= BLOCK_TERMS:
                    flush()
                row = stop
            place += batch.num_rows
        flush()
        rows = [(int(number), ids[p], -s) for number, best in zip(search.items.numbers, search.best, strict=True) for s, p in best]
        for a in range(0, len(rows), 10_000):
            part = list(zip(*rows[a:a + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], values.type), pa.array(part[2], pa.int64())], names=["item_row", "doc_id", "score"])

    # places within a task stand for the order of ids
    return found.sortWithinPartitions(F.col("doc_id").asc_nulls_last()).mapInArrow(task, f"item_row bigint, doc_id {kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each row of ``items``.

    Reads doc_id and text of ``docs``, item_id and text of ``items``; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    named = stage(items.select("item_id", text_of().alias("text")).withColumn("item_row", F.monotonically_increasing_id()), "items")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // ITEM_BYTES + 1
    out = None
    for block in range(blocks):
        held = read_items(named.where(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == block).select("item_row", "text"))
        if len(held.terms):
            best = search_block(docs, held, top)
            out = best if out is None else out.unionByName(best)
    if out is None:
        kind = StructType([named.schema["item_id"], docs.schema["doc_id"]])
        return spark.createDataFrame([], kind).selectExpr("item_id", "cast(null as int) as rank", "doc_id", "cast(null as bigint) as score")
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(named.select("item_row", "item_id"), "item_row").select("item_id", "rank", "doc_id", "score")
