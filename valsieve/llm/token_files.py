"""Token counts from flat token files: a separator scan.

A flat file holds token ids and nothing else: little-endian numbers of two or four
bytes, each document closed by one end-of-document id, no index.

``scan`` cuts files into blocks of equal size that tasks read by byte range, finds
the separators of a block in one vectorised comparison, and returns their places.
A document can begin in an earlier block: where it begins and how many documents
came before are prefix scans over blocks (a running maximum of separator places
and a running sum of their number), in two levels, so that no task holds the
blocks of a whole file.

``write`` encodes documents into such files in the shared folder.  Each task
attempt writes a file of its own and returns its name with the ids in order; only
rows of attempts that Spark committed name the files that are read, so a lost
executor leaves at most a file that nothing reads.

Files are opened by their address (``file``, ``hdfs``, ``s3``, ...), never through
local paths.  An empty file has no documents.  Tokens behind the last separator are
a document that is not ``closed``.  A file whose size isn't a multiple of the token
size is refused.  Null texts count as empty and have no tokens.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valsieve.llm.common import pieces, ship, stage, text_of, texts_of
from valsieve.session import shared_folder

#: Tokens of a block, and blocks of one group of the two-level prefix scan.
BLOCK_TOKENS, GROUP_BLOCKS = 1 << 20, 1024
KINDS = {2: "<u2", 4: "<u4"}


def opened(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address if "://" in address else f"file://{address}")


def load_encoding(path: str, pattern: str):
    """A tiktoken encoding from a ranks file."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, size: int = 2) -> DataFrame:
    """Flat files of all documents; returns file, ordinal, doc_id (staged)."""
    ship(docs.sparkSession)
    folder = f"{shared_folder(docs.sparkSession)}/llm-flat-{uuid.uuid4().hex}"
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype=KINDS[size]).tobytes()

    def task(batches):
        encoding = load_encoding(vocabulary, pattern)
        store, root = opened(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        store.create_dir(root, recursive=True)
        listed, count = [], 0
        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in pieces(batches, "text", 1 << 20):
                for text in texts_of(batch).to_pylist():
                    out.write(np.asarray(encoding.encode_ordinary(text), dtype=KINDS[size]).tobytes())
                    out.write(end)
                listed.append(pa.RecordBatch.from_pydict({
                    "file": pa.array([f"{folder}/{name}"] * batch.num_rows, pa.string()),
                    "ordinal": pa.array(range(count, count + batch.num_rows), pa.int64()), "doc_id": batch.column("doc_id")}))
                count += batch.num_rows
        yield from listed  # ids only, once the file is complete

    read = docs.select("doc_id", text_of().alias("text"))
    return stage(read.mapInArrow(task, f"file string, ordinal bigint, doc_id {kind}"), "flat-manifest")


def blocks_of(files: DataFrame, size: int, block_tokens: int) -> DataFrame:
    """file, block, first, tokens: the byte ranges of all ``files`` (a column of addresses)."""
    def task(batches):
        for batch in batches:
            names, tokens = batch.column("file").to_pylist(), []
            for name in names:
                store, path = opened(name)
                length = store.get_file_info(path).size
                if length is None or length % size:
                    raise ValueError(f"{name} doesn't hold whole tokens of {size} bytes")
                tokens.append(length // size)
            yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "all_tokens": pa.array(tokens, pa.int64())})

    sized = files.select("file").mapInArrow(task, "file string, all_tokens bigint").where("all_tokens > 0")
    last = F.expr(f"(all_tokens - 1) div {block_tokens}")
    cut = sized.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    first = F.col("block") * block_tokens
    cut = cut.select("file", "block", first.alias("first"), F.least(F.lit(block_tokens), F.col("all_tokens") - first).alias("tokens"))
    return cut.repartition("file", "block")


def separators(blocks: DataFrame, end_id: int, size: int) -> DataFrame:
    """Each block with the places (in tokens, from the begin of the file) of its separators."""
    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                name, first, tokens = (row.column(n)[0].as_py() for n in ("file", "first", "tokens"))
                store, path = opened(name)
                with store.open_input_file(path) as file:
                    raw = file.read_at(tokens * size, first * size)
                if len(raw) != tokens * size:
                    raise ValueError(f"{name} is shorter than it was")
                found = np.flatnonzero(np.frombuffer(raw, dtype=KINDS[size]) == end_id) + first
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(n) for n in ("file", "block", "first", "tokens")), pa.array([found], pa.list_(pa.int64()))],
                    names=["file", "block", "first", "tokens", "ends"])

    return blocks.mapInArrow(task, "file string, block bigint, first bigint, tokens bigint, ends array<bigint>")


def scan(files: DataFrame, end_id: int, size: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of flat files (a column ``file`` of addresses): file, ordinal, start, n_tokens, closed."""
    ship(files.sparkSession)
    found = stage(separators(blocks_of(files, size, block_tokens), end_id, size), "separators")
    narrow = found.select(
        "file", "block", F.expr(f"block div {GROUP_BLOCKS}").alias("part"), F.size("ends").cast("bigint").alias("count"),
        F.array_max("ends").alias("last"), (F.col("first") + F.col("tokens")).alias("stop"))
    groups = narrow.groupBy("file", "part").agg(F.sum("count").alias("count"), F.max("last").alias("last"))
    # Level 1: over groups of a file; level 2: over the blocks of a group.
    groups = groups.select(
        "file", "part",
        F.expr("coalesce(sum(count) OVER (PARTITION BY file ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before"),
        F.expr("max(last) OVER (PARTITION BY file ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("behind"))
    inside = "OVER (PARTITION BY file, part ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    within = narrow.select(
        "file", "part", "block", F.expr(f"coalesce(sum(count) {inside}, 0)").alias("own"), F.expr(f"max(last) {inside}").alias("own_last"))
    carried = within.join(groups, ["file", "part"]).select(
        "file", "block", (F.col("before") + F.col("own")).alias("offset"),
        (F.coalesce("own_last", "behind", F.lit(-1)) + 1).alias("begin"))
    stitched = found.join(carried, ["file", "block"])
    exploded = stitched.select("file", "offset", "begin", "ends", F.posexplode("ends").alias("at", "end"))
    before = F.when(F.col("at") == 0, F.col("begin")).otherwise(F.try_element_at("ends", F.greatest("at", F.lit(1))) + 1)
    closed = exploded.select(
        "file", (F.col("offset") + F.col("at")).alias("ordinal"), before.alias("start"), (F.col("end") - before).alias("n_tokens"), F.lit(True).alias("closed"))
    # Tokens behind the last separator of a file.
    totals = narrow.groupBy("file").agg(F.sum("count").alias("ordinal"), F.max("last").alias("last"), F.max("stop").alias("stop"))
    start = F.coalesce(F.col("last") + 1, F.lit(0))
    rest = totals.select("file", "ordinal", start.cast("bigint").alias("start"), (F.col("stop") - start).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest.where("n_tokens > 0"))


def document_tokens(docs: DataFrame, vocabulary: str, pattern: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens of every row: written to flat files, and counted by the scan."""
    manifest = write(docs, vocabulary, pattern, end_id)
    found = scan(manifest.select("file").distinct(), end_id)
    return manifest.join(found, ["file", "ordinal"], "left").select("doc_id", "n_tokens")


def count_tokens(spark: SparkSession, addresses: list[str], end_id: int, size: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``scan`` of named files."""
    return scan(spark.createDataFrame([(a,) for a in addresses], "file string"), end_id, size, block_tokens)
