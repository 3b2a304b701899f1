"""Exact dedup by content-defined chunk recipes; DataFrame functions only.

Two texts are equal when they are identical after every run of ASCII white space
is one space.  A text is cut at places that its own content defines: after at
least ``MIN_CHUNK`` letters, behind the first word that ends in one of a few
letters, and at the latest after ``MAX_CHUNK``.  Equal texts are cut alike, and
an edit moves only the cuts near it.

1. Each distinct chunk goes once through a shuffle, pre-aggregated by task, and
   its 64-bit identifier is verified: two contents under one identifier are told
   apart by their rank.
2. A document's recipe is the ordered list of identifiers, computed where the
   row is read.  Groups of equal documents are groups of equal recipes; whole
   texts are never moved or compared again.

Null texts count as empty; all empty texts are equal and have an empty recipe.
Missing ids come last when the row to keep is chosen.  Of rows that repeat both
id and text one is kept.  An empty table gives an empty result, and other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valsieve.llm.common import SPACE, join_hot, row_key, stage, text_of, without_rows

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Lazy: the first cut place after the minimum; without one, as much as a chunk may hold.
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?[dnrst.,;] |.{{1,{MAX_CHUNK}}}"


def hash_of(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def normal_text() -> Column:
    return F.regexp_replace(text_of(), SPACE, " ")


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def clashes(docs: DataFrame, identifier: Callable[[Column], Column]) -> DataFrame:
    """Chunks whose identifier is shared by another content: id, chunk, rank (from 0)."""
    distinct = (
        docs.select(F.explode(chunks_of(normal_text())).alias("chunk"))
        .select(identifier(F.col("chunk")).alias("id"), "chunk").groupBy("id", "chunk").agg(F.count("*").alias("uses"))
    )
    shared = distinct.groupBy("id").agg(F.count("*").alias("contents")).where("contents > 1").select("id")
    shared = stage(shared, "shared-ids")
    if shared.isEmpty():
        return None
    return stage(
        distinct.join(shared, "id").selectExpr(
            "id", "chunk", "row_number() OVER (PARTITION BY id ORDER BY chunk) - 1 AS rank"), "clashes")


def recipes(docs: DataFrame, identifier: Callable[[Column], Column]) -> DataFrame:
    """doc_id, row_hash, row, text_sha256, recipe: one narrow row per row of ``docs``."""
    clashing = clashes(docs, identifier)
    read = docs.select(*row_key(), normal_text().alias("text")).select(
        "doc_id", "row_hash", F.sha2("text", 256).alias("text_sha256"), chunks_of(F.col("text")).alias("chunks"))
    if clashing is None:
        listed = read.withColumn("recipe", F.transform("chunks", identifier)).drop("chunks")
        return stage(listed.withColumn("row", F.monotonically_increasing_id()), "recipes")
    numbered = read.withColumn("row", F.monotonically_increasing_id())
    parts = numbered.select("doc_id", "row_hash", "text_sha256", "row", F.posexplode_outer("chunks").alias("at", "chunk"))
    parts = parts.withColumn("id", identifier(F.col("chunk")))
    told = parts.join(clashing, ["id", "chunk"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    item = F.when(F.col("at").isNotNull(), F.struct("at", "id", "rank"))
    listed = told.groupBy("doc_id", "row_hash", "text_sha256", "row").agg(F.sort_array(F.collect_list(item)).alias("recipe"))
    return stage(listed, "recipes")


def exact_groups(docs: DataFrame, identifier: Callable[[Column], Column] = hash_of) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_hash, keep_id, group_size, kept, text_sha256."""
    listed = recipes(docs, identifier)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("first")
    groups = listed.groupBy("recipe").agg(first, F.count("*").alias("group_size"))
    groups = groups.select("recipe", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")
    # A group of one needs no partner; only larger groups go into the join.
    joined = join_hot(listed, groups.where("group_size > 1"), "recipe", "row")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", "row_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the smallest id."""
    decided = exact_groups(docs).groupBy("doc_id", "row_hash").agg(
        F.max("kept").alias("kept"), F.count("*").alias("copies")).where("not kept or copies > 1")
    return without_rows(docs, stage(decided, "exact-decisions"))
