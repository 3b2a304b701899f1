"""Shared steps: bounded pieces of Arrow batches, words, staged tables and row removal."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valsieve.session import stage_table

#: The white space of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


#: Bytes of one batch between Spark and Python.
BATCH_BYTES = 4 << 20
SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this library, once per application, as ``--py-files`` would.

    Batches between Spark and Python are bounded by bytes, as texts may be long.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    application = spark.sparkContext.applicationId
    if application in SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="library-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    SHIPPED.add(application)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once in the folder of ``spark.checkpoint.dir`` and read back."""
    return stage_table(df, f"llm-{name}")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a missing id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def pieces(batches, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds one row or at most ``limit`` bytes of ``column``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space of many texts at once.

    Returns the row of each word, the code of each word, and the distinct words.
    ``lower`` folds A-Z only.
    """
    if lower:
        # The offsets of a slice don't begin at 0 after a cast, which ``ascii_lower`` of
        # Arrow 23 gets wrong; joining arrays writes them anew.
        texts = pc.ascii_lower(pa.concat_arrays([texts, pa.array([], texts.type)]))
    lists = pc.ascii_split_whitespace(texts)
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if blank >= 0:
        keep = codes != blank
        rows, codes = rows[keep], codes[keep]
    return rows, codes, coded.dictionary


def starts_of(rows: np.ndarray, count: int) -> np.ndarray:
    """Where each row's words begin; one more entry for the end."""
    return np.searchsorted(rows, np.arange(count + 1))


def row_key() -> list[Column]:
    """What tells rows apart in narrow tables: the id and a hash of the text."""
    return [F.col("doc_id"), F.xxhash64(text_of()).alias("row_hash")]


def numbered_columns(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` with its columns as c0, c1, ... and copies of the needed ones under ``_name``.

    The columns of an input may have any names, so what an operator adds can't clash.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.withColumns({f"_{name}": plain[f"c{docs.columns.index(name)}"] for name in needed})


def named_back(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """Only the columns of ``docs``, under their names."""
    return kept.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def without_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Keep the rows of ``docs`` that ``decisions`` keeps, one of each repeated row.

    ``decisions`` is narrow and staged, with the keys of dropped and of repeated
    rows only: doc_id, row_hash, kept, copies (rows with this id and hash).  Spark
    broadcasts them where their written size allows it.
    """
    keyed = numbered_columns(docs, "doc_id", "text").withColumn("_hash", F.xxhash64(text_of("_text"))).drop("_text")
    away = decisions.select(F.col("doc_id").alias("gone_id"), F.col("row_hash").alias("gone_hash"), "kept")
    many = away.where("kept")

    def same(side: DataFrame):
        return keyed._doc_id.eqNullSafe(side.gone_id) & (keyed._hash == side.gone_hash)

    left = keyed.join(away, same(away), "left_anti")
    if not many.isEmpty():
        left = left.unionByName(keyed.join(many, same(many), "left_semi").dropDuplicates(["_doc_id", "_hash"]))
    return named_back(left, docs)


def join_hot(rows: DataFrame, groups: DataFrame, key: str, spread: str, salts: int = 16) -> DataFrame:
    """Left join ``rows`` to one row per ``key`` of ``groups``.

    A key may hold a third of all rows: they are dealt to ``salts`` tasks by
    ``spread``, and each (narrow) row of ``groups`` is repeated for every salt.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = groups.withColumn("_salt", F.explode(F.expr(f"sequence(0, {salts - 1})")))
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")
