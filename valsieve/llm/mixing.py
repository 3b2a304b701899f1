"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

The weight of a document is its number of words.  Weights are summed by cell
(source, language, topic), the table of cells is raked in turn to the wanted
shares of sources, languages and topics, and a document stays with the
probability of its cell: the raked weight over the present one, scaled.  The draw
is a hash of the id, so it doesn't depend on how rows are stored, and equal runs
keep equal documents.

The scale is one of two.

* With ``share``, the sample has that part of all tokens (``sample`` has ``SAMPLE_SHARE``).  A
  cell gives at most what it has: such cells stay whole, the others are raked
  further until the margins hold, and a last scale meets the stated part.  A tiny
  cell can't thin the rest.  A value that has fewer tokens than its target stays
  whole, and the other values of its margin share what it lacks.
* Without, the largest probability is 1 (``mix`` and the registered query): no cell
  is short of its target, so the smallest cell for its target sets the size of
  the sample, which can be far below the table's.

Topics are the forms a text can take, told by fixed patterns (``topic_of``); a
table with its own topics passes another expression.

Targets are shares of tokens.  Without given ones they are the present shares to
the power ``FLATTEN``, which takes from large sources and languages and gives to
small ones.  A target share of a value that no document has is ignored; a value
without a target keeps its present share; a target of zero empties its cells.
Where empty cells make targets contradict each other, the margin raked last holds.
Missing sources, languages and topics are a value of their own, and null texts
count as empty: documents without words stay with the probability of their cell.
Rows that repeat an id are drawn together.  Missing ids are drawn as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valsieve.llm.common import named_back, numbered_columns, stage, text_of

MARGINS = ("source", "lang", "topic")
#: Rounds of raking; after so many the margins of tables like these hold to about 1e-9.
ROUNDS = 12
#: Rounds whose lineage is kept before the cells are written to the shared folder.
ROUNDS_KEPT = 4
FLATTEN = 0.9
#: Part of all tokens that ``sample`` keeps.
SAMPLE_SHARE = 0.6
#: Steps of the scale at most; each finds further cells to be whole, so few are needed.
SCALE_STEPS = 60
#: Topic and the pattern that tells it, the first that matches counts.
TOPICS = (
    ("table", r" \| "),
    ("symbols", r"[$%&#*]{3} "),
    ("shouting", r"!! "),
    ("licence", r"[Ll]icen[cs]ed? "),
)
REST = "prose"
NO_VALUE = "(none)"


def topic_of(text: Column) -> Column:
    """The form of a text."""
    out = F.lit(REST)
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def words_in(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def draw_of(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def with_margins(docs: DataFrame, topic=topic_of) -> DataFrame:
    """source, lang and topic (never null) and the number of words, beside the given columns."""
    def value(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(NO_VALUE))

    return docs.withColumns({
        "m_source": value("source"), "m_lang": value("lang"), "m_topic": F.coalesce(topic(text_of()), F.lit(NO_VALUE)), "m_words": words_in(text_of())})


def shares(cells: DataFrame, margin: str, given: dict[str, float] | None, flatten: float) -> DataFrame:
    """value of the margin, its target share of all tokens (they sum to 1)."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("present"))
    total = sums.agg(F.sum("present").alias("total"))
    wanted = F.pow("present", F.lit(flatten)) if given is None else F.coalesce(
        *[F.when(F.col(margin) == k, F.lit(float(v)) * F.col("total")) for k, v in sorted(given.items())], F.col("present"))
    sums = sums.join(F.broadcast(total)).withColumn("raw", F.when(F.col("present") > 0, wanted).otherwise(0.0))  # total is one row
    whole = sums.agg(F.sum("raw").alias("whole"))
    return sums.join(F.broadcast(whole)).select(margin, F.coalesce(F.try_divide("raw", "whole"), F.lit(0.0)).alias("share"))


def scale_of(rows: DataFrame, tokens: str, weight: str, wanted: float) -> float:
    """The k whose min(tokens, k * weight) sum to ``wanted`` over all rows, or to all tokens with weight if these are fewer.

    The sum is concave in k, so Newton's steps from below never pass it, and end when no further row gets whole.
    """
    k, before = 0.0, -1
    for _ in range(SCALE_STEPS):
        whole = (F.col(weight) > 0) & (F.lit(k) * F.col(weight) >= F.col(tokens))
        r = rows.agg(
            F.sum(whole.cast("bigint")).alias("rows"), F.sum(F.when(whole, F.col(tokens))).alias("full"),
            F.sum(F.when(~whole, F.col(weight))).alias("open"), F.max(F.try_divide(F.when(~whole, F.col(tokens)).cast("double"), F.col(weight))).alias("end")).head()
        if r.rows == before or not r.open:
            break
        # Beyond ``end`` every row is whole.
        before, k = r.rows, min(max((wanted - float(r.full or 0)) / r.open, k), r.end)
    return k


def rake_whole(cells: DataFrame, targets: dict[str, dict[str, float]] | None, flatten: float, rounds: int, share: float) -> DataFrame:
    """Cells with ``weight``, the tokens expected of them: at most those they have, and ``share`` of all in sum."""
    targets = targets or {}
    wanted = share * float(cells.agg(F.sum("tokens").alias("n")).head().n or 0)
    now = cells.withColumn("weight", F.lit(share) * F.col("tokens"))
    for margin in MARGINS:
        column = f"m_{margin}"
        sums = stage(shares(cells, column, targets.get(margin), flatten).join(cells.groupBy(column).agg(F.sum("tokens").alias("has")), column), "margin")
        k = scale_of(sums, "has", "share", wanted)
        now = now.join(sums.select(column, F.least(F.col("has").cast("double"), F.lit(k) * F.col("share")).alias(f"goal_{margin}")), column)
    now = stage(now, "cells")
    whole, most = F.col("weight") >= F.col("tokens"), F.col("tokens").cast("double")
    for step in range(rounds):
        for margin in MARGINS:
            over, goal = f"OVER (PARTITION BY m_{margin})", F.col(f"goal_{margin}")
            now = now.withColumns({
                "held": F.expr(f"sum(weight) {over}"), "open": F.expr(f"sum(CASE WHEN weight < tokens THEN weight ELSE 0 END) {over}")})
            rest = F.col("held") - F.col("open")
            # Too much: all cells of the value give way.  Too little: those that aren't whole take the rest.
            now = now.withColumn("weight", F.when(F.col("held") >= goal, F.col("weight") * F.coalesce(F.try_divide(goal, F.col("held")), F.lit(0.0))).when(
                whole | (F.col("open") <= 0), F.col("weight")).otherwise(F.least(most, F.col("weight") * F.try_divide(goal - rest, F.col("open"))))).drop("held", "open")
        if (step + 1) % ROUNDS_KEPT == 0:
            now = stage(now, "raked")
    now = stage(now, "raked")
    k = scale_of(now, "tokens", "weight", wanted)
    return now.select(*cells.columns, F.least(most, F.lit(k) * F.col("weight")).alias("weight"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, flatten: float = FLATTEN, rounds: int = ROUNDS) -> DataFrame:
    """Cells (m_source, m_lang, m_topic, tokens) with ``weight``, their raked share of all tokens."""
    targets = targets or {}
    total = cells.agg(F.sum("tokens").cast("double").alias("all_tokens"))
    now = cells.join(F.broadcast(total)).select(*cells.columns, F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("weight"))  # one row
    for margin in MARGINS:
        column = f"m_{margin}"
        share = shares(cells, column, targets.get(margin), flatten).withColumnRenamed("share", f"share_{margin}")
        now = now.join(share, column)
    now = stage(now, "cells")
    for step in range(rounds):
        for margin in MARGINS:
            held = F.expr(f"sum(weight) OVER (PARTITION BY m_{margin})")
            now = now.withColumn("held", held).withColumn(
                "weight", F.when(F.col("held") > 0, F.col("weight") * F.col(f"share_{margin}") / F.col("held")).otherwise(0.0)).drop("held")
        if (step + 1) % ROUNDS_KEPT == 0:
            now = stage(now, "raked")
    return now.select(*cells.columns, "weight")


def probabilities(docs: DataFrame, targets=None, flatten: float = FLATTEN, rounds: int = ROUNDS, topic=topic_of, share: float | None = None) -> DataFrame:
    """One row per cell: m_source, m_lang, m_topic, tokens, weight, probability.

    ``weight`` is the raked share of all tokens, or with ``share`` the tokens expected in the sample.
    """
    if share is not None and not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    cells = stage(with_margins(docs, topic).groupBy("m_source", "m_lang", "m_topic").agg(F.sum("m_words").alias("tokens")), "counts")
    if share is not None:
        # Cells without tokens take nothing from any target: their documents stay.
        raked = rake_whole(cells, targets, flatten, rounds, share)
        return raked.withColumn("probability", F.least(F.lit(1.0), F.coalesce(F.try_divide("weight", "tokens"), F.lit(1.0))))
    raked = rake(cells, targets, flatten, rounds)
    factor = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    raked = stage(raked.withColumn("factor", factor), "factors")
    largest = raked.agg(F.max("factor").alias("largest"))
    # Cells without tokens take nothing from any target: their documents stay.
    return raked.join(F.broadcast(largest)).select(  # one row
        "m_source", "m_lang", "m_topic", "tokens", "weight", F.coalesce(F.try_divide("factor", "largest"), F.lit(1.0)).alias("probability"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, flatten: float = FLATTEN, rounds: int = ROUNDS, topic=topic_of,
        share: float | None = None) -> DataFrame:
    """Every row of ``docs`` with topic, number of words, probability, and whether it is sampled.

    Cells are as many as combinations of margins occur; Spark broadcasts their
    written table where its size allows and shuffles otherwise.
    """
    cells = stage(probabilities(docs, targets, flatten, rounds, topic, share).select("m_source", "m_lang", "m_topic", "probability"), "probabilities")
    named = with_margins(docs, topic).join(cells, ["m_source", "m_lang", "m_topic"], "left")
    return named.withColumn("sampled", draw_of(F.col("doc_id")) < F.col("probability"))


def sample(docs: DataFrame, targets=None, flatten: float = FLATTEN, rounds: int = ROUNDS, topic=topic_of, share: float | None = SAMPLE_SHARE) -> DataFrame:
    """The sampled rows of ``docs``, with their columns: ``share`` of the tokens."""
    plain = numbered_columns(docs, "doc_id", "text", "source", "lang").withColumnsRenamed(
        {"_doc_id": "doc_id", "_text": "text", "_source": "source", "_lang": "lang"})
    return named_back(mix(plain, targets, flatten, rounds, topic, share).where("sampled"), docs)
