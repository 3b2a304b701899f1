"""Registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valsieve.llm import ball_tree, bpe, chosen_path, exact_dedup, html_text, jaccard_join, licences, maxent_lm, mixing, periodic_runs, spotsigs, token_files, toxicity
from valsieve.llm.common import table

#: An id that the byte-level vocabulary leaves free.
END_OF_TEXT = 50256
QUERIES, ORACLES = {}, {}


def raking_sql() -> str:
    """The raking of the mixing operator, unrolled."""
    topic = " ".join(f"WHEN regexp_matches(body, '{pattern}') THEN '{name}'" for name, pattern in mixing.TOPICS)
    parts = [f"""
WITH d AS (SELECT doc_id, coalesce(source, '{mixing.NO_VALUE}') AS m_source, coalesce(lang, '{mixing.NO_VALUE}') AS m_lang, coalesce(text, '') AS body
  FROM documents),
w AS (SELECT doc_id, m_source, m_lang, CASE {topic} ELSE '{mixing.REST}' END AS m_topic,
  CAST(len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS m_words FROM d),
cells AS (SELECT m_source, m_lang, m_topic, CAST(sum(m_words) AS DOUBLE) AS tokens FROM w GROUP BY ALL)"""]
    names = [f"m_{m}" for m in mixing.MARGINS]
    for name in names:
        parts.append(f"s_{name} AS (SELECT {name}, pow(sum(tokens), {mixing.FLATTEN}) / sum(pow(sum(tokens), {mixing.FLATTEN})) OVER () AS share_{name} FROM cells GROUP BY {name})")
    parts.append(f"r0 AS (SELECT *, tokens / sum(tokens) OVER () AS weight FROM cells {' '.join(f'JOIN s_{n} USING ({n})' for n in names)})")
    for k in range(3 * mixing.ROUNDS):
        n = names[k % 3]
        parts.append(f"r{k + 1} AS (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {n}) > 0 THEN weight * share_{n} / sum(weight) OVER (PARTITION BY {n}) ELSE 0 END AS weight) FROM r{k})")
    parts.append(f"p AS (SELECT *, coalesce(CASE WHEN tokens > 0 THEN weight / tokens END / max(CASE WHEN tokens > 0 THEN weight / tokens END) OVER (), 1) AS probability FROM r{3 * mixing.ROUNDS})")
    return ",\n".join(parts) + """
SELECT doc_id, m_topic AS topic, m_words AS n_words, round(probability, 9) AS probability,
  CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < probability AS sampled
FROM w JOIN p USING (m_source, m_lang, m_topic)
"""


def query(sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_maxent_lm(spark, folder):
    """Log probability of every document under the hashed model and under the base."""
    return maxent_lm.held_out_scores(table(spark, folder, "documents"))


@query()
def op2_token_files(spark, folder):
    """Tokens of every document, counted in flat files of the whole table."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_files.document_tokens(table(spark, folder, "documents"), path, public_tokenizers.PATTERN, END_OF_TEXT)


@query()
def op3_toxicity(spark, folder):
    """Score of every document."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
""")
def op4_exact_dedup(spark, folder):
    """Groups of equal texts and the row of each that stays."""
    return exact_dedup.exact_groups(table(spark, folder, "documents")).drop("row_hash")


@query()
def op5_licences(spark, folder):
    """Licences of every document."""
    return licences.scan(table(spark, folder, "documents"))


@query()
def op6_html_text(spark, folder):
    """Main text of every page."""
    return html_text.extract(table(spark, folder, "pages"))


@query()
def op7_bpe(spark, folder):
    """Token numbers and digests of ids and decoded text of every document."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(table(spark, folder, "documents"), path, with_ids=False)


@query()
def op8_spotsigs(spark, folder):
    """Fingerprints of every document and of its edited text, and how near they are."""
    return spotsigs.fingerprints(table(spark, folder, "documents"))


@query()
def op9_jaccard_join(spark, folder):
    """Class and links of every document."""
    return jaccard_join.near_duplicates(table(spark, folder, "documents")).drop("row_hash", "component")


@query(raking_sql())
def op10_mixing(spark, folder):
    """Calibrated probability of every document, and whether it is sampled."""
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.selectExpr("doc_id", "m_topic AS topic", "m_words AS n_words", "round(probability, 9) AS probability", "sampled")


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
totals AS (SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS terms FROM d WHERE len(words) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, totals GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
""")
def op11_ball_tree(spark, folder):
    """The ten best documents of every benchmark item."""
    return ball_tree.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op12_periodic_runs(spark, folder):
    """Runs of every document and the text without their repeats, as digests."""
    return periodic_runs.marked_runs(table(spark, folder, "documents"))


@query()
def op13_chosen_path(spark, folder):
    """Shingles and component of every document."""
    return chosen_path.near_duplicates(table(spark, folder, "documents"))
