"""Registered queries of this subpackage: thin digests of the operators, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.bpe import encode_documents
from emberline.llm.common import ready, table
from emberline.llm.context_tree import score_texts
from emberline.llm.embedding_dedup import embedding_groups
from emberline.llm.hard_negatives import hard_negatives
from emberline.llm.html_text import extract_text
from emberline.llm.lexical import TOP, rank_documents
from emberline.llm.license_windows import scan_license_texts
from emberline.llm.licenses import MIN_DICE, TEMPLATES, scan_licenses
from emberline.llm.line_dedup import MIN_SITES, dedup_lines
from emberline.llm.mixing import mix_sources
from emberline.llm.quality import BASE, quality_rules
from emberline.llm.simhash import simhash_groups
from emberline.llm.suffix_dedup import remove_repeats
from emberline.llm.warc import page_records, read_warc, write_warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Fixed value: the rank file of the public tokenizers that the byte-level BPE query uses.
RANKS = "byte_bpe_50k.tiktoken"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ready(spark), sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle.strip()
        return run

    return add


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op2_warc_zstd",
    """
    WITH hashed AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
    ),
    bits AS (
        SELECT *, array_to_string(list_transform(range(1, 41), lambda i: [
            '0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'
        ][strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS b
        FROM hashed
    ),
    coded AS (
        SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(
            list_transform(range(1, 6), lambda k: CAST(substr(b, 5 * i + k, 1) AS INTEGER) * [16, 8, 4, 2, 1][k])) AS BIGINT), 1)), '') AS payload_digest,
            min(page_id) OVER (PARTITION BY hex) AS first
        FROM bits
    )
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
    FROM coded
    """,
)
def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(read_warc(spark, write_warc(table(spark, sf_dir, "pages"))))


@query(
    "op3_line_dedup",
    rf"""
    WITH lines AS (
        SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
        FROM documents
    ),
    shared AS (
        SELECT line, min((doc_id, place)) AS first FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
        GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
    ),
    marked AS (
        SELECT l.doc_id, l.place, l.line, s.line IS NOT NULL AND (l.doc_id, l.place) <> s.first AS gone FROM lines l LEFT JOIN shared s ON l.line = s.line
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query(
    "op4_mix_sources",
    r"""
    WITH sizes AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
            md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
        FROM documents
    ),
    totals AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes GROUP BY source
    ),
    weighed AS (
        SELECT *, CAST([5, 2, 1][CAST(rank % 3 AS INTEGER) + 1] AS BIGINT) AS weight, CAST(2 * source_size AS DOUBLE) AS cap,
            1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget
        FROM totals
    ),
    levels AS (
        SELECT *, (budget - CAST(coalesce(sum(cap) OVER w, 0) AS DOUBLE)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
        FROM weighed WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    found AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, rank LIMIT 1),
    targets AS (SELECT source, rank, source_size, budget, least(cap, (SELECT level FROM found) * weight) AS target FROM levels),
    queued AS (
        SELECT s.doc_id, s.size, s.key, t.rank, t.source_size, t.target, t.budget,
            CAST(sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent
        FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    ),
    copies AS (
        SELECT *, CASE WHEN target > 0 THEN CAST(sent + epoch * source_size AS DOUBLE) / target ELSE 0 END AS finish
        FROM queued CROSS JOIN (VALUES (0), (1)) e(epoch)
    ),
    line AS (
        SELECT *, sum(size) OVER (ORDER BY finish, rank, key, doc_id, epoch, size ROWS UNBOUNDED PRECEDING) AS mixed FROM copies
    )
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
        CAST(coalesce(sum(size) FILTER (mixed <= budget), 0) AS BIGINT) AS taken
    FROM line GROUP BY doc_id, size, source_size, target
    """,
)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op6_embedding_dedup")
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def _license_sql() -> str:
    names = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES.items())
    normal = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
    WITH templates AS (
        SELECT name, {pairs.format("w")} AS pairs FROM (SELECT name, string_split({normal.format("text")}, ' ') AS w FROM (VALUES {names}) t(name, text))
    ),
    blocks AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
    ),
    cut AS (
        SELECT doc_id, line, {pairs.format("w")} AS pairs FROM (SELECT doc_id, line, string_split({normal.format("block")}, ' ') AS w FROM blocks)
    ),
    scored AS (
        SELECT doc_id, line, name, 2.0::DOUBLE * len(list_intersect(c.pairs, t.pairs)) / (len(c.pairs) + len(t.pairs)) AS dice
        FROM cut c JOIN templates t ON len(c.pairs) BETWEEN len(t.pairs) / 2 AND len(t.pairs) * 2
    ),
    hits AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, line, name) AS place, count(DISTINCT line) OVER (PARTITION BY doc_id) AS n_notices
        FROM scored WHERE dice >= {MIN_DICE}
    )
    SELECT d.doc_id, h.name AS license, h.dice, h.line, coalesce(h.n_notices, 0) AS n_notices
    FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id AND h.place = 1
    """


@query("op8_license_scan", _license_sql())
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op8_license_text")
def op8_license_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_license_texts(table(spark, sf_dir, "documents"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept")


@query(
    "op11_hard_negatives",
    """
    WITH rows AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ),
    pairs AS (
        SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
            CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
        FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WHERE a.vec_id % 100 = 0
    ),
    positives AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM pairs WHERE label = anchor_label)
        WHERE place <= 5
    ),
    found AS (
        SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
            CAST(row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
        FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND n.label <> n.anchor_label
        WHERE 80 * p.score <= 100 * n.score AND n.score <= p.score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op12_lm_scoring")
def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return score_texts(table(spark, sf_dir, "documents"), F.pmod(number, F.lit(5)) == 1)


@query(
    "op13_lexical_search",
    rf"""
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM documents
    ),
    postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    sizes AS (SELECT doc_id, sum(tf) AS n FROM postings GROUP BY doc_id),
    corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
    factors AS (SELECT doc_id, 50 + CAST(50 * n * docs AS BIGINT) // total AS m FROM sizes, corpus),
    asked AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ),
    weights AS (
        SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
        FROM postings, corpus GROUP BY term
    ),
    scored AS (
        SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
        FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN factors USING (doc_id)
        GROUP BY item_id, doc_id
    ),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= {TOP}
    """,
)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
