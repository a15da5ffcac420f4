"""A training-data pipeline over ``documents``: STAGES in order, each on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.bpe import encode_documents
from emberline.llm.common import ready, table
from emberline.llm.line_dedup import dedup_lines
from emberline.llm.mixing import take_mix
from emberline.llm.quality import keep_good
from emberline.llm.queries import RANKS
from emberline.llm.simhash import keep_one
from emberline.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; the rules are learned from ``labels``.

    A null or empty text fails the base rule (fewer than 20 words) and goes. Repeated rows, rows that share a ``doc_id`` and rows
    without one are judged each by their own text; a very long text is judged whole. Without labels only the base rule
    counts. Other columns pass through, whatever their names; an empty table stays empty.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that many sources share; ``n_chars`` follows the text if the column is there.

    No row goes, even if none of its lines is left. A null text stays null, an empty one empty; a null source is no
    source. Of equal lines the one with the smallest ``doc_id`` (null first) and place stays; rows with one ``doc_id``, repeated ones too, are judged
    alike. A very long text is cut line by line as any other. Other columns pass through but for ``n_lines``, ``n_removed`` and
    ``_row``, which are not kept; an empty table stays empty.
    """
    out = dedup_lines(docs)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "_row")]
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in kept))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest ``doc_id``.

    Null and empty texts have fingerprint zero and are one group. Of rows that share a ``doc_id``, repeated ones too, the first by text
    stays; rows without a ``doc_id`` stay all. Very long texts are hashed whole, shingle by shingle. Other columns pass through but for ``_kept`` and
    ``_copy``, which are not kept; an empty table stays empty.
    """
    return keep_one(docs.drop("_kept", "_copy"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A text without words, null or empty, is never taken. A null source is a source, a null ``doc_id`` queues as an empty one. Rows that agree in
    ``doc_id``, source and number of words share their copies evenly, the first by text getting the rest. A very long
    text is taken whole or not at all. Other columns pass through but for those called ``_mix...``; an empty table stays empty.
    """
    return take_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left: a row for each row, with ``doc_id`` and ``source``.

    A null or empty text has no tokens; repeated rows give repeated results; null ids and sources pass through; very long texts go
    through in blocks; other columns are left out; an empty table gives an empty result.
    """
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ("doc_id", "source"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]

#: SQL can express neither the learned rules nor the fingerprints; tests compare the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``; each stage but the last is written and read again."""
    docs = table(ready(spark), sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
