"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input.

Rejected by the quality classifier: gone.  Repeated lines: cut.  Near duplicates: one of each group stays.  Documents that
contain benchmark passages: gone.  The rest is encoded with a SentencePiece model.

Every stage takes ``doc_id`` and ``text`` and keeps all columns of its documents, whatever their names; ``n_chars`` is an input of the quality score where
it is there, and follows the text when lines are cut.  A null text is empty, an empty text is a document.  A null ``doc_id`` is a document too: no two
of them are one document, and none is a copy.  Rows that repeat a ``doc_id`` are judged each by its own text, until of near duplicates one
stays.  Texts of any length are read whole.  No documents: no rows, of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, line_dedup, quality, sentencepiece_wfst, simhash
from loomgraph.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``quality.THRESHOLD`` or more, by a machine fitted to the labelled ones; without labels all stay."""
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents hold stay in the one of the largest ``doc_id`` only."""
    done = line_dedup.dedup_lines(docs)
    n_chars = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return done.withColumns(n_chars).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are near (three words, three bits) or linked through such, the one of the smallest ``doc_id`` stays."""
    return simhash.deduplicated(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words one in twenty or more lies in 13 words that a benchmark item has, or in a whole shorter item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns without ``text``, and ``ids``, ``n_tokens``, ``ids_crc32``, ``round_trip`` (suffixed where there are such)."""
    model = sentencepiece_wfst.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_wfst.encoded(docs, model, ("ids", "n_tokens", "ids_crc32", "round_trip"), with_text=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("tokens", token_stage),
]

#: Neither a trained classifier nor fingerprints and encodings can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a row for each document that is left."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
