"""Corpus pipeline: from raw documents to packed training sequences.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)``,
works on all documents its predecessor kept and returns a DataFrame (all but
the last with the columns of ``documents``). ``run`` applies them, writing each
stage's result to the shared checkpoint folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokscope.llm.common import documents, read_table, written
from tokscope.llm.decontaminate import drop_contaminated
from tokscope.llm.line_dedup import dedup_lines
from tokscope.llm.ngram_join import ngram_components
from tokscope.llm.packing import pack_documents
from tokscope.llm.quality_lm import keep_good

#: Near duplicates in the pipeline: five-word n-grams, similarity of at least 0.8.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trusted-text model rejects go.

    Null and empty texts go; a language that trusted text does not cover keeps
    its documents; repeated rows are judged each; an empty table stays empty.
    """
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by many documents stay in one of them; ``n_chars`` follows the text.

    No document goes, repeated rows and an empty table included; a null text
    becomes an empty one. Columns named like the operator's results pass through.
    """
    aside = {c: f"__given_{i}" for i, c in enumerate(docs.columns) if c.lower() in ("n_lines", "n_dropped")}
    kept = dedup_lines(docs.withColumnsRenamed(aside)).drop("n_lines", "n_dropped")
    kept = kept.withColumnsRenamed({new: old for old, new in aside.items()})
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Documents without words are no duplicates and stay, and so do rows without an id. Rows that
    repeat the id that stays, stay with it.
    """
    groups = ngram_components(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)
    others = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; those without text, and all where there are no items, stay."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents as pieces of packed token sequences; a null text is its end id alone."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The language model, the component search and the packing plan are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the ``documents`` table of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", texts=True)
    return STAGES[-1][1](spark, docs, sf_dir)
