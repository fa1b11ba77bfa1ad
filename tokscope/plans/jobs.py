"""End-to-end jobs: the three programs of the analysed tool, as Spark jobs.

Each job reads its inputs, composes the operators of this package and
writes its outputs; nothing passes through the driver except config-sized
values (a tokenizer file, a few counts).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tokscope.functions.text import CJK_RANGES
from tokscope.operators.bytematch import corpus_token_metrics
from tokscope.operators.frequency import token_frequency, top_k
from tokscope.operators.mergegraph import closure_to_text, merge_closure, merge_edges, require_resolved
from tokscope.operators.ranking import descendant_frequency, rank_by_survival_ratio, rarest_script_tokens, zero_fill
from tokscope.operators.tokenizer import SparkTokenizer
from tokscope.sinks.writers import read_or_compute, write_frequencies, write_merge_closure, write_metrics, write_ranked
from tokscope.sources.tables import drop_empty_text, load_frequencies
from tokscope.sources.vocab import vocab_with_bytes


def count_token_frequencies(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, out_path: str, text_col: str = "text", report: int = 20
) -> DataFrame:
    """Corpus -> ``{"<id>": count}`` JSON (K1); returns the top ``report`` tokens (K5).

    Exact for every tokenizer: split and byte-pair model run in Spark where they
    can be reproduced, else whole texts go through the library plug-in. Rows
    the plug-in fails on raise after the count is written, with their number.
    """
    tok = SparkTokenizer(spark, tokenizer_path)
    failures = Observation("encoder_failures")
    write_frequencies(token_frequency(drop_empty_text(docs, text_col), tok, text_col, failures), out_path, "json_object")
    if not tok.spec.native and (failed := failures.get["failed"]):
        raise RuntimeError(f"{failed} of {failures.get['rows']} texts could not be encoded; the counts in {out_path} are without them")
    return top_k(load_frequencies(spark, out_path), report)


def score_vocabulary(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, out_csv: str, mode: str = "byte_level", text_col: str = "text"
) -> DataFrame:
    """Corpus + vocabulary -> metrics CSV (A9, K2); returns the metrics table.

    ``mode`` says how token strings spell bytes (``byte_level`` for GPT-2
    style vocabularies, ``text`` for character-level ones).
    """
    vocab = vocab_with_bytes(SparkTokenizer(spark, tokenizer_path).vocab, mode)
    metrics = corpus_token_metrics(drop_empty_text(docs, text_col), vocab, text_col)
    write_metrics(metrics, out_csv)
    return metrics


def rank_script_tokens(
    spark: SparkSession,
    tokenizer_path: str,
    freq_path: str,
    out_dir: str,
    ranges: Sequence[tuple[int, int]] = CJK_RANGES,
    mode: str = "byte_level",
) -> DataFrame:
    """Vocabulary + frequencies -> closure JSON (K3, reused when saved: K6) and
    the two rankings (R2 by frequency, R3 by survival ratio, K4).

    Returns the survival ranking.
    """
    tok = SparkTokenizer(spark, tokenizer_path)
    vocab = tok.vocab
    decoded = vocab_with_bytes(vocab, mode)
    edges, unresolved = merge_edges(tok.merges, vocab)
    require_resolved(unresolved)
    # The saved closure is keyed by the file's content: another tokenizer in the same folder gets its own.
    closure = read_or_compute(spark, f"{out_dir}/closure_table-{tok.spec.digest}", lambda: merge_closure(edges))
    write_merge_closure(closure, closure_to_text(closure, decoded, edges), f"{out_dir}/include", f"{out_dir}/include_str")
    filled = zero_fill(vocab, load_frequencies(spark, freq_path))
    rarest = rarest_script_tokens(descendant_frequency(closure, filled), decoded, ranges)
    write_ranked(rarest, f"{out_dir}/by_frequency", "freq", ("token_id",))
    ranked = rank_by_survival_ratio(rarest)
    write_ranked(ranked, f"{out_dir}/by_ratio", "ratio", ("freq", "token_id"))
    return spark.read.json(f"{out_dir}/by_ratio").orderBy("rank").select(
        "rank", "token_id", "token", "freq", "descendant_freq", F.col("ratio")
    )
