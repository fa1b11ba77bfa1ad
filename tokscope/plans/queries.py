"""Registered queries: ``(spark, sf_dir) -> DataFrame``, one per operator group.

Every query reads the driver tables (``documents``, ``conversations``)
and, where a vocabulary is needed, the fixture ``tokenizer.json``; the
vocabulary-only operators (merge graph) are registered together with the
corpus frequencies they feed, so their work grows with the corpus.
Computed columns carry the same names as the oracle SQL in ``oracle.py``;
doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokscope.functions.text import LATIN1_LETTER_RANGES, byte_length, contains_script, has_control_byte, replace_invalid, utf8_bytes
from tokscope.operators.batching import batch_by_chars, batch_by_count, batch_docs_newline, batch_lines, chunk_fixed, flatten
from tokscope.operators.bytematch import byte_token_frequency, neighbor_counts, neighbor_entropy
from tokscope.operators.encode import decode_sequences
from tokscope.operators.frequency import distinct_token_count, sort_by_frequency_desc, token_frequency, top_k
from tokscope.operators.mergegraph import closure_adjacency, closure_to_text, distinct_edges
from tokscope.operators.ranking import (
    entropy_rank_curve,
    ordered_by_ratio,
    ordered_rarest,
    rank_by_survival_ratio,
    rarest_script_tokens,
    shuffle_rows,
)
from tokscope.operators.sketches import distinct_sketches, merged_distinct, top_k_verified, within_error
from tokscope.operators.tokenizer import RankFile, bpe_ids, bpe_tokens, encode_documents, split_pieces
from tokscope.plans.context import Context
from tokscope.session import FIXTURE_BYTE_LEVEL_TOKENIZER, FIXTURE_UNIGRAM_TOKENIZER, FIXTURE_WORDPIECE_TOKENIZER, cut_columns, scratch_path, table_path
from tokscope.sinks.closure_store import ClosureStore
from tokscope.sinks.writers import read_or_compute, write_frequencies, write_merge_closure, write_metrics, write_ranked
from tokscope.sources.tables import (
    conversations_as_jsonl,
    corpus_from_jsonl_tree,
    line_count,
    load_frequencies,
    load_metrics,
    newline_count,
    parse_conversation_lines,
    scan_bytes,
    scan_conversations,
    scan_table,
    scan_text,
)

# Parameters of the registered queries (chosen once; not tuned to pass).
CHUNK_CHARS = 4096
BATCH_DOCS = 7
NEWLINE_BATCH_DOCS = 100
LINE_BATCH = 50
PACK_THRESHOLD = 65536
TOP_K = 20
CUT_BYTES = 40
ROUND = 6


def _ctx(spark: SparkSession, sf_dir: str) -> Context:
    return Context(spark, sf_dir)


# -- tokens and frequencies -------------------------------------------------------


def q_pretoken_count(spark, sf_dir):
    return _ctx(spark, sf_dir).pieces.select("piece", "n")


def q_token_frequency(spark, sf_dir):
    return _ctx(spark, sf_dir).freq


def q_sort_by_frequency_desc(spark, sf_dir):
    return sort_by_frequency_desc(_ctx(spark, sf_dir).freq)


def q_top_tokens_report(spark, sf_dir):
    return top_k(_ctx(spark, sf_dir).freq, TOP_K)


def q_distinct_token_count(spark, sf_dir):
    return distinct_token_count(_ctx(spark, sf_dir).freq)


def q_encode_distinct(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    enc = bpe_ids(c.pieces, c.tok.spec, c.merges, c.vocab)
    return enc.select("piece", "n", F.size("ids").alias("n_tokens"), F.array_join("ids", ",").alias("ids"))


def q_bpe_fold(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    folded = bpe_tokens(c.pieces, c.tok.spec, c.merges, c.vocab)
    return folded.select("piece", "n", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens"))


def q_token_frequency_byte_level(spark, sf_dir):
    """A1 with the byte-level fixture: look-ahead split, byte alphabet."""
    return Context(spark, sf_dir, FIXTURE_BYTE_LEVEL_TOKENIZER, vocab_mode="byte_level").freq


def q_encode_gpt(spark, sf_dir):
    """Token counts by a public rank file (``gpt``-style encoding), found on every machine by its package."""
    import public_tokenizers

    return token_frequency(_ctx(spark, sf_dir).docs, RankFile(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")))


def _encoded(spark, sf_dir, path):
    """Ids of every document, special tokens of the file's template included."""
    c = Context(spark, sf_dir, path)
    ids = encode_documents(c.docs.select("doc_id", "text"), c.tok.spec, c.merges, c.vocab, add_special_tokens=True)
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), F.array_join("ids", ",").alias("ids"))


def q_encode_wordpiece(spark, sf_dir):
    """T1 with a WordPiece file: normalizer, split, longest match first, template."""
    return _encoded(spark, sf_dir, FIXTURE_WORDPIECE_TOKENIZER)


def q_encode_unigram(spark, sf_dir):
    """T1 with a Unigram file: normalizer, word marks, best path by summed scores."""
    return _encoded(spark, sf_dir, FIXTURE_UNIGRAM_TOKENIZER)


def q_decode_sequence(spark, sf_dir):
    """T1 then T5: every document encoded and decoded back."""
    c = _ctx(spark, sf_dir)
    encoded = encode_documents(c.docs.select("doc_id", "text"), c.tok.spec, c.merges, c.vocab)
    return decode_sequences(encoded, c.vocab_bytes, "doc_id", vocab_rows=c.vocab_rows)


# -- merge graph, with the corpus frequencies it feeds ---------------------------------


def q_merge_edges(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    f = c.filled
    e = distinct_edges(c.edges)
    return (
        e.join(f.select(F.col("token_id").alias("ancestor"), F.col("freq").alias("ancestor_freq")), "ancestor")
        .join(f.select(F.col("token_id").alias("descendant"), F.col("freq").alias("descendant_freq")), "descendant")
        .select("ancestor", "descendant", "ancestor_freq", "descendant_freq")
    )


def q_merge_closure(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    f = c.filled.select(F.col("token_id").alias("descendant"), F.col("freq").alias("descendant_freq"))
    return c.closure.join(f, "descendant").select("ancestor", "descendant", "descendant_freq")


def q_closure_adjacency(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    used = c.closure.join(c.filled.filter("freq > 0").select(F.col("token_id").alias("descendant")), "descendant")
    used_n = used.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n_used"))
    adj = closure_adjacency(c.closure)
    return adj.join(used_n, "ancestor", "left").select(
        "ancestor",
        "n_descendants",
        F.array_join("descendants", ",").alias("descendants"),
        F.coalesce(F.col("n_used"), F.lit(0)).cast("long").alias("n_used"),
    )


def q_closure_to_text(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    txt = closure_to_text(c.closure, c.vocab_bytes, c.edges, vocab_rows=c.vocab_rows)
    return txt.join(c.filled, "token_id").select(
        "token_id", "token", F.array_join("descendants", "|").alias("descendants"), "freq"
    )


# -- ranking -------------------------------------------------------------------------


def q_zero_fill(spark, sf_dir):
    return _ctx(spark, sf_dir).filled


def q_descendant_frequency(spark, sf_dir):
    return _ctx(spark, sf_dir).with_descendants


def q_rarest_script_tokens(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    return ordered_rarest(rarest_script_tokens(c.with_descendants, c.vocab_bytes, LATIN1_LETTER_RANGES, c.vocab_rows))


def q_rank_by_survival_ratio(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    r = rank_by_survival_ratio(rarest_script_tokens(c.with_descendants, c.vocab_bytes, LATIN1_LETTER_RANGES, c.vocab_rows))
    return ordered_by_ratio(r).withColumn("ratio", F.round("ratio", ROUND))


# -- byte-level metrics ------------------------------------------------------------------


def q_byte_token_frequency(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    return c.with_hex(byte_token_frequency(c.pairs)).select("token_hex", "freq")


def q_standalone_frequency(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    return c.with_hex(byte_token_frequency(c.pairs)).select("token_hex", "standalone")


def q_neighbor_counts(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    return c.with_hex(neighbor_counts(c.pairs)).select("token_hex", "side", "byte", "count")


def q_neighbor_entropy(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    return c.with_hex(neighbor_entropy(c.pairs)).select("token_hex", F.round("entropy", ROUND).alias("entropy"))


def q_byte_level_frequency(spark, sf_dir):
    """J6 + A3/A4 with the byte-level fixture: raw token bytes, partial UTF-8 included."""
    c = Context(spark, sf_dir, FIXTURE_BYTE_LEVEL_TOKENIZER, vocab_mode="byte_level_raw")
    return c.with_hex(byte_token_frequency(c.pairs)).select("token_hex", "freq", "standalone")


def q_token_metrics(spark, sf_dir):
    m = _ctx(spark, sf_dir).metrics
    return m.select(
        "token_id",
        "token",
        "freq_in_corpus",
        F.round("standalone_ratio", ROUND).alias("standalone_ratio"),
        F.round("entropy", ROUND).alias("entropy"),
        "length_bytes",
        "meaningless",
    )


def q_entropy_rank_curve(spark, sf_dir):
    curve = entropy_rank_curve(_ctx(spark, sf_dir).kept_metrics)
    return curve.select("x", F.round("y", ROUND).alias("y"))


# -- predicates and projections ------------------------------------------------------------


def q_drop_empty_text(spark, sf_dir):
    return _ctx(spark, sf_dir).docs.select("doc_id", F.length("text").alias("n_chars"))


def q_contains_script(spark, sf_dir):
    return _ctx(spark, sf_dir).docs.select("doc_id", contains_script("text", LATIN1_LETTER_RANGES).alias("has_script"))


def q_filter_script_tokens(spark, sf_dir):
    p = _ctx(spark, sf_dir).pieces
    return p.filter(contains_script("piece", LATIN1_LETTER_RANGES)).select("piece", "n")


def q_has_control_byte(spark, sf_dir):
    d = _ctx(spark, sf_dir).docs
    return d.select("doc_id", has_control_byte(utf8_bytes("text")).alias("has_control"))


def q_byte_length(spark, sf_dir):
    d = _ctx(spark, sf_dir).docs
    return d.select("doc_id", byte_length(utf8_bytes("text")).alias("n_bytes"), F.length("text").alias("n_chars"))


# -- chunking and batching ------------------------------------------------------------------


def q_chunk_fixed(spark, sf_dir):
    return chunk_fixed(_ctx(spark, sf_dir).docs, CHUNK_CHARS)


def q_batch_by_count(spark, sf_dir):
    return batch_by_count(_ctx(spark, sf_dir).docs, BATCH_DOCS)


def q_batch_docs_newline(spark, sf_dir):
    return batch_docs_newline(_ctx(spark, sf_dir).docs, NEWLINE_BATCH_DOCS)


def q_batch_lines(spark, sf_dir):
    """B3 over the documents' lines, ordered by document then line."""
    d = _ctx(spark, sf_dir).docs
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "text"))
    b = batch_lines(lines, LINE_BATCH, order_col="doc_id", ties=("line_idx",))
    return b.select("batch_no", F.size("texts").cast("long").alias("n_lines"), F.array_join("texts", "\n").alias("text"))


def q_batch_by_chars(spark, sf_dir):
    return batch_by_chars(_ctx(spark, sf_dir).docs, PACK_THRESHOLD)


# -- sources ---------------------------------------------------------------------------------------


def _conversation_file(spark, sf_dir) -> str:
    """The conversations as a JSONL file, with lines that are broken or hold no text among them."""
    lines = conversations_as_jsonl(_ctx(spark, sf_dir).table("conversations"))
    number = F.get_json_object("value", "$.id").cast("long")
    broken = lines.filter(number % 5 == 0).select(F.lit("bad{").alias("value"))
    no_text = lines.filter(number % 7 == 0).select(F.lit('{"conversations":[{"content":5}]}').alias("value"))
    path = scratch_path(spark, "conversations-jsonl")
    lines.unionByName(broken).unionByName(no_text).write.text(path)
    return path


def q_scan_conversations(spark, sf_dir):
    """S3 over a JSONL file with bad lines."""
    return scan_conversations(spark, _conversation_file(spark, sf_dir)).select("conv_id", "content")


def q_skip_malformed(spark, sf_dir):
    """Lines of that file by whether they were kept."""
    parsed = parse_conversation_lines(spark.read.text(_conversation_file(spark, sf_dir)))
    return parsed.groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


def q_scan_table(spark, sf_dir):
    """Another text column, by name."""
    return scan_table(spark, table_path(sf_dir, "documents"), "lang", keep=("doc_id",))


def q_replace_invalid(spark, sf_dir):
    """Every text cut into pieces of so many bytes, cut characters replaced on both sides."""
    d = _ctx(spark, sf_dir).docs.select("doc_id", utf8_bytes("text").alias("raw"))
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / CUT_BYTES).cast("int"))
    pieces = d.select("doc_id", "raw", F.explode(starts).alias("piece"))
    return pieces.select("doc_id", "piece", replace_invalid(F.substring("raw", F.col("piece") * CUT_BYTES + 1, F.lit(CUT_BYTES))).alias("text"))


def q_flatten(spark, sf_dir):
    """Lists of lines, one row per line."""
    d = _ctx(spark, sf_dir).docs
    lists = d.select("doc_id", F.split("text", "\n", -1).alias("lines"))
    return flatten(lists, "lines", "line")


def q_empty_result_check(spark, sf_dir):
    """Whether counts of all documents, and of none, were worth writing."""
    c = _ctx(spark, sf_dir)
    some = write_frequencies(c.freq, scratch_path(spark, "freq-some"))
    none = write_frequencies(token_frequency(c.docs.filter("doc_id is null"), c.tok), scratch_path(spark, "freq-none"))
    n = c.docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return n.select("n_docs", F.lit(some).alias("some_written"), F.lit(none).alias("none_written"))


def q_reuse_closure(spark, sf_dir):
    """K6: the closure saved once and read back instead of computed again."""
    c = _ctx(spark, sf_dir)
    path = f"{scratch_path(spark, 'closure-reuse')}/{c.tok.spec.digest}"
    read_or_compute(spark, path, lambda: c.closure)

    def again():
        raise AssertionError("the saved closure must be reused")

    f = c.filled.select(F.col("token_id").alias("descendant"), F.col("freq").alias("descendant_freq"))
    return read_or_compute(spark, path, again).join(f, "descendant").select("ancestor", "descendant", "descendant_freq")


def _word_merges(docs: DataFrame) -> DataFrame:
    """Edges ``(ancestor, descendant)`` of merges that build each distinct lower-case word of ``a-z`` letter by letter."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    # Words that begin alike share their merges: the beginnings are made distinct, each has its two edges.
    begun = words.select(F.explode(F.expr("transform(sequence(2, greatest(length(w), 2)), i -> substring(w, 1, i))")).alias("descendant"))
    begun = begun.filter("length(descendant) > 1").distinct()
    parts = F.expr("array_distinct(array(left(descendant, length(descendant) - 1), right(descendant, 1)))")
    return begun.select(F.explode(parts).alias("ancestor"), "descendant")


def q_extend_closure(spark, sf_dir):
    """G1/K6 incremental: merges of the words of half of the documents are saved with their
    closure, then those of all documents arrive and extend it; descendants per ancestor."""
    docs = _ctx(spark, sf_dir).docs
    store = ClosureStore(spark, scratch_path(spark, "closure-store"))
    store.update(_word_merges(docs.filter("doc_id % 2 = 0")))
    pairs = store.update(_word_merges(docs))
    return pairs.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n_descendants"), F.sum(F.length("descendant")).alias("n_chars"), F.max("descendant").alias("last_descendant"))


def _pieces_by_source(spark, sf_dir) -> DataFrame:
    """``(source, piece)`` of every document, split as the tokenizer does."""
    c = _ctx(spark, sf_dir)
    return split_pieces(c.table("documents").select("source", "text"), c.tok.spec, keep=("source",)).select("source", "piece")


def q_distinct_pieces_sketched(spark, sf_dir):
    """A2 by one sketch per source, merged for all (null source, ``is_total``): exact count, and whether the estimate is within five standard errors."""
    # The texts are split once: a sketch, and a distinct count, of rows is that of the different ones.
    pieces = cut_columns(_pieces_by_source(spark, sf_dir).distinct())
    path = scratch_path(spark, "sketches")
    distinct_sketches(pieces, "piece", ["source"]).write.parquet(path)
    sketches = spark.read.parquet(path)
    exact = pieces.groupBy("source").agg(F.count("piece").alias("n")).withColumn("is_total", F.lit(False))
    exact = exact.unionByName(pieces.select("piece").distinct().agg(F.count("piece").alias("n")).selectExpr("string(null) as source", "n", "true as is_total"))
    estimate = merged_distinct(sketches, ["source"]).withColumn("is_total", F.lit(False))
    estimate = estimate.unionByName(merged_distinct(sketches).selectExpr("string(null) as source", "n_distinct", "true as is_total"))
    e, x = estimate.alias("e"), exact.alias("x")
    both = x.join(e, F.expr("x.source <=> e.source and x.is_total = e.is_total"))
    return both.select("x.source", "x.is_total", F.col("x.n").alias("n_distinct"), within_error(F.col("e.n_distinct"), F.col("x.n")).alias("within_error"))


def q_heavy_pieces(spark, sf_dir):
    """The most frequent pieces from one summary per source, verified."""
    return top_k_verified(_pieces_by_source(spark, sf_dir), "piece", TOP_K, by=["source"])


def q_line_count(spark, sf_dir):
    return line_count(_ctx(spark, sf_dir).docs)


def q_shuffle_rows(spark, sf_dir):
    return shuffle_rows(_ctx(spark, sf_dir).docs.select("doc_id", F.length("text").alias("n_chars")), seed=7)


def q_running_token_frequency(spark, sf_dir):
    from tokscope.streaming.running import running_token_frequency_table

    return running_token_frequency_table(spark, sf_dir)


def q_stateful_token_frequency(spark, sf_dir):
    from tokscope.streaming.stateful import stateful_token_frequency_table

    return stateful_token_frequency_table(spark, sf_dir)


def q_progress_metrics(spark, sf_dir):
    from tokscope.streaming.running import running_progress_table

    return running_progress_table(spark, sf_dir)


# -- sinks read back by the matching sources --------------------------------------------


def q_write_frequencies(spark, sf_dir):
    """K1 -> S7: the single JSON object written and parsed back."""
    path = scratch_path(spark, "freq-json")
    write_frequencies(_ctx(spark, sf_dir).freq, path, "json_object")
    return load_frequencies(spark, path)


def q_write_metrics(spark, sf_dir):
    """K2 -> S8: the metrics CSV written and read back."""
    path = scratch_path(spark, "metrics-csv")
    write_metrics(_ctx(spark, sf_dir).metrics, path)
    m = load_metrics(spark, path)
    return m.select(
        "token",
        "freq_in_corpus",
        F.round("standalone_ratio", ROUND).alias("standalone_ratio"),
        F.round("entropy", ROUND).alias("entropy"),
        "length_bytes",
        "meaningless",
    )


def q_write_ranked(spark, sf_dir):
    """K4: survival ranking written with its rank column and read back."""
    c = _ctx(spark, sf_dir)
    r = rank_by_survival_ratio(rarest_script_tokens(c.with_descendants, c.vocab_bytes, LATIN1_LETTER_RANGES, c.vocab_rows))
    path = scratch_path(spark, "ranked-json")
    write_ranked(r.withColumn("ratio", F.round("ratio", ROUND)), path, "ratio", ("freq", "token_id"))
    schema = "token_id int, token string, freq long, descendant_freq long, ratio double, rank long"
    return spark.read.schema(schema).json(path)


def _text_files(spark, sf_dir, ending: str = "") -> str:
    """Documents as text files, one folder per source, each followed by ``ending`` and a newline."""
    path = scratch_path(spark, "text-files")
    docs = _ctx(spark, sf_dir).table("documents").filter(F.col("text").isNotNull())
    docs.select(F.concat("text", F.lit(ending)).alias("value"), "source").write.partitionBy("source").text(path)
    return path


def q_scan_text(spark, sf_dir):
    """S1 + S9: CR LF text files read split at lines, newlines normalised; lines and characters counted."""
    rows = scan_text(spark, _text_files(spark, sf_dir, "\r"))
    return rows.agg(F.sum(newline_count(F.col("text"))).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def q_scan_bytes(spark, sf_dir):
    """The same files as raw bytes; every byte kept."""
    rows = scan_bytes(spark, _text_files(spark, sf_dir, "\r"))
    hexes = F.hex("bytes")
    pairs = F.regexp_extract_all(hexes, F.lit(".."), 0)
    return rows.agg(
        F.sum(F.octet_length("bytes")).alias("n_bytes"),
        F.sum(F.size(F.filter(pairs, lambda x: x == "0A"))).alias("n_newlines"),
        F.sum(F.size(F.filter(pairs, lambda x: x == "0D"))).alias("n_returns"),
    )


def q_write_merge_closure(spark, sf_dir):
    """K3: both closure files, parsed back: ids with descendant frequencies, and their texts."""
    c = _ctx(spark, sf_dir)
    ids_path, text_path = scratch_path(spark, "closure-ids"), scratch_path(spark, "closure-text")
    write_merge_closure(c.closure, closure_to_text(c.closure, c.vocab_bytes, c.edges, vocab_rows=c.vocab_rows), ids_path, text_path)
    obj = spark.read.text(ids_path).select(F.explode(F.from_json("value", "map<string,array<int>>")).alias("a", "ds"))
    pairs = obj.select(F.col("a").cast("int").alias("ancestor"), F.posexplode("ds").alias("i", "descendant"))
    named = spark.read.text(text_path).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("token", "names"))
    named = named.join(c.vocab_bytes.select(F.col("decoded").alias("token"), F.col("token_id").alias("ancestor")), "token")
    named = named.select("ancestor", F.posexplode("names").alias("i", "descendant_text"))
    f = c.filled.select(F.col("token_id").alias("descendant"), F.col("freq").alias("descendant_freq"))
    both = pairs.join(named, ["ancestor", "i"]).join(f, "descendant")
    return both.select("ancestor", "descendant", "descendant_freq", "descendant_text")


def q_corpus_from_jsonl_tree(spark, sf_dir):
    """Documents written as JSON lines under ``source=…`` folders, read back recursively."""
    path = scratch_path(spark, "jsonl-tree")
    _ctx(spark, sf_dir).table("documents").select("doc_id", "text", "source").write.partitionBy("source").json(path)
    return corpus_from_jsonl_tree(spark, path).select("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pretoken_count": q_pretoken_count,
    "token_frequency": q_token_frequency,
    "token_frequency_byte_level": q_token_frequency_byte_level,
    "sort_by_frequency_desc": q_sort_by_frequency_desc,
    "top_tokens_report": q_top_tokens_report,
    "distinct_token_count": q_distinct_token_count,
    "distinct_pieces_sketched": q_distinct_pieces_sketched,
    "heavy_pieces": q_heavy_pieces,
    "encode_distinct": q_encode_distinct,
    "bpe_fold": q_bpe_fold,
    "encode_gpt": q_encode_gpt,
    "encode_wordpiece": q_encode_wordpiece,
    "encode_unigram": q_encode_unigram,
    "decode_sequence": q_decode_sequence,
    "merge_edges": q_merge_edges,
    "merge_closure": q_merge_closure,
    "closure_adjacency": q_closure_adjacency,
    "closure_to_text": q_closure_to_text,
    "zero_fill": q_zero_fill,
    "descendant_frequency": q_descendant_frequency,
    "rarest_script_tokens": q_rarest_script_tokens,
    "rank_by_survival_ratio": q_rank_by_survival_ratio,
    "byte_token_frequency": q_byte_token_frequency,
    "standalone_frequency": q_standalone_frequency,
    "neighbor_counts": q_neighbor_counts,
    "neighbor_entropy": q_neighbor_entropy,
    "token_metrics": q_token_metrics,
    "byte_level_frequency": q_byte_level_frequency,
    "entropy_rank_curve": q_entropy_rank_curve,
    "drop_empty_text": q_drop_empty_text,
    "contains_script": q_contains_script,
    "filter_script_tokens": q_filter_script_tokens,
    "has_control_byte": q_has_control_byte,
    "byte_length": q_byte_length,
    "chunk_fixed": q_chunk_fixed,
    "batch_by_count": q_batch_by_count,
    "batch_docs_newline": q_batch_docs_newline,
    "batch_lines": q_batch_lines,
    "batch_by_chars": q_batch_by_chars,
    "scan_conversations": q_scan_conversations,
    "line_count": q_line_count,
    "shuffle_rows": q_shuffle_rows,
    "running_token_frequency": q_running_token_frequency,
    "stateful_token_frequency": q_stateful_token_frequency,
    "progress_metrics": q_progress_metrics,
    "write_frequencies": q_write_frequencies,
    "write_metrics": q_write_metrics,
    "write_ranked": q_write_ranked,
    "corpus_from_jsonl_tree": q_corpus_from_jsonl_tree,
    "scan_text": q_scan_text,
    "scan_bytes": q_scan_bytes,
    "scan_table": q_scan_table,
    "skip_malformed": q_skip_malformed,
    "replace_invalid": q_replace_invalid,
    "flatten": q_flatten,
    "empty_result_check": q_empty_result_check,
    "reuse_closure": q_reuse_closure,
    "extend_closure": q_extend_closure,
    "write_merge_closure": q_write_merge_closure,
}
