"""Corpus sources (S1-S5, S8, S9) and the empty-text filter.

All readers return lazy DataFrames; the text stays one row per document
(or per file / line), so the unit of parallel work is the row, not a
driver-side chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_table(
    spark: SparkSession,
    path: str,
    text_column: str = "text",
    keep: tuple[str, ...] = (),
    fmt: str = "parquet",
) -> DataFrame:
    """A dataset with one named text column.

    Only the text column (plus ``keep``) is selected so the scan prunes the
    rest; a missing column raises ``AnalysisException`` at analysis time.
    """
    df = spark.read.format(fmt).load(path)
    cols = [*keep, text_column]
    out = df.select(*cols)
    if text_column != "text":
        out = out.withColumnRenamed(text_column, "text")
    return out


def drop_empty_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop NULL and empty text."""
    return df.filter(F.col(col).isNotNull() & (F.length(col) > 0))


def scan_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Files as raw bytes, ``(path, block, line, bytes)``, one row per line with its newline kept.

    Files are split over tasks at line borders, whatever their size, and read
    twice (the second time only to see which files end without a newline). All rows
    of a file, by ``block`` then ``line``, are its bytes: CR stays, invalid UTF-8 stays.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("bytes"),
    )
    ends = lines.groupBy("path").agg(
        F.sum(F.octet_length("bytes") + F.lit(1).cast("long")).alias("with_newlines"),
        F.max("size").alias("size"),
        F.max(F.struct("block", "line")).alias("last"),
    )
    # One row per file that lacks its last newline.
    open_end = ends.filter(F.col("with_newlines") > F.col("size")).select("path", F.col("last.block").alias("block"), F.col("last.line").alias("line"), F.lit(True).alias("open"))
    marked = lines.join(open_end, ["path", "block", "line"], "left")
    whole = F.when(F.col("open"), F.col("bytes")).otherwise(F.concat("bytes", F.lit(b"\n")))
    return marked.select("path", "block", "line", whole.alias("bytes"))


def scan_text(spark: SparkSession, path: str, normalize_newlines: bool = True, on_invalid: str = "raise", observation: Observation | None = None) -> DataFrame:
    """UTF-8 text files, ``(path, block, line, text)``, one row per line with its newline kept.

    Split over tasks as :func:`scan_bytes`. With ``normalize_newlines`` CR LF
    and lone CR become LF, as text-mode reading does. Invalid UTF-8 stops the
    read (``on_invalid='raise'``), or is replaced by U+FFFD (``'replace'``);
    ``observation`` counts such rows (``invalid``, ``rows``).
    """
    if on_invalid not in ("raise", "replace"):
        raise ValueError(f"on_invalid {on_invalid!r}")
    rows = scan_bytes(spark, path).withColumn("text", F.col("bytes").cast("string"))
    if observation is not None:
        rows = rows.observe(observation, F.count_if(~F.is_valid_utf8("text")).alias("invalid"), F.count(F.lit(1)).alias("rows"))
    text = F.validate_utf8("text") if on_invalid == "raise" else F.make_valid_utf8("text")
    if normalize_newlines:
        text = F.regexp_replace(text, "\r\n?", "\n")
    return rows.select("path", "block", "line", text.alias("text"))


# -- S3: JSONL conversations -------------------------------------------------


def parse_conversation_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """S3 over a DataFrame of JSONL lines.

    Keeps the first turn's ``content`` of ``{"conversations":[{"content":…},…]}``.
    A line that is not JSON, has no turn, or whose content is not a string
    yields ``content = NULL`` and ``ok = false``; callers filter on ``ok``.
    """
    v = F.try_parse_json(F.trim(F.col(line_col)))
    first = F.try_variant_get(v, "$.conversations[0].content", "variant")
    is_string = F.schema_of_variant(first) == F.lit("STRING")
    content = F.when(is_string, F.try_variant_get(first, "$", "string"))
    conv_id = F.try_variant_get(v, "$.id", "bigint")
    return lines.select(
        conv_id.alias("conv_id"),
        content.alias("content"),
        content.isNotNull().alias("ok"),
    )


def observe_rejected(parsed: DataFrame, name: str = "rejected_lines") -> tuple[DataFrame, Observation]:
    """Count rows with ``ok = false`` as a side metric while they are dropped.

    The count is filled in when the returned frame is first computed
    (``observation.get["rejected"]``); nothing extra is scanned.
    """
    obs = Observation(name)
    watched = parsed.observe(obs, F.count_if(~F.col("ok")).alias("rejected"), F.count(F.lit(1)).alias("lines"))
    return watched.filter("ok").drop("ok"), obs


def scan_conversations(spark: SparkSession, path: str, observation: bool = False):
    """S3: read JSONL files and keep first-turn contents; bad lines dropped.

    With ``observation=True`` returns ``(frame, Observation)`` whose
    ``rejected`` / ``lines`` counts report what was skipped.
    """
    parsed = parse_conversation_lines(spark.read.text(path))
    kept, obs = observe_rejected(parsed)
    return (kept, obs) if observation else kept


def conversations_as_jsonl(conversations: DataFrame) -> DataFrame:
    """Nest the flat ``conversations`` table into one JSON line per conversation.

    Turns are ordered by ``turn``; the line carries ``id`` and
    ``conversations: [{role, content}, …]``. One shuffle on ``conv_id``; a
    conversation is one record, so its size is bounded by the record itself.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    nested = conversations.groupBy("conv_id").agg(turns.alias("t"))
    record = F.struct(
        F.col("conv_id").alias("id"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias(
            "conversations"
        ),
    )
    return nested.select(F.to_json(record).alias("value"))


# -- S5: directory tree of JSONL ---------------------------------------------


def corpus_from_jsonl_tree(spark: SparkSession, root: str, text_field: str = "text", observation: Observation | None = None) -> DataFrame:
    """Every JSONL file under ``root`` (any depth); one row ``text`` per good record.

    A line that is not JSON, lacks the field or holds something else than a
    string in it is dropped, as is an empty text; ``observation`` counts
    what was dropped (``rejected``, ``empty``, ``lines``). No schema is inferred:
    the corpus is read once.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    record = F.try_parse_json(F.trim("value"))
    value = F.try_variant_get(record, f"$.{text_field}", "variant")
    rows = lines.select(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).alias("text"))
    if observation is not None:
        rows = rows.observe(observation, F.count_if(F.col("text").isNull()).alias("rejected"), F.count_if(F.col("text") == "").alias("empty"), F.count(F.lit(1)).alias("lines"))
    return drop_empty_text(rows)


# -- S7 / S8: result files read back ----------------------------------------

METRICS_SCHEMA = T.StructType(
    [
        T.StructField("token", T.StringType()),
        T.StructField("freq_in_corpus", T.LongType()),
        T.StructField("standalone_ratio", T.DoubleType()),
        T.StructField("entropy", T.DoubleType()),
        T.StructField("length_bytes", T.IntegerType()),
        T.StructField("meaningless", T.BooleanType()),
    ]
)


#: Stands for a missing value when the metrics CSV is read (there are none), so that an empty token stays ''.
_NO_VALUE = "\u0001missing\u0001"


def load_metrics(spark: SparkSession, path: str, observation: Observation | None = None) -> DataFrame:
    """Metrics CSV (quotes doubled, as CSV readers expect); malformed rows dropped.

    A row with another number of fields or an unreadable value is dropped and
    counted by ``observation`` (``malformed``, ``rows``).
    """
    schema = T.StructType([*METRICS_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.csv(
        path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", multiLine=True,
        quote='"', escape='"', nullValue=_NO_VALUE, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    if observation is not None:
        rows = rows.observe(observation, F.count_if(F.col("_bad").isNotNull()).alias("malformed"), F.count(F.lit(1)).alias("rows"))
    return rows.filter(F.col("_bad").isNull()).drop("_bad")


def load_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """``{"<token id>": count}`` JSON object(s) into ``(token_id, count)``."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,bigint>")
    return raw.select(F.explode(m).alias("k", "count")).select(
        F.col("k").cast("int").alias("token_id"), F.col("count")
    )


# -- S9 ------------------------------------------------------------------------


def newline_count(text: Column) -> Column:
    """Number of ``\\n`` in a text value (a last unterminated line is not counted)."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(df: DataFrame, col: str = "text") -> DataFrame:
    """``wc -l`` over a corpus held as whole-text rows."""
    return df.agg(F.coalesce(F.sum(newline_count(F.col(col))), F.lit(0)).cast("long").alias("n_lines"))
