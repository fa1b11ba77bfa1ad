"""Session helpers: building a session, table paths, lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Default ceiling for broadcasting a vocabulary-sized table. A 150K-entry
# vocabulary with short byte strings is a few MB; the check below makes the
# bound explicit instead of assumed.
BROADCAST_MAX_ROWS = 2_000_000

PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))
FIXTURE_TOKENIZER = os.path.join(PACKAGE_DIR, "resources", "tokenizer.json")
FIXTURE_BYTE_LEVEL_TOKENIZER = os.path.join(PACKAGE_DIR, "resources", "tokenizer_byte_level.json")
FIXTURE_WORDPIECE_TOKENIZER = os.path.join(PACKAGE_DIR, "resources", "tokenizer_wordpiece.json")
FIXTURE_UNIGRAM_TOKENIZER = os.path.join(PACKAGE_DIR, "resources", "tokenizer_unigram.json")


def get_spark(master: str | None = None, app: str = "tokscope", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benches. On a cluster, use the cluster's session."""
    builder = (
        SparkSession.builder.master(master or os.environ.get("TOKSCOPE_MASTER", "local[8]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TOKSCOPE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None on a session without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no SparkContext
        return None


def default_parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting is always used when present. Only a local master
    (tests, benches) gets a fresh temporary folder; elsewhere an unset folder
    is an error, since executors would write to disks of their own.
    """
    sc = _context(spark)
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master or ""):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share (master is {master!r})")
        conf_dir = tempfile.mkdtemp(prefix="tokscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if sc is not None:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (on a local master that is a temporary folder)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: materialise ``df`` in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_columns(df: DataFrame) -> DataFrame:
    """As :func:`cut_lineage`, but as compressed columns: several times smaller; partitions and order are not kept."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, known_rows: int | None = None) -> DataFrame:
    """Broadcast hint only when ``df`` is checked to hold at most ``max_rows`` rows.

    ``known_rows`` is the exact row count if the caller has it; otherwise at
    most ``max_rows + 1`` rows are counted. Above the bound the hint is omitted and
    the planner picks a shuffle join, so a larger-than-expected side degrades
    to a slower plan instead of an out-of-memory broadcast.
    """
    n = known_rows if known_rows is not None else df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tokscope`` importable in Python workers, once per application.

    Functions run by ``mapInPandas`` / ``applyInPandas`` are pickled by
    reference to this package, so the workers must import it. The package
    is zipped on the driver and distributed with ``addPyFile`` (the usual
    way to ship library code to executors); a cluster where it is already
    installed can skip it.
    """
    sc = _context(spark)
    if sc is None:
        return
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    zip_dir = tempfile.mkdtemp(prefix="tokscope-pkg-")
    zip_path = os.path.join(zip_dir, "tokscope.zip")
    root = os.path.dirname(PACKAGE_DIR)
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _dirs, files in os.walk(PACKAGE_DIR):
            if "__pycache__" in folder:
                continue
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zip_path)
    _SHIPPED.add(key)
