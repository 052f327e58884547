"""Session construction and the shared materialization folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every tidemark job relies on. Timestamps are interpreted in UTC;
# AQE coalesces the small post-aggregation partitions and splits skewed join
# partitions at runtime.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tidemark", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_runtime_defaults(spark: SparkSession) -> None:
    """Apply the SQL settings above to an existing session (runtime-settable only)."""
    for k, v in SESSION_DEFAULTS.items():
        if k.startswith("spark.ui."):
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a foreign session: leave it
            pass


#: Input bytes of a scanned split and shuffled bytes of a joined partition, at most: with these a task's rows, and the
#: memory it sorts and joins them in, stay the same however large the input is.
SPLIT_BYTES, PARTITION_BYTES = 8 << 20, 16 << 20
#: Input bytes for which there is one shuffle partition, before small ones are put together again.
INPUT_BYTES_PER_PARTITION = 4 << 20


def scale_to_input(spark: SparkSession, input_bytes: int) -> None:
    """Shuffles are dealt into as many partitions as the input asks for; a session that asks for more of them, or for
    smaller ones, keeps its own settings. Partitions of small inputs are coalesced as before."""
    conf = spark.conf
    sizes = {"spark.sql.files.maxPartitionBytes": SPLIT_BYTES, "spark.sql.adaptive.advisoryPartitionSizeInBytes": PARTITION_BYTES}
    for key, most in sizes.items():
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key)) > most:
            conf.set(key, str(most))
    own = int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions"))
    conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(own, -(-input_bytes // INPUT_BYTES_PER_PARTITION))))


def shared_root(spark: SparkSession) -> str:
    """Root folder for checkpoints and materialized tables.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``.
    Only when the session names none and runs in one process (local tests) do we
    create our own under the system temp folder and register it as the checkpoint
    directory; on a cluster such a folder would be another one on every machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            # setCheckpointDir() adds a random child folder; use its parent.
            root = current.rstrip("/").rsplit("/", 1)[0]
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root.rstrip("/") + "/checkpoints")
    return root.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop FileSystem of ``path`` and the path with its scheme (works for any scheme)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, replaced as a whole, on any file system."""
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def files_in(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder, in order of their names."""
    fs, p = file_system(spark, path)
    return sorted(f.getPath().toString() for f in fs.listStatus(p) if f.isFile() and not f.getPath().getName().startswith("."))
