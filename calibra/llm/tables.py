"""Reading tables, the shared scratch folder, and training rows."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

#: Bytes of an Arrow batch between the JVM and Python. Texts are long: the default of 64 MB is held several times over on both sides.
BATCH_BYTES = 1 << 20


#: Rows that Spark's Parquet reader decodes at once; its default of 4096 holds some ten megabytes of texts in one array.
READ_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits on Arrow batches and decoded rows to BATCH_BYTES and READ_ROWS where they are larger."""
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > READ_ROWS:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).lower().rstrip("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. A local one is set where that is unset, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="calibra-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


#: Folders made by scratch() inside cleaned(), one list for each level of nesting.
_made: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Deletes, on leaving, what scratch() and saved() made inside, failed jobs' folders too.

    For work whose result has been written (outside, or by saved() before this began)."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes made inside delete their shuffle files when they end; else these stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    path = path or scratch(df.sparkSession, name)
    small_batches(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Executors collect their garbage and give back what heap they no longer need, one task for each core."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def numbered(docs: DataFrame) -> DataFrame:
    """The columns renamed to c0, c1, ... but for the first `text`: names with dots or of any other kind pass through Arrow."""
    first = docs.columns.index("text")
    return docs.toDF(*("text" if i == first else f"c{i}" for i in range(len(docs.columns))))


def discard(df: DataFrame) -> None:
    """Deletes what saved() wrote, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def held_out(doc_id: str = "doc_id"):
    """True for rows whose labels no model may learn."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, max_rows: int) -> DataFrame:
    """(label, order, text) of at most max_rows labelled documents outside the held-out fold.

    The rows are those with the smallest hashes of doc_id, so the choice does not depend on
    order or partitions. Labels of null and documents without a label are left out; of rows with
    the same doc_id the least text stands for all.
    """
    chosen = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(target).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", F.xxhash64("doc_id").alias("order"), "text")


#: Coordinates of training rows that reach the driver, of four bytes each.
MAX_IDS = 1 << 25


def learned(rows: DataFrame, block_features, max_ids: int = MAX_IDS) -> list[tuple[int, np.ndarray]]:
    """(label, distinct coordinates) of training rows, shuffled alike at any partitioning.

    block_features: a block's bytes and offsets to distinct (document, coordinate). Rows are taken in
    `order` as long as they fit into max_ids coordinates; those that do not fit are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.claim(block_features.__module__)
        for batch in batches:
            out = []
            for _, _, data, offs in K.blocks(*K.flatten(batch.column("text"))):
                doc, ids = block_features(data, offs)
                cuts = np.searchsorted(doc, np.arange(len(offs)))
                out += [ids[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("order"), pa.array(out, pa.binary())], ["label", "order", "ids"])

    held = saved(rows.mapInArrow(run, "label int, order long, ids binary"), "training-features")
    room, kept = max_ids, []
    for order, size in sorted(tuple(r) for r in held.select("order", F.octet_length("ids") / 4).collect()):  # a row for each of at most max_rows
        if size <= room:
            room -= size
            kept.append((order,))
    chosen = held.sparkSession.createDataFrame(kept, "order long")
    got = held.join(F.broadcast(chosen), "order", "left_semi").select("label", "ids").toArrow()
    out = [(y, np.frombuffer(b, "<i4")) for y, b in zip(got["label"].to_pylist(), got["ids"].to_pylist(), strict=True)]
    out.sort(key=lambda r: (len(r[1]), r[1].tobytes(), r[0]))  # whatever order the tasks ended in
    return [out[i] for i in np.random.default_rng(7).permutation(len(out))]
