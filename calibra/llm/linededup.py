r"""Line deduplication over levelled sorted runs of line hashes. DataFrame operations only.

A line's key is the line stripped of ASCII white space at both ends, with A-Z lowered; it is
held as two 64-bit hashes. A run is a table (h1, h2, n_docs) bucketed and sorted by hash. There
are open runs (keys that may still reach min_docs documents) and settled runs (keys that did, and
need no more counting). A new batch of documents is counted, merge-anti-joined with every
settled run, and what is left is added: keys that reach min_docs in the batch alone as a settled
run of level 0, the others as an open run of level 0. Whenever a level holds two runs of a kind,
a full outer merge join compacts them into one run of the next level; open keys that reach
min_docs by it move to the settled runs. So a key is rewritten once for each level, not for each
batch, and there are never more runs than levels. Runs share their buckets, so no join between
them shuffles. Runs lie in the shared folder and are dropped when done, after a failure too.

A null or empty text is one empty line; empty keys are never dropped. Every row counts as a
document, repeated rows too. A text whose lines all go becomes the empty text. Other columns
stay as they are, whatever their names.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import remove, saved, scratch, shuffles_dropped, table

_SPACE = " \t\n\x0b\x0c\r"
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: Parts a table is counted in.
BATCHES = 4


def lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(_SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LineRuns:
    """Counts of documents by line key, kept as levelled sorted runs in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, buckets: int | None = None) -> None:
        self.spark, self.min_docs = spark, min_docs
        # a run has some 24 bytes for a line of a hundred or more, so an eighth of the partitions that suit the texts
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
        self.open: list[DataFrame | None] = []
        self.settled: list[DataFrame | None] = []
        self.anti_joins = 0
        self.paths: dict[str, str] = {}

    def __enter__(self) -> LineRuns:
        self.before = self.spark.conf.get(_ORDERED)
        self.spark.conf.set(_ORDERED, "true")  # a bucket of one file is read as sorted, so merges need no sort
        return self

    def __exit__(self, *_) -> None:
        self.spark.conf.set(_ORDERED, self.before)
        self.close()

    def _run(self, df: DataFrame) -> DataFrame:
        """Writes a run of rows that are dealt to buckets already; one file for each bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, name)
        with shuffles_dropped(self.spark):
            df.select("h1", "h2", "n_docs").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", self.paths[name]).saveAsTable(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Drops the runs; what frequent() returned stays."""
        for name in list(self.paths):
            self._drop(name)
        self.open, self.settled = [], []

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.paths.pop(name))

    def add(self, docs: DataFrame) -> None:
        """Counts a batch of documents and adds its runs.

        Rows are dealt by the number of the writer's bucket, so a bucket is one task's and one file,
        whatever number of partitions they are dealt to. The counts become a run before settled keys
        leave them, so that join needs no shuffle either.
        """
        keys = F.array_distinct(F.transform(lines(), line_key))
        counts = docs.select(F.explode(keys).alias("key")).where("key != ''").select(*_hashes(F.col("key"))).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
        run = self._run(counts.repartition(self.buckets, F.pmod(F.hash("h1", "h2"), F.lit(self.buckets))))
        settled = [s for s in self.settled if s is not None]
        if settled:
            rest = run
            for s in settled:
                rest = rest.join(s.hint("merge"), ["h1", "h2"], "left_anti")
                self.anti_joins += 1
            name = list(self.paths)[-1]
            run = self._run(rest)
            self._drop(name)
        self._split(run, 0)

    def _split(self, run: DataFrame, level: int) -> None:
        """Adds a run of counts: what reached min_docs to the settled runs, the rest to the open ones."""
        if not run.where(F.col("n_docs") >= self.min_docs).isEmpty():
            self._push(self.settled, self._run(run.where(F.col("n_docs") >= self.min_docs)), 0)
        self._push(self.open, run.where(F.col("n_docs") < self.min_docs), level)

    def _push(self, runs: list[DataFrame | None], run: DataFrame, level: int) -> None:
        while len(runs) <= level:
            runs.append(None)
        if runs[level] is None:
            runs[level] = run
            return
        both = self._merge(runs[level], run)
        runs[level] = None
        if runs is self.settled:
            self._push(runs, both, level + 1)
        else:
            self._split(both, level + 1)

    def _merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        n = F.coalesce(a["n_docs"], F.lit(0)) + F.coalesce(b["n_docs"], F.lit(0))
        keys = (a["h1"] == b["h1"]) & (a["h2"] == b["h2"])
        return self._run(a.join(b.hint("merge"), keys, "full").select(F.coalesce(a["h1"], b["h1"]).alias("h1"), F.coalesce(a["h2"], b["h2"]).alias("h2"), n.alias("n_docs")))

    def frequent(self) -> DataFrame:
        """(h1, h2) of all keys in at least min_docs documents, after compacting all open runs into one."""
        rest = [run for run in self.open if run is not None]
        self.open = []
        while len(rest) > 1:
            both = self._merge(rest[0], rest[1])
            rest = [both, *rest[2:]]
        # keys in the last run that reached min_docs by these merges; a settled key is in no open run that was added after
        parts = [*(run for run in self.settled if run is not None), *(r.where(F.col("n_docs") >= self.min_docs) for r in rest)]
        self.open = rest
        if not parts:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return saved(out.select("h1", "h2").distinct(), "frequent-lines")


def batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """The rows in n parts by the hash of their text."""
    return [docs.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [docs]


def frequent_lines(docs: DataFrame, min_docs: int, n_batches: int = BATCHES) -> DataFrame:
    with LineRuns(docs.sparkSession, min_docs) as runs:
        for batch in batches(docs.select("text"), n_batches):
            runs.add(batch)
        return runs.frequent()


def dedup_lines(docs: DataFrame, min_docs: int = 10, n_batches: int = BATCHES, key: str = "doc_id") -> DataFrame:
    """The rows with text replaced by its kept lines, plus n_lines and n_dropped (long).

    Columns of docs named n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    frequent = frequent_lines(docs, min_docs, n_batches)
    row = [F.xxhash64(F.lit(1), key, "text"), F.xxhash64(F.lit(2), key, "text")]  # equal rows have equal results
    places = docs.select(row[0].alias("u1"), row[1].alias("u2"), F.posexplode(lines()).alias("place", "line"))
    places = places.select("u1", "u2", "place", line_key(F.col("line")).alias("key")).where("key != ''")
    dropped = (
        places.select("u1", "u2", (F.col("place") + 1).alias("place"), *_hashes(F.col("key")))
        .join(frequent, ["h1", "h2"])
        .groupBy("u1", "u2")
        .agg(F.sort_array(F.collect_set("place")).alias("dropped_places"))
    )
    names = docs.columns
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), row[0].alias("u1"), row[1].alias("u2"))
    text = f"c{names.index('text')}"
    joined = inner.join(dropped, ["u1", "u2"], "left").withColumn("ls", lines(text))
    cuts = F.concat(F.array(F.lit(0)), F.coalesce("dropped_places", F.array().cast("array<int>")), F.array(F.size("ls") + 1))
    pieces = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.slice("ls", F.get("cuts", i - 1) + 1, F.get("cuts", i) - F.get("cuts", i - 1) - 1))
    joined = joined.withColumn("cuts", cuts).withColumn("kept", F.array_join(F.flatten(pieces), "\n"))
    return joined.select(
        *((F.col("kept") if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)),
        F.size("ls").cast("long").alias("n_lines"),
        (F.size("cuts") - 2).cast("long").alias("n_dropped"),
    )


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), f AS (
  SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(f.k) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id
"""
