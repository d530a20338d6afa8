"""Shared helpers of the training-data operators: cuts of lineage, Arrow batches, labelled samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space of the word rule: space and code points 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch that a worker turns into Python objects at a time; a single
#: row may be larger. The batches themselves are bounded by the session (64 MB by default).
PIECE_ROWS, PIECE_BYTES = 1000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the
    session. Where that is unset, a local folder if all runs in this process (tests, a
    single machine); on a cluster it must be set, as machines don't see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"/tmp/checkpoints/sluice-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Session settings for rows that may be very long: the rows that a Parquet reader holds at a time (4096 by default),
#: those that a writer takes before it looks for the first time at how much it holds (100 by default), and the bytes of
#: an Arrow batch (64 MB by default).
FEW_ROWS = {
    "spark.sql.parquet.columnarReaderBatchSize": "8", "parquet.page.size.row.check.min": "1",
    "parquet.block.size.row.check.min": "1", "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def few_rows(spark: SparkSession) -> dict[str, str | None]:
    """Let readers and writers of this session hold few rows at a time, however long they
    are; returns what was set before. Results don't depend on it. Spark looks at these settings when a frame
    is run, so they must stay until then."""
    before = {k: spark.conf.get(k, None) for k in FEW_ROWS}
    settings(spark, FEW_ROWS)
    return before


def settings(spark: SparkSession, values: dict[str, str | None]) -> None:
    """Set these; None unsets."""
    for k, v in values.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


#: Folders written by cut() and not deleted yet.
_CUTS: set[str] = set()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again.

    The result has no lineage to recompute, survives lost executors, and its
    statistics are known to the planner. The files stay for lazy readers until
    `release()`, or `drop_cut()` where an operator knows that it is done with them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sluice-{name}-{uuid.uuid4().hex}"
    _CUTS.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a cut() that nothing reads any more."""
    if df.cut_path in _CUTS:
        delete_folder(df.sparkSession, df.cut_path)
        _CUTS.discard(df.cut_path)


def release(spark: SparkSession, before: set[str] | None = None) -> None:
    """Delete the cuts of this process, or those made since `before` (of `cuts()`): call
    it when the results that read them were written."""
    for path in _CUTS - (before or set()):
        delete_folder(spark, path)
        _CUTS.discard(path)


def cuts() -> set[str]:
    """The cuts that are not deleted yet."""
    return set(_CUTS)


def pieces(batch: pa.RecordBatch | pa.Array, rows: int = PIECE_ROWS) -> Iterator:
    """A batch in slices of at most `rows` rows and about PIECE_BYTES bytes."""
    n = len(batch)
    step = max(1, min(rows, n * PIECE_BYTES // max(1, batch.nbytes)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def map_pieces(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: str, rows: int = PIECE_ROWS) -> DataFrame:
    """Each partition through `run`, which gets its rows in slices of batches and yields lists per column of `schema`."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(part for batch in batches for part in pieces(batch, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)

    return df.mapInArrow(work, schema)


def map_columns(df: DataFrame, run: Callable[[Iterator[list[list]]], Iterator[list]], schema: str) -> DataFrame:
    """Each partition through `run`, which gets its rows piece by piece, a list per column,
    and yields lists per column of `schema`. Whole numbers stay exact beside nulls."""
    return map_pieces(df, lambda parts: run([c.to_pylist() for c in part.columns] for part in parts), schema)


def score_column(scores: Callable[[], Callable[[list], list[float]]]):
    """A column function text -> double; `scores()` makes a worker's function over a list of texts."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = scores()
        for batch in batches:
            yield pa.array([s for part in pieces(batch) for s in of(part.to_pylist())], pa.float64())

    return score


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    """True for the rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_samples(docs: DataFrame, labels: DataFrame, wanted: dict[str, tuple[int, int]], seed: int = 17, max_chars: int = 50_000) -> dict[str, list[tuple[str, int]]]:
    """For each label column at most `wanted[label][y]` texts of each value y, the first of them
    in the order of a seeded hash of doc_id; rows with crc32(doc_id) mod 5 = 0 are never among them.

    The top-k steps and `max_chars` bound what reaches the driver: a chosen text is taken
    whole, or, if longer than `max_chars`, not at all. All labels share one parallel pass
    over the texts, whose few rows are written and then fetched by one job.
    Documents with several labels count once with the largest, of several texts the
    smallest is taken. Null labels and null texts teach nothing and are left out.
    """
    spark = docs.sparkSession
    free = labels.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    chosen: dict[str, dict[int, int]] = {}
    for label, per_class in wanted.items():
        known = free.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y")).withColumn("o", F.xxhash64(F.lit(seed), "doc_id"))
        chosen[label] = {}
        for y in (0, 1):
            first = known.where(F.col("y") == y).orderBy("o", "doc_id").select("doc_id").limit(per_class[y])
            chosen[label] |= {r.doc_id: y for r in first.collect()}
    ids = sorted(set().union(*chosen.values()))
    if not ids:
        return {label: [] for label in wanted}
    # at most the sum of all per_class numbers: small enough to broadcast
    of = spark.createDataFrame([(i,) for i in ids], "wanted_id long")
    found = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(of), F.col("doc_id") == F.col("wanted_id"), "left_semi")
    rows = cut(found.groupBy("doc_id").agg(F.min("text").alias("text")), "sample")
    texts = {r.doc_id: r.text for r in rows.collect()}
    drop_cut(rows)
    return {label: [(texts[i], some[i]) for i in sorted(some) if i in texts] for label, some in chosen.items()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], **options) -> list[tuple[str, int]]:
    """The texts and values of one label column, see `labelled_samples`."""
    return labelled_samples(docs, labels, {label: per_class}, **options)[label]


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary file `name` is; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
