"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: tables of at most so many short rows are broadcast; larger ones join by a shuffle
BROADCAST_ROWS = 200_000
#: column chunks come through small buffers; vectored reads hold each a second time outside the heap, hundreds of MB where row groups are large
PLAIN_READS = {"parquet.hadoop.vectored.io.enabled": "false"}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str, **options: object) -> DataFrame:
    """A table of the given folder, read by Spark, with options of the reader."""
    return spark.read.options(**options).parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset, and on a local master (tests), a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="foldloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, **options: object) -> DataFrame:
    """Write df as Parquet into the shared folder, with options of the writer, and read it back.

    This cuts the lineage: later stages reread the files, so a lost executor costs no recomputation of what made them.
    The files go at the end of a surrounding `temporary` of the same thread, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: folders made here, by their names, which no other folder has; and the lists of the open `temporary` blocks of a thread
_OWN: dict[str, str] = {}
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def new_folder(spark: SparkSession, kind: str) -> str:
    """The path of a new folder in the shared one, which goes as the tables of `stored` do."""
    name = f"{kind}-{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    _OWN[name] = path
    if _OPEN.get():
        _OPEN.get()[-1].append(name)
    return path


def _place(spark: SparkSession, path: str) -> tuple[object, object]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored in here go at its end, but for those stored by the function it gives; whoever stored those deletes them with `discard`."""
    made: list[str] = []
    opened = _OPEN.set((*_OPEN.get(), made))

    def kept(df: DataFrame) -> DataFrame:
        out = stored(df)
        made.pop()
        return out

    try:
        yield kept
    finally:
        _OPEN.reset(opened)
        for name in made:
            _delete(spark, name)


def _delete(spark: SparkSession, name: str) -> None:
    path = _OWN.pop(name, None)
    if path is not None:
        place, files = _place(spark, path)
        files.delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `stored` made; nothing may read it any more. Any other table stays, whatever its folder's name."""
    for name in {file.split("/")[-2] for file in df.inputFiles()}:
        _delete(df.sparkSession, name)


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def joined(rows: DataFrame, one: DataFrame, key: str, salt: str, size: int | None = None, hot_rows: int = 1_000_000) -> DataFrame:
    """rows joined on key with `one`, which has one row a key.

    Keys of over hot_rows rows, and over 1 / 4096 of all, are hot: at most 4,096, so their list is broadcast. Their rows are dealt by
    the hash of `salt`, and their row of `one` is repeated for each share. size: a bound of the number of rows, counted if not given.
    """
    size = rows.count() if size is None else size
    if size <= hot_rows:
        return rows.join(one, key)
    limit = max(hot_rows, size >> 12)
    hot = stored(rows.groupBy(key).count().where(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).cast("int").alias("shares_")))
    if hot.isEmpty():
        return rows.join(one, key)
    shares = F.coalesce("shares_", F.lit(1))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("share_", F.pmod(F.xxhash64(salt), shares).cast("int")).drop("shares_")
    repeated = one.join(F.broadcast(hot), key, "left").withColumn("share_", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares_")
    return dealt.join(repeated, [key, "share_"]).drop("share_")


def long_texts(spark: SparkSession, rows: int = 1000) -> None:
    """Send Python workers batches of at most `rows` rows, for texts of some thousand bytes: Spark's 10,000 hold tens of
    megabytes in the JVM and again in each worker. A smaller setting of the session stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """`long_texts` for what runs in here."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    long_texts(spark)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of doc_id as text, modulo k; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def free(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no column of that name."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def pieces(data: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """Parts of about `most` bytes, cut at white space; no word is cut."""
    at = 0
    while at < len(data):
        end = at + most
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end]
        at = end


def spans(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of successive rows of about `most` bytes each."""
    first, size = 0, 0
    for k, n in enumerate(sizes):
        size += n
        if size >= most or k == len(sizes) - 1:
            yield first, k + 1
            first, size = k + 1, 0
