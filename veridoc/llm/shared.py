"""What the operators of this subpackage share: table reading, shared storage, small SQL helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions.shipping import shared_folder, ship
from veridoc.functions.text import let  # noqa: F401  used by the operators from here

#: Runs of ASCII white space, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
#: Of tables with texts: bytes of a row group that is written, and rows that are read at once meanwhile. A task holds as much
#: of its heap for both; by Spark's own sizes (128 MB, 4096 rows) eight tasks need more than 1 GB.
TEXT_GROUP, TEXT_ROWS = 4 << 20, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


_written: list[str] = []


@contextmanager
def read_in_portions(spark: SparkSession, rows: int) -> Iterator[None]:
    """Parquet is read in portions of at most so many rows by what starts here; then the session's own number holds again."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    own = spark.conf.get(key, None)
    if own is None or int(own) > rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, own)


def written(df: DataFrame, what: str, texts: bool = False) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors. texts: its
    rows hold texts, so few of them are held in memory at once, here and by those who read them."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    _written.append(path)
    with read_in_portions(spark, TEXT_ROWS) if texts else nullcontext():
        (df.write.option("parquet.block.size", TEXT_GROUP) if texts else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Remove the tables that written() has made after the first `since`, but for those that `keep` reads; for
    intermediate tables that nothing reads any more."""
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in (keep.inputFiles() if keep is not None else ())}
    for path in [x for x in _written[since:] if x.rsplit("/", 1)[-1] not in kept]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def written_so_far() -> int:
    """How many tables of written() there are, for drop_written()."""
    return len(_written)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as no column of df has; upper and lower case are the same."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(docs: DataFrame, **columns: str | Column) -> DataFrame:
    """docs as one struct column `_row`, beside columns of its own: what an operator adds cannot clash with what docs has."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow() with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def words(text: Column) -> Column:
    """The words of a text: maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def total(values: Column, kind: str = "bigint") -> Column:
    """Sum of an array, 0 if empty."""
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)
