"""What the operators share: typed views of their inputs, row keys and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that ends a word: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key as long ``k`` and the text (NULL: empty) as ``t``; names of other columns don't matter."""
    return df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def text_hash(text: Column) -> Column:
    """With the key this tells rows that repeat a doc_id with another text apart."""
    return F.xxhash64(F.lit("row"), text)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; only a session that is one process may do without, in a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, kept if executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


_WRITTEN: list[str] = []


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` has made, once all that reads them has been written itself."""
    for table in tables:
        _WRITTEN.remove(table.scratch_path)
        _delete(table.sparkSession, table.scratch_path)


def remove_scratch(spark: SparkSession) -> int:
    """Delete the tables that ``written`` has made in this process, once their results have been consumed."""
    n = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return n


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_texts(df: DataFrame, key: str, text: str, carry: list[str] = ()) -> tuple[DataFrame, bool]:
    """k, th, t and the columns to carry as c0, c1 ...; and whether a key repeats.

    ``k`` is the key (NULL: the smallest long); ``th`` is 0 where every key occurs once, and
    otherwise a hash of the text, so that rows that repeat a key are told apart by it.
    """
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), *rest)
    repeated = bool(rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").take(1))
    return rows.select("k", (text_hash(F.col("t")) if repeated else F.lit(0)).cast("long").alias("th"), "t", *(f"c{i}" for i in range(len(rest)))), repeated


def packed(rows: DataFrame) -> DataFrame:
    """The same with the text as compressed UTF-8, ``z``, for a shuffle."""

    def pack(batches):
        import pyarrow as pa
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in small_batches(batches):
            z = [compress(x) for x in unpack(batch.column(2))]
            names = ["k", "th", "z", *batch.schema.names[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary()), *batch.columns[3:]], names)

    # no NULLs: then inner and outer joins read the same exchange
    fixed = [T.StructField(c, t, False) for c, t in (("k", T.LongType()), ("th", T.LongType()), ("z", T.BinaryType()))]
    return rows.mapInArrow(pack, T.StructType([*fixed, *rows.schema.fields[3:]]))


def small_batches(batches, rows: int = 500):
    """Slices of batches, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unpack(texts) -> list[bytes]:
    """UTF-8 of an Arrow column of strings, or of compressed ones."""
    import pyarrow as pa

    if pa.types.is_binary(texts.type):
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        return [decompress(x) for x in texts.to_pylist()]
    return [x.encode("utf-8", "surrogatepass") for x in texts.to_pylist()]


def out_key(name: str) -> Column:
    """The key column as it came."""
    return F.when(F.col("k") != -(1 << 63), F.col("k")).alias(name)
