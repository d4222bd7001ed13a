"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see. A local master needs none and gets one; a cluster has to name one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a written table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table of :func:`materialize` that nothing reads any more."""
    context = table.sparkSession.sparkContext
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of words; empty for a null or blank text."""
    return F.array_remove(F.split(text_or_empty(text), SPACE_CLASS + "+"), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def buckets_for(n_rows: int, rows_each: int = 20_000, least: int = 16) -> int:
    """Number of ranges such that one holds about ``rows_each`` rows, whatever the size of the input."""
    return max(least, -(-n_rows // rows_each))


#: DuckDB CTEs that give ``crc(t)``, the table of the checksum with the reflected polynomial 0xEDB88320; they need ``WITH RECURSIVE``.
CRC32_CTES = """crc_bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY i) AS t FROM crc_bits WHERE k = 8
)"""


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of a string of code points below 0x800, in UTF-8, where ``crc.t`` can be seen."""
    utf8 = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {utf8}), lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295)"
