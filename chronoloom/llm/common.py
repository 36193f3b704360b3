"""What the corpus operators share: work folders, hashing of ids, table access, tokens."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.session import shared_dir

#: Words are runs of bytes other than space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/chronoloom-{what}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back; it outlives executors."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables made by materialize() that nothing lazy reads any more."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            remove_path(df.sparkSession, path)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; null for a null id."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def is_remainder(col: Column, n: int, remainder: int) -> Column:
    """Never null: a null id counts as not in the fold."""
    return F.coalesce(crc_mod(col, n) == F.lit(remainder), F.lit(False))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _LOWER)


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z alone and bytes.split() splits at exactly the bytes that WORD leaves out."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over uint64."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, in any case."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name = "_" + name
    return name


def _id_marks(ids: DataFrame) -> tuple:
    """A bitmap of the ids' hashes as a broadcast table (word, bits), and functions of a key: its word, whether its bit is set.

    16 bits an id, 2^27 bits at most: a broadcast of 2^21 words, however many ids there are.
    """
    name, n = ids.columns[0], ids.count()
    bits = 1 << max(16, min(27, (16 * max(n, 1) - 1).bit_length()))
    word = lambda c: F.floor(F.pmod(F.xxhash64(c), F.lit(bits)) / 64).cast("bigint")
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col(name)))
    marks = ids.select(word(F.col(name)).alias("__ids_word"), one.alias("__ids_bits")).groupBy("__ids_word").agg(F.bit_or("__ids_bits").alias("__ids_bits"))
    return F.broadcast(marks), word, lambda c: F.getbit("__ids_bits", bit(c)) == 1


def split_by_ids(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key the bitmap of ids (a written table with one column) lets through, which are all those whose key is in ids and few others, and the rest. Neither shuffles df."""
    marks, word, is_set = _id_marks(ids)
    marked = df.join(marks, word(F.col(key)) == F.col("__ids_word"), "left").withColumn("__ids_bits", F.coalesce(is_set(F.col(key)), F.lit(False)))
    return marked.where("__ids_bits").select(*df.columns), marked.where("not __ids_bits").select(*df.columns)


def with_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose key is in ids (a written table with one column): a semi join that shuffles only rows that the bitmap lets through."""
    marks, word, is_set = _id_marks(ids)
    passed = df.join(marks, (word(F.col(key)) == F.col("__ids_word")) & is_set(F.col(key))).select(*df.columns)
    return passed.join(ids, passed[key] == ids[ids.columns[0]], "left_semi")


def without_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose key isn't in ids: those that the bitmap clears, and of the others those that an anti join leaves. Null keys stay."""
    unsure, rest = split_by_ids(df, key, ids)
    return rest.unionAll(unsure.join(ids, unsure[key] == ids[ids.columns[0]], "left_anti"))
