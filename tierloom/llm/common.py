"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Separators of alphanumeric words once A-Z is lower-cased, and of white-space words (Java and RE2 syntax).
WORD_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_SEP = r"[\x20\x09-\x0D]+"

#: bytes.translate tables: separators become a space, A-Z becomes a-z, every other byte stays.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 0x20 for b in range(256))
SPACE_BYTES = bytes(0x20 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def split_words(c: Column, sep: str) -> Column:
    """The words between separators; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), sep), "")


def alnum_words(c: Column) -> Column:
    return split_words(ascii_lower(c), WORD_SEP)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """96 bits that name a row by its id and text: rows equal in both are one document, nulls included."""
    return [F.xxhash64(id_col, text_col).alias("_k1"), F.hash(id_col, text_col).alias("_k2")]


KEY = ["_k1", "_k2"]


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType | T.VariantType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def whole_key(docs: DataFrame) -> Column:
    """64 bits of all columns (maps and variants as JSON text), to tell rows of one key apart."""
    of = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.xxhash64(*of).alias("_k3")


WHOLE = [*KEY, "_k3"]

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares: spark.checkpoint.dir. Where that is unset, a local master (tests) gets a temporary one; others must set it."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIR:
            _OWN_DIR[app] = tempfile.mkdtemp(prefix="tierloom-")
        set_to = _OWN_DIR[app]
    return set_to.rstrip("/")


#: Rows of an Arrow batch that a Python worker turns into objects at once.
SLICE = 256


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE rows: a text's words, features or shingles as Python objects take many times its bytes."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def settle(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors.

    files: the most to write, for a frame that is known to be small. Each file costs several calls of the file system,
    and where Hadoop lacks its native library, as many processes forked from the executor.
    """
    df = df.coalesce(files) if files else df
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most buckets of a sieve (256 bits each: 4 MB of bits), and most keys for one: with more it would let nearly all rows pass.
SIEVE_BUCKETS, SIEVE_KEYS = 1 << 17, 1 << 23


def sieved(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with _hit: false only if the row's key (a long, a hash) is not among keys (settled, with a column of the same name).

    keys are marked in a bitmap of about 16 bits a key. Its size is bounded, so it is broadcast; beyond SIEVE_KEYS every
    row is a hit. It saves shuffles and decides nothing: a join must follow.
    """
    n = keys.count()
    if n > SIEVE_KEYS:
        return rows.withColumn("_hit", F.lit(True))
    buckets = min(SIEVE_BUCKETS, max(16, 1 << (n // 16).bit_length()))
    at = f"cast({key} & {buckets - 1} as int)"
    bit = keys.selectExpr(f"{at} AS _bucket", f"cast(shiftrightunsigned({key}, 32) & 255 as int) AS _pos")
    words = [F.bit_or(F.expr(f"CASE WHEN _pos DIV 64 = {i} THEN shiftleft(1L, _pos & 63) ELSE 0L END")).alias(f"_w{i}") for i in range(4)]
    word = f"CASE cast(shiftrightunsigned({key}, 38) & 3 as int) WHEN 0 THEN _w0 WHEN 1 THEN _w1 WHEN 2 THEN _w2 ELSE _w3 END"
    hit = F.expr(f"coalesce(shiftright({word}, cast(shiftrightunsigned({key}, 32) & 63 as int)) & 1 = 1, false)")
    marked = rows.withColumn("_bucket", F.expr(at)).join(F.broadcast(bit.groupBy("_bucket").agg(*words)), "_bucket", "left")
    return marked.withColumn("_hit", hit).drop("_bucket", "_w0", "_w1", "_w2", "_w3")


def sifted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among keys, and by chance a few others."""
    return sieved(rows, keys, key).where("_hit").drop("_hit")


def without(docs: DataFrame, gone: DataFrame, keys: list[Column], twice: DataFrame | None = None) -> DataFrame:
    """docs but the rows whose keys (the first a hash, _k1) are in gone; rows that are not hit by the sieve are not shuffled.

    twice: keys of rows that stand more than once, of which one is to stay.
    """
    names = gone.columns
    gone = settle(gone.distinct(), "gone")
    hits = gone if twice is None else gone.unionByName(settle(twice, "twice"))
    own = sieved(docs.select(F.struct("*").alias("_row"), *keys), hits, "_k1")
    near = own.where("_hit").drop("_hit").join(gone, names, "left_anti")
    if twice is not None:
        near = near.dropDuplicates(names)
    return own.where("NOT _hit").select("_row.*").unionByName(near.select("_row.*"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_bucket(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5
