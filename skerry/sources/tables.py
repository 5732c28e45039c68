"""Readers and writers: vector blobs, segment files, log fragments, and the folder executors share."""

from __future__ import annotations

import hashlib
import re
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.errors import CorruptedFile, IntegrityFailure

#: A segment's first bytes, version, header size and the type number of 4-byte floats.
MAGIC, VERSION, HEADER, FLOAT32 = b"VDBX", 1, 64, 1
_LAYOUT = "<4sHHQIB3x32s8x"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where none is set and all runs in this JVM (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='skerry-')}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, gone when the JVM ends: later plans read it and don't compute it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skerry-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


@F.pandas_udf(T.BinaryType())
def encode_blob(v: pd.Series) -> pd.Series:
    """Little-endian 4-byte floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_blob(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, dtype="<f4"))


def write_segment(vectors: np.ndarray) -> bytes:
    """A segment file's bytes: header with SHA-256, then the rows."""
    data = np.ascontiguousarray(vectors, dtype="<f4").tobytes()
    n, dim = vectors.shape
    return struct.pack(_LAYOUT, MAGIC, VERSION, 0, n, dim, FLOAT32, hashlib.sha256(data).digest()) + data


def read_segment(content: bytes) -> np.ndarray:
    if len(content) < HEADER:
        raise CorruptedFile("no header")
    magic, version, _, n, dim, kind, digest = struct.unpack(_LAYOUT, content[:HEADER])
    data = content[HEADER:]
    if magic != MAGIC or version != VERSION or kind != FLOAT32 or len(data) != 4 * n * dim:
        raise CorruptedFile("bad header")
    if hashlib.sha256(data).digest() != digest:
        raise IntegrityFailure("checksum differs")
    return np.frombuffer(data, dtype="<f4").reshape(n, dim)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, vector) of segment files; every file is read and checked in one task."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                x = read_segment(content)
                for i in range(0, len(x), 10_000):
                    yield pd.DataFrame({"path": p, "row": np.arange(i, min(i + 10_000, len(x))), "vector": list(x[i : i + 10_000])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, row long, vector array<float>")


def read_fragments(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """Operations with seq > after of JSON log fragments; their folders' names prune older ones."""
    schema = "seq long, op string, collection_id string, id long, vector array<float>, document string"
    out = spark.read.schema(f"{schema}, bucket long").json(path)
    return out.where((F.col("bucket") >= after - after % 4096) & (F.col("seq") > after)).drop("bucket")


def write_fragments(ops: DataFrame, path: str) -> None:
    ops.withColumn("bucket", (F.floor(F.col("seq") / 4096) * 4096).cast("long")).write.mode("append").partitionBy("bucket").json(path)


def fragment_key(seq: Column) -> Column:
    """Object name of the fragment that begins at seq."""
    return F.format_string("Bucket=%d/Seq=%016x.bin", (F.floor(seq / 4096) * 4096).cast("long"), seq)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(id, filename, path, content) of image files, ids from 1 in path order; an embedder is applied as a pandas UDF."""
    from pyspark.sql import Window

    suffix = F.lower("path").rlike("(" + "|".join(x.replace(".", r"\.") for x in IMAGE_SUFFIXES) + ")$")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(suffix)
    # Ranges of paths, numbered each for itself and moved up by what the ranges before hold: no task sees all paths.
    paths = written(files.select("path").repartitionByRange("path").withColumn("part", F.spark_partition_id()))
    before, first = 0, {}
    for part, n in sorted((r.part, r["count"]) for r in paths.groupBy("part").count().collect()):
        first[part] = before
        before += n
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in first.items() for x in kv)), F.col("part").cast("long")) if first else F.lit(0).cast("long")
    ids = paths.select("path", (F.row_number().over(Window.partitionBy("part").orderBy("path")) + offset).alias("id"))
    return files.join(ids, "path").select("id", F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "content")


def hash_embedder(dim: int = 64):
    """A deterministic stand-in for an embedding model: unit vectors from SHA-256 of the content (null for null)."""

    @F.pandas_udf("array<float>")
    def embed(content: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            raw = x.encode() if isinstance(x, str) else bytes(x)
            seed = int.from_bytes(hashlib.sha256(raw).digest()[:8], "little")
            v = np.random.default_rng(seed).standard_normal(dim)
            return (v / np.linalg.norm(v)).astype(np.float32)

        return content.map(one)

    return embed
