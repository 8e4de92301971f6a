"""Writing results: only new rows, replaced partitions, versions of a table."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, known: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key ``known`` lacks, the first by ``order`` where the batch repeats one."""
    from terralens.operators.relational import first_per_key

    return first_per_key(batch, key, order).join(known.select(*key), key, "left_anti")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write ``df`` so that only the partitions it holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_version(df: DataFrame, root: str) -> int:
    """Write ``df`` as the next version of the table at ``root``; a version counts once its manifest is renamed in place.

    Each writer has a folder of its own, which the manifest names, so two writers of one version don't touch each
    other's data: one wins, the other gets an error.
    """
    spark = df.sparkSession
    version = (current_version(spark, root) or 0) + 1
    folder = f"v={version}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{root}/{folder}")
    fs, tmp = _fs(spark, f"{root}/_writing.{folder}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps({"version": version, "folder": folder}).encode()))
    out.close()
    _, final = _fs(spark, f"{root}/_manifest.{version:012d}.json")
    if fs.exists(final) or not fs.rename(tmp, final):
        fs.delete(tmp, False)
        raise OSError(f"version {version} of {root} was written by another")
    return version


def current_version(spark: SparkSession, root: str) -> int | None:
    """The newest complete version, or None."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max((int(n.split(".")[1]) for n in names if n.startswith("_manifest.")), default=None)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of the table at ``root``, the newest by default."""
    number = version or current_version(spark, root)
    if number is None:
        raise FileNotFoundError(f"{root} has no version")
    fs, final = _fs(spark, f"{root}/_manifest.{number:012d}.json")
    stream = fs.open(final)
    manifest = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    return spark.read.parquet(f"{root}/{manifest['folder']}")


def append_audit(spark: SparkSession, path: str, actor: str, action: str, target: str, detail: dict | None = None) -> None:
    """Append one line to the audit trail at ``path``: who did what to what, and when."""
    row = spark.createDataFrame([(actor, action, target, json.dumps(detail or {}, sort_keys=True))], "actor string, action string, target string, detail string")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def params_key(**params: object) -> str:
    """Short key of the given parameters; those that are None don't count, nor does their order."""
    return hashlib.sha1("&".join(f"{k}={v}" for k, v in sorted(params.items()) if v is not None).encode()).hexdigest()[:16]


def weak_etag(df: DataFrame) -> str:
    """Weak entity tag of a result: order-insensitive over its rows, computed where they are."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    n, s, x = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return 'W/"' + hashlib.sha1(f"{n}:{s}:{x}".encode()).hexdigest()[:20] + '"'
