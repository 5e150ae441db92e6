"""Versioned tables: write a generation under a name of its own, then claim its number.

A generation is a set of Parquet tables and a manifest that names them.  A publication
checks the generation that it was based on, writes its tables into a folder that nobody
else writes to, and renames its manifest, whole, to the manifest of the next number.
That rename does not replace: of two writers with the same base one gets the number and
the other StaleBaseline, and neither touches what the other or any earlier generation
wrote.  A writer that dies leaves a folder that no manifest names and blocks nobody.
Publishing what is already there keeps the generation.  All paths go through Hadoop's
file system, so a shared store works as well as a local folder.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leanspan.operators.aggregates import ordered_digest


class StaleBaseline(Exception):
    """Somebody published since the baseline was read."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def manifest(spark: SparkSession, root: str, generation: int | None = None) -> dict:
    """generation (0 if none), tables with their folders, and digests of the current (or a given) generation."""
    fs, path = _fs(spark, root)
    if generation is None:
        names = [x.getPath().getName() for x in fs.listStatus(path(root))] if fs.exists(path(root)) else []
        generation = max((int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), default=0)
    if not generation:
        return {"generation": 0, "tables": {}, "schemas": {}, "digests": {}}
    stream = fs.open(path(f"{root}/manifest-{generation}.json"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read(spark: SparkSession, root: str, name: str, generation: int | None = None) -> DataFrame:
    """A table of the current (or a given) generation, pinned when called."""
    return open_table(spark, root, manifest(spark, root, generation), name)


def open_table(spark: SparkSession, root: str, of: dict, name: str) -> DataFrame:
    """A table that a manifest names, with the schema it was written with: no file is opened to find it out."""
    return spark.read.schema(StructType.fromJson(of["schemas"][name])).parquet(f"{root}/{of['tables'][name]}")


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order; made on the executors."""
    row = df.select(F.lit("t").alias("k"), F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("p"))
    counted = row.groupBy("k", "p").agg(F.count("*").cast("string").alias("n"))
    got = ordered_digest(counted, "k", "p", "n").collect()
    return f"{got[0]['entries']}:{got[0]['digest']}" if got else "0:"


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], baseline: int, digests: dict[str, str] | None = None, partitions: dict[str, list[str]] | None = None) -> tuple[int, bool]:
    """(generation, whether anything was published).

    ``digests`` may name what the tables are made of; without it their rows are digested.
    ``partitions`` are the folder columns of tables.
    """
    now = manifest(spark, root)
    if now["generation"] != baseline:
        raise StaleBaseline(f"based on {baseline}, current is {now['generation']}")
    digests = digests or {n: table_digest(df) for n, df in tables.items()}
    if digests == now["digests"]:
        return baseline, False
    generation, own = baseline + 1, f"tables-{uuid.uuid4().hex}"
    for n, df in tables.items():
        df.write.mode("errorifexists").partitionBy(*(partitions or {}).get(n, [])).parquet(f"{root}/{own}/{n}")
    text = json.dumps({"generation": generation, "tables": {n: f"{own}/{n}" for n in sorted(tables)}, "schemas": {n: df.schema.jsonValue() for n, df in tables.items()}, "digests": digests}, sort_keys=True)
    fs, path = _fs(spark, root)
    staged = path(f"{root}/{own}/manifest.json")
    out = fs.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    target = fs.makeQualified(path(f"{root}/manifest-{generation}.json"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        # without OVERWRITE this fails when somebody has the number already
        context.rename(fs.makeQualified(staged), target, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e):
            raise
        raise StaleBaseline(f"generation {generation} was published meanwhile") from e
    return generation, True
