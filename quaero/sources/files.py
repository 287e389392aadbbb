"""Readers and writers: JSON and JSON lines, CSV, cached tables with manifests, hashes, byte ranges, configurations."""

from __future__ import annotations

import hashlib
import json
import zlib
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "id string, name string, content string"
LOG = "query_id long, retriever string, rank int, score double, id long"


class BadLine(ValueError):
    """A line of a JSON-lines file that is no JSON object."""


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document or array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A JSON-lines table; blank lines are skipped.

    Strict: a line that is no JSON object raises :class:`BadLine` with its text.
    Lenient: such lines are left out, and a missing path has no rows.
    """
    if not strict and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    whole = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    if strict and (first := lines.where(~whole).limit(1).collect()):
        raise BadLine(f"{path}: {first[0].value[:200]}")
    return lines.where(whole).select(F.from_json("value", schema).alias("r")).select("r.*")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files that are no JSON, counted from 1 within each file."""

    def number(rows):
        import pandas as pd

        for pdf in rows:
            for file, text in zip(pdf["path"], pdf["content"], strict=True):
                found = []
                for i, line in enumerate(bytes(text).decode("utf-8", "replace").split("\n"), 1):
                    if line.strip():
                        try:
                            if not isinstance(json.loads(line), dict):
                                found.append((file, i, line))
                        except ValueError:
                            found.append((file, i, line))
                yield pd.DataFrame(found, columns=["file", "line", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(number, "file string, line long, value string")


def write_jsonl(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; an append adds files, an overwrite replaces the folder in one commit."""
    table.write.mode(mode).json(path, ignoreNullFields=False)


def write_json(value, path: str) -> None:
    """One small document, indented."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False)


def write_csv(table: DataFrame, path: str) -> None:
    """A small report in one file, with a header."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def cached(spark: SparkSession, path: str, manifest: dict, build) -> DataFrame:
    """The table at ``path`` if it was written with this manifest; else ``build()``, written there in one commit.

    The manifest (fingerprint, parameters, versions) is stored beside the rows,
    so a change of any of them is a miss.
    """
    wanted = json.dumps(manifest, sort_keys=True)
    try:
        if spark.read.text(f"{path}/manifest").first()[0] == wanted:
            return spark.read.parquet(f"{path}/rows")
    except AnalysisException:
        pass
    build().write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return spark.read.parquet(f"{path}/rows")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def artefacts(spark: SparkSession, pattern: str, suffixes: tuple[str, ...]) -> list[str]:
    """Names of files that match a glob and end, before their type, in one of the suffixes after an underscore."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    names = [s.getPath().getName() for s in found]
    return sorted(n for n in names if Path(n).stem.rsplit("_", 1)[-1] in suffixes)


def byte_ranges(size: int, chunk: int) -> list[tuple[int, int, int]]:
    """(part, first, last) byte of each range of a download."""
    return [(i, a, min(a + chunk, size) - 1) for i, a in enumerate(range(0, size, chunk))]


def merged(base: dict, own: dict) -> dict:
    """``base`` with ``own`` over it, nested objects merged."""
    out = dict(base)
    for k, v in own.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str) -> dict:
    """A configuration, over the one that its base_config names (relative to it)."""
    own = json.loads(Path(path).read_text(encoding="utf-8"))
    base = own.pop("base_config", None)
    return merged(load_config(str(Path(path).parent / base)), own) if base else own


#: Bytes of rows that :func:`fingerprint` packs at a time.
CHUNK = 1 << 20


def _packed(batches):
    """(part, seq, body): the rows of one sorted partition, end to end and compressed, in chunks of some CHUNK bytes."""
    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def chunk():
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()), "body": pa.array([zlib.compress(b"".join(held), 1)], pa.binary())})

    for batch in batches:
        for row in batch.column(0):
            held.append(row.as_py())
            size += len(held[-1])
            if size >= CHUNK:
                yield chunk()
                seq, held, size = seq + 1, [], 0
    if held:
        yield chunk()


def _hashed(batches):
    """The hash of chunks that come in order."""
    whole = hashlib.sha256()
    for batch in batches:
        for body in batch.column(0):
            whole.update(zlib.decompress(body.as_py()))
    yield pa.RecordBatch.from_pydict({"sha256": [whole.hexdigest()]})


def fingerprint(table: DataFrame, order: str, *columns: str) -> DataFrame:
    """(sha256): of the rows in order, each its columns joined by NUL and ended by a line feed.

    Rows are sorted by ranges and packed in parallel.  One task reads the
    chunks in order, as a hash of a whole must, and holds a batch of them.
    """
    row = F.concat(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit("\n"))
    rows = table.select(F.col(order).alias("o"), row.cast("binary").alias("r")).repartitionByRange("o").sortWithinPartitions("o", "r")
    chunks = rows.select("r").mapInArrow(_packed, "part int, seq long, body binary")
    whole = chunks.repartition(1).sortWithinPartitions("part", "seq").select("body").mapInArrow(_hashed, "sha256 string")
    return whole.agg(F.coalesce(F.max("sha256"), F.lit(hashlib.sha256().hexdigest())).alias("sha256"))  # without rows there may be no task


def wide_fingerprint(table: DataFrame, *columns: str) -> DataFrame:
    """(rows, digest) that needs no order and no single task: the count, and the XOR and sum of row hashes."""
    row = F.xxhash64(*columns)
    return table.agg(F.count("*").alias("rows"), F.bit_xor(row).alias("digest"), F.sum(row.cast("decimal(20,0)")).cast("string").alias("total"))
