"""Case shards with their meta documents, and their merge.

A shard is a file of JSON lines, or a folder of such files, and ``<shard>.meta.json`` beside
it.  ``write_shard`` writes the meta last, in one step, so that a shard without it is one
whose job has not finished: it may be written again, and a merge refuses it unless
told otherwise.  A merge holds each shard against the number in its meta and refuses
case ids that come twice; ids are compared by Spark, only numbers reach the driver.
"""

from __future__ import annotations

import json
from collections import Counter
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from .cases import Cases, case_rows, read_cases

META = ".meta.json"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """The document in one step: written under another name, then renamed over what there was."""
    at, fs = _files(spark, path + META)
    part, _ = _files(spark, path + META + ".part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps(meta, indent=2, sort_keys=True, ensure_ascii=False).encode()))
    finally:
        out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(part, at):
        raise OSError(f"cannot rename {part} to {at}")


def read_meta(spark: SparkSession, path: str) -> dict | None:
    """A shard's meta document, or None where it has none."""
    at, fs = _files(spark, path + META)
    if not fs.exists(at):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path + META, wholetext=True).collect()))


def _require_unique(df: DataFrame) -> None:
    twice = df.groupBy("case_id").count().filter("count > 1").orderBy("case_id").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate case ids: {[r['case_id'] for r in twice]}")


def write_shard(cases: Cases, path: str) -> dict:
    """Write the cases in order of their ids and then the meta document, which is returned."""
    spark = cases.cases.sparkSession
    if read_meta(spark, path) is not None:
        raise FileExistsError(f"{path} is a finished shard")
    case_rows(cases).orderBy("case_id").write.mode("overwrite").json(path)
    # What was written counts, not what was meant to be.
    back = spark.read.schema("case_id string").json(path)
    _require_unique(back)
    meta = {"n_cases": back.count(), "out": path}
    write_meta(spark, path, meta)
    return meta


def shard_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Shards by glob in order of their names; an error if there are none."""
    at, fs = _files(spark, pattern)
    found = sorted(str(s.getPath()) for s in fs.globStatus(at) or () if not str(s.getPath()).endswith((META, META + ".part")))
    if not found:
        raise FileNotFoundError(f"no shards match {pattern}")
    return found


def _plain(uri: str) -> str:
    return unquote(urlparse(uri).path).rstrip("/")


def shard_counts(spark: SparkSession, shards: list[str]) -> dict[str, int]:
    """Cases of each shard by its name; the names of files are the driver's own listing."""
    rows = spark.read.schema("case_id string").json(shards).filter("case_id IS NOT NULL")
    by_file = rows.groupBy(F.col("_metadata.file_path").alias("file")).count().collect()
    at = {_plain(p): p.rstrip("/").rsplit("/", 1)[1] for p in shards}
    counts = Counter(dict.fromkeys(at.values(), 0))
    for r in by_file:
        file = _plain(r["file"])
        counts[at[file] if file in at else at[file.rsplit("/", 1)[0]]] += r["count"]
    return dict(sorted(counts.items()))


def merge_case_shards(spark: SparkSession, pattern: str, out: str, manifest_total: int = 500, finished_only: bool = True) -> dict:
    """All shards as one case file in order of the ids, with its meta document, which is returned.

    ``finished_only`` refuses shards without a meta document; turned off, plain
    files of cases from elsewhere are taken too.
    """
    shards = shard_paths(spark, pattern)
    counts = shard_counts(spark, shards)
    for path in shards:
        name, meta = path.rstrip("/").rsplit("/", 1)[1], read_meta(spark, path)
        if meta is None and finished_only:
            raise ValueError(f"shard {name} is not finished")
        if meta is not None and meta["n_cases"] != counts[name]:
            raise ValueError(f"shard {name} has {counts[name]} cases, its meta says {meta['n_cases']}")
    cases = read_cases(spark, shards)
    _require_unique(cases.cases)
    case_rows(cases).orderBy("case_id").write.mode("overwrite").json(out)
    stats = {"manifest_total_rows": manifest_total, "normalized_adapter_valid_cases": sum(counts.values()), "n_shards": len(shards), "shard_counts": counts, "n_cases": sum(counts.values()), "out": out}
    write_meta(spark, out, stats)
    return stats
