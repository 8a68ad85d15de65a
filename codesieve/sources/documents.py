"""Readers and writers of findings logs, manifests, inventories and summaries."""

from __future__ import annotations

import fcntl
import json
import os
import time
import tomllib

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import text as X

REGION = "struct<startLine:int,startColumn:int,endLine:int,endColumn:int,byteOffset:bigint,byteLength:bigint>"
LOCATION = f"struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:{REGION}>>"
RESULT = f"struct<ruleId:string,level:string,message:struct<text:string>,locations:array<{LOCATION}>,relatedLocations:array<{LOCATION}>,partialFingerprints:map<string,string>,properties:string,baselineState:string>"
RULE = "struct<id:string,name:string,shortDescription:struct<text:string>>"
RUN = f"struct<tool:struct<driver:struct<name:string,version:string,informationUri:string,rules:array<{RULE}>>>,results:array<{RESULT}>>"
LOG = f"`$schema` string, version string, runs array<{RUN}>"
#: File names of the passes' logs.
PASSES = {"token": "token.sarif.json", "ast": "ast.sarif.json", "refined": "refined.sarif.json"}


def pass_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{PASSES[name]}"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each result of the logs at ``path``: run, ord, tool and the result's fields."""
    logs = spark.read.schema(LOG).json(path, multiLine=True)
    runs = logs.select(F.posexplode("runs").alias("run", "r"))
    return runs.select("run", F.col("r.tool.driver.name").alias("tool"), F.posexplode("r.results").alias("ord", "result")).select("run", "ord", "tool", "result.*")


def without_empty(df: DataFrame) -> DataFrame:
    """Empty arrays and maps become null, which JSON leaves out."""
    kinds = (T.ArrayType, T.MapType)
    return df.select(*(F.when(F.size(f.name) > 0, F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema))


def to_json(df: DataFrame) -> DataFrame:
    return without_empty(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def write_results(df: DataFrame, path: str) -> None:
    without_empty(df).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def wrapped_properties(props, key: str = "clone"):
    """A property bag under one key, as JSON."""
    return F.to_json(F.struct(props.alias(key)))


def unwrapped_properties(text, schema: str, key: str = "clone"):
    return F.from_json(F.get_json_object(text, f"$.{key}"), schema)


def libraries(files: DataFrame, path: str = "path", prefix: str = "lib", suffix: str = ".so") -> DataFrame:
    """Installed libraries by toolchain from a listing: toolchain, crates in order."""
    parts = X.library_parts(F.element_at(F.split(path, "/"), -1), prefix, suffix)
    return files.select(parts.alias("x")).filter("x is not null").groupBy("x.toolchain").agg(F.array_sort(F.collect_set("x.crate")).alias("crates"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Paths, lengths and SHA-256 of the files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"))


def inventory_text(libs: DataFrame) -> DataFrame:
    return libs.select(F.concat(F.col("toolchain"), F.lit(": "), F.array_join("crates", ", ")).alias("value"))


def inventory_json(libs: DataFrame) -> DataFrame:
    return libs.select(F.to_json(F.struct("toolchain", "crates"), {"pretty": "true"}).alias("value"))


def parse_toml_manifest(text: str) -> list[dict]:
    """Packages of a TOML manifest; a name that stands twice is an error."""
    rows = tomllib.loads(text).get("package", [])
    names = [r.get("package") or r.get("name") for r in rows]
    again = sorted({n for n in names if names.count(n) > 1})
    if again:
        raise ValueError(f"duplicate packages: {', '.join(map(str, again))}")
    return rows


def parse_json_manifest(texts: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Parsed manifests by a DDL schema; a broken one has null fields and its text in ``_bad``."""
    full = f"{schema}, _bad string"
    return texts.select(F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("m")).select("m.*")


def append_summary(call_sites: DataFrame, path: str) -> None:
    """A line for each callee with its redacted argument shapes, appended."""
    call_sites.select(F.concat_ws("\t", "callee", F.col("n_calls").cast("string"), F.array_join("shapes", ";"))).write.mode("append").text(path)


def record_metrics(path: str, update: dict, patience: float = 10.0) -> tuple[dict, bool]:
    """Add counters to a small JSON file; (totals, whether a broken file was started anew).

    Writers take turns by a lock on ``<path>.lock`` and give up with TimeoutError after ``patience`` seconds; the file is replaced
    in one step, so readers see the old or the new totals. For a local path of the driver, as the counters are its own.
    """
    with open(f"{path}.lock", "a") as lock:
        _locked(lock, patience)
        old, reset = {}, False
        try:
            with open(path) as f:
                old = json.load(f)
            if not isinstance(old, dict):
                raise ValueError
        except FileNotFoundError:
            pass
        except ValueError:
            old, reset = {}, True
        new = {k: int(old.get(k, 0)) + int(update.get(k, 0)) for k in {*old, *update}}
        with open(f"{path}.new", "w") as f:
            json.dump(new, f, sort_keys=True)
        os.replace(f"{path}.new", path)
    return new, reset


def _locked(lock, patience: float) -> None:
    """Wait for the lock; it goes with the file's closing."""
    end = time.monotonic() + patience
    while True:
        try:
            return fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            if time.monotonic() > end:
                raise TimeoutError(f"{lock.name} is held by another writer") from None
            time.sleep(0.02)
