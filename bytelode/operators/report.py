"""Reports of carved files: counts, audit rows, one JSON document for each image, and the files themselves."""

from __future__ import annotations

import json
import os
import platform
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from bytelode.sources.store import read_ranges
from bytelode.sources.text import write_ordered

RUN = "struct<offset: long, img_offset: long, len: long>"
SCAN = "struct<width: int, height: int, fragmentation_point_img_offset: long, has_restart_markers: boolean, status: string>"
FILEOBJECT = f"struct<filename: string, filesize: long, file_type: string, byte_runs: array<{RUN}>, jpeg_scan: {SCAN}>"
ENVIRONMENT = "struct<os_sysname: string, os_release: string, os_version: string, host: string, arch: string, uid: int, start_time: string>"
REPORT = f"metadata struct<dc_type: string>, creator struct<package: string, version: string, execution_environment: {ENVIRONMENT}>, source struct<image_filename: string, sectorsize: int, image_size: long, volume: struct<byte_runs: array<{RUN}>>>, configuration map<string, string>, fileobjects array<{FILEOBJECT}>"


def found_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(F.count("*").alias("found"))


def summary(images: DataFrame, files: DataFrame) -> DataFrame:
    """image_id, bytes_read, n_files and bytes_carved for every image, carved or not."""
    by = files.groupBy("image_id").agg(F.count("*").alias("n_files"), F.sum("filesize").alias("bytes_carved"))
    read = images.select("image_id", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("bytes_read"))
    return read.join(by, "image_id", "left").select("image_id", "bytes_read", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), F.coalesce("bytes_carved", F.lit(0)).cast("long").alias("bytes_carved"))


def audit(files: DataFrame) -> DataFrame:
    """num, name, size, file_offset and comment: per image, in the order of the files."""
    return files.select("image_id", F.col("seq").alias("num"), F.concat(F.col("seq").cast("string"), F.lit("."), F.col("suffix")).alias("name"), F.col("filesize").alias("size"), F.col("img_offset").alias("file_offset"), "comment")


AUDIT_HEAD = "Num\tName\tSize\tFile Offset\tComment"


def audit_text(images: DataFrame, files: DataFrame) -> DataFrame:
    """The text log of all images, as lines (image_id, place, num, line): of each image a header, its files, and the closing lines.

    images has image_id and bytes_read.
    """
    row = F.concat_ws("\t", F.col("num").cast("string"), "name", F.col("size").cast("string"), F.col("file_offset").cast("string"), "comment")
    rows = audit(files).select("image_id", F.lit(1).alias("place"), F.col("num").cast("long").alias("num"), row.alias("line"))
    head = images.select("image_id", F.lit(0).alias("place"), F.lit(0).cast("long").alias("num"), F.lit(f"{AUDIT_HEAD}\n").alias("line"))
    foot = images.select("image_id", F.lit(2).alias("place"), F.lit(0).cast("long").alias("num"), F.concat(F.lit("\nFinished carving. Total bytes read: "), F.col("bytes_read").cast("string")).alias("line"))
    return head.unionAll(rows).unionAll(foot)


def audit_lines(files: DataFrame, bytes_read: int) -> list[str]:
    """The text log of one image: a header, its rows, and the closing lines."""
    one = files.sparkSession.createDataFrame([(None, bytes_read)], "image_id string, bytes_read long")
    rows = audit_text(one, files.withColumn("image_id", F.lit(None).cast("string"))).orderBy("place", "num")
    return "\n".join(r.line for r in rows.select("line").toLocalIterator()).split("\n")


def write_audit(images: DataFrame, files: DataFrame, target: str) -> int:
    """The text log of all images, one after the other, as one file."""
    lines = audit_text(images, files).withColumn("line", F.concat("line", F.lit("\n")))
    return write_ordered(lines, ["image_id", "place", "num"], target)


def environment() -> Row:
    u = platform.uname()
    names = ("os_sysname", "os_release", "os_version", "host", "arch", "uid", "start_time")
    return Row(*names)(u.system, u.release, u.version, u.node, u.machine, getattr(os, "getuid", lambda: 0)(), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S+0000"))


def reports(images: DataFrame, files: DataFrame, package: str = "bytelode", version: str = "1.0") -> DataFrame:
    """image_id and report (nested) for each image; a report holds all its image's files, as the document does."""
    objects = files.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct("filename", "filesize", "file_type", "byte_runs", "jpeg_scan").alias("o")))).alias("z"))
    e = environment()
    env = F.struct(*(F.lit(v).alias(k) for k, v in e.asDict().items()))
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    source = F.struct(F.col("image_id").alias("image_filename"), F.lit(512).alias("sectorsize"), size.alias("image_size"), F.struct(F.array(F.struct(F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("img_offset"), size.alias("len"))).alias("byte_runs")).alias("volume"))
    creator = F.struct(F.lit(package).alias("package"), F.lit(version).alias("version"), env.alias("execution_environment"))
    found = F.coalesce(F.transform("z", lambda x: x["o"]), F.array().cast(f"array<{FILEOBJECT}>"))
    report = F.struct(F.struct(F.lit("Carve Report").alias("dc_type")).alias("metadata"), creator.alias("creator"), source.alias("source"), F.create_map().cast("map<string,string>").alias("configuration"), found.alias("fileobjects"))
    return images.join(objects, "image_id", "left").select("image_id", report.alias("report"))


def _source(size: Column, name: Column) -> Column:
    run = F.struct(F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("img_offset"), size.alias("len"))
    return F.struct(name.alias("image_filename"), F.lit(512).alias("sectorsize"), size.alias("image_size"), F.struct(F.array(run).alias("byte_runs")).alias("volume"))


def file_object(jpeg_scan: Column) -> Column:
    """A file object as JSON: jpeg_scan is left out where there is none, but stands with nulls inside where there is."""
    fields = ["filename", "filesize", "file_type", "byte_runs"]
    keep = {"ignoreNullFields": "false"}
    return F.when(jpeg_scan.isNull(), F.to_json(F.struct(*fields), keep)).otherwise(F.to_json(F.struct(*fields, jpeg_scan.alias("jpeg_scan")), keep))


def merged_lines(images: DataFrame, files: DataFrame, package: str = "bytelode", version: str = "1.0") -> DataFrame:
    """One JSON report over all images, as pieces of text in the order of (place, image_id, seq): no row holds more than one file.

    images has image_id and bytes_read. The files of all images stand in the order of these; the source is the last image.
    """
    last = images.agg(F.max(F.struct("image_id", "bytes_read")).alias("z"))
    env = F.struct(*(F.lit(v).alias(k) for k, v in environment().asDict().items()))
    creator = F.struct(F.lit(package).alias("package"), F.lit(version).alias("version"), env.alias("execution_environment"))
    part = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    head = F.concat_ws(",\n", F.lit('{"metadata": {"dc_type": "Carve Report"}'), part("creator", F.to_json(creator)), part("source", F.to_json(_source(F.coalesce("z.bytes_read", F.lit(0)), F.coalesce("z.image_id", F.lit(""))))), F.lit('"configuration": {}'), F.lit('"fileobjects": [\n'))
    none = F.lit(None).cast("string"), F.lit(None).cast("int")
    first = files.agg(F.min(F.struct("image_id", "seq")).alias("first"))
    rows = files.join(F.broadcast(first))
    begins = F.struct("image_id", "seq").eqNullSafe(F.col("first"))
    rows = rows.select(F.lit(1).alias("place"), "image_id", "seq", F.concat(F.when(begins, "").otherwise(",\n"), file_object(F.col("jpeg_scan"))).alias("line"))
    return last.select(F.lit(0).alias("place"), none[0].alias("image_id"), none[1].alias("seq"), head.alias("line")).unionAll(rows).unionAll(last.select(F.lit(2), *none, F.lit("\n]}\n")))


def write_merged(images: DataFrame, files: DataFrame, target: str) -> int:
    """`merged_lines` as one file."""
    return write_ordered(merged_lines(images, files), ["place", "image_id", "seq"], target)


def to_document(report: Row) -> dict:
    """A report as written: jpeg_scan is left out where there is none, but stands with nulls inside where there is."""
    out = report.asDict(recursive=True)
    out["fileobjects"] = [{k: v for k, v in o.items() if k != "jpeg_scan" or v is not None} for o in out["fileobjects"]]
    return out


def write_report(report: Row, directory: str) -> str:
    os.makedirs(directory, exist_ok=True)
    at = os.path.join(directory, "carve_report.json")
    with open(at, "w") as f:
        json.dump(to_document(report), f, indent=2)
    return at


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """File objects of JSON reports, with image_filename and seq in their order."""
    rows = spark.read.schema(REPORT).json(path, multiLine=True)
    return rows.select(F.col("source.image_filename").alias("image_filename"), F.posexplode("fileobjects").alias("seq", "o")).select("image_filename", (F.col("seq") + 1).alias("seq"), "o.*")


def payloads(images: DataFrame | None, files: DataFrame) -> DataFrame:
    """The bytes of each file: image_id, filename, data. Without images each image_id is a path, of which only the files' ranges are read."""
    run = F.col("byte_runs")[0]
    if images is None:
        asked = files.select("image_id", "filename", F.col("image_id").alias("path"), run["img_offset"].alias("offset"), run["len"].alias("length"))
        return read_ranges(asked).select("image_id", "filename", F.col("bytes").alias("data"))
    return files.join(images, "image_id").select("image_id", "filename", F.substring("content", (run["img_offset"] + 1).cast("int"), run["len"].cast("int")).alias("data"))
