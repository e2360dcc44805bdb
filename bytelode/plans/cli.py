"""Command line: `carve` (default) and `recover`."""

from __future__ import annotations

import argparse
import json
import os
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.operators import recover as R
from bytelode.operators import report
from bytelode.operators.reporter import JsonReporter, tell
from bytelode.operators.specs import builtin_specs, combined_specs, save_specs
from bytelode.plans.carve import CarveConfig, carve
from bytelode.sources import images as I
from bytelode.sources import store
from bytelode.sources.scratch import owned, settle


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bytelode")
    add = p.add_argument
    add("-d", "--debug", action="store_true")
    add("-t", "--types", default="", help="comma list of suffixes, or all")
    add("-o", "--output-directory", default="output")
    add("--prefix-filenames", action="store_true")
    add("--disable-builtin", action="store_true")
    add("-c", "--config-file")
    add("--save-config", metavar="FILE", help="write the built-in catalog and stop")
    add("-j", "--concurrent-files", type=int, default=max(1, (os.cpu_count() or 2) - 1))
    for flag in ("--disable-validation", "--report-only", "--disable-report", "--disable-audit"):
        add(flag, action="store_true")
    add("-q", "--quick", action="store_true")
    add("-b", "--block-size", type=int, default=512)
    add("-a", "--write-all", action="store_true")
    add("files", nargs="*", help="images; none: standard input")
    return p


def recover_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bytelode recover")
    add = p.add_argument
    add("-i", "--image", required=True)
    add("-r", "--report", required=True)
    add("-o", "--output", default="recovered")
    add("-b", "--block-size", type=int, default=512)
    add("-w", "--search-window", type=int, default=50 << 20)
    add("-n", "--candidates", type=int, default=3)
    add("--min-entropy", type=float, default=7.0)
    add("-d", "--debug", action="store_true")
    return p


#: Larger files don't fit into a row: they are carved by chunks.
ROW = 2 << 30


def run_carve(spark: SparkSession, args: argparse.Namespace) -> int:
    """Files, one audit log and one report over all images. Files that can't be read are named, and the run goes on."""
    if args.save_config:
        save_specs(builtin_specs(), args.save_config)
        return 0
    if args.debug:
        spark.sparkContext.setLogLevel("INFO")
    specs = combined_specs([t.strip() for t in args.types.split(",") if t.strip()], args.disable_builtin, args.config_file)
    config = CarveConfig(specs, "file" if args.files else "buffer", I.CHUNK, args.block_size, args.quick, args.disable_validation, args.write_all, args.prefix_filenames or len(args.files) > 1)
    out = os.path.abspath(args.output_directory)
    os.makedirs(out, exist_ok=True)
    with owned():
        if args.files:
            asked = spark.createDataFrame([(os.path.abspath(f),) for f in args.files], "path string")
            probed = I.probe(asked).collect()
            for r in probed:
                if r.error:
                    print(f"{r.path}: {r.error}", file=sys.stderr)
            good = {r.path: r.size for r in probed if not r.error}
            small, large = ([p for p, n in good.items() if (n < ROW) is fits] for fits in (True, False))
            sources = spark.createDataFrame(list(good.items()), "image_id string, bytes_read long")
            found = []
            if small:
                # as many images at a time as there are partitions
                images = I.from_files(spark, small).withColumn("image_id", F.regexp_replace("image_id", "^file:/*", "/")).coalesce(max(1, args.concurrent_files))
                found.append(carve(images, config))
            if large:
                found.append(carve(None, config, I.chunks_of_files(spark, large, config.chunk_size)))
            files = reduce(DataFrame.unionAll, found) if found else None
        else:
            data = sys.stdin.buffer.read()
            images = spark.createDataFrame([("stdin", bytearray(data))], I.IMAGE)
            sources = spark.createDataFrame([("stdin", len(data))], "image_id string, bytes_read long")
            files = carve(images, config)
        if files is None:
            return 0
        files = settle(files, "files")
        if not args.report_only:
            store.write_files(report.payloads(None if args.files else images, files), out)
        if not args.disable_audit:
            report.write_audit(sources, files, os.path.join(out, "audit_log.txt"))
        if not args.disable_report:
            tell(JsonReporter(os.path.join(out, "carve_report.json")), sources, files)
    return 0


def run_recover(spark: SparkSession, args: argparse.Namespace) -> int:
    path = os.path.abspath(args.image)
    files = report.read_report(spark, args.report).withColumn("image_id", F.lit(path))
    with owned():
        won = settle(R.recover(None, files, R.RecoveryConfig(args.block_size, args.search_window, args.candidates, args.min_entropy)), "recovered")
        os.makedirs(args.output, exist_ok=True)
        store.write_files(R.spliced(None, won).withColumnRenamed("recovered_filename", "filename"), os.path.abspath(args.output))
        rows = [{k: v for k, v in r.asDict().items() if k not in ("fragment_len", "image_id") and v is not None} for r in won.toLocalIterator()]
    with open(os.path.join(args.output, "recover_report.json"), "w") as f:
        json.dump({"incomplete_jpegs": R.incomplete(files).count(), "recovered": len(rows), "recovered_files": rows}, f, indent=2)
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    spark = SparkSession.builder.appName("bytelode").getOrCreate()
    if argv[:1] == ["recover"]:
        return run_recover(spark, recover_parser().parse_args(argv[1:]))
    return run_carve(spark, parser().parse_args(argv))


if __name__ == "__main__":
    sys.exit(main())
