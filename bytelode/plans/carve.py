"""The carve query: images to chunks to hits to sized, checked, selected and numbered files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelode.functions import bytesx, extents
from bytelode.operators import scan, select, stitch
from bytelode.operators.specs import Spec, builtin_specs, specs_frame
from bytelode.sources import images as I
from bytelode.sources.scratch import settle

MODES = ("file", "buffer")


@dataclass(frozen=True)
class CarveConfig:
    specs: list[Spec] = field(default_factory=builtin_specs)
    mode: str = "file"  # buffer: nothing beyond the chunk is read again
    chunk_size: int = I.CHUNK
    block_size: int = 512
    quick: bool = False
    disable_validation: bool = False
    write_all: bool = False
    prefix_filenames: bool = False

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")


_FACTS = ["file_type", "suffix", "max_len", "header_len", "footer_len", "n_markers", "rem", "footer_at", "marker_end", "head", "probe_at", "probe", "walked", "sound"]


#: Rules of so many types are short enough to be compiled as plain columns.
FEW = 2


def _by_hit(facts: dict[str, Column], kinds: set[str], rule: Callable[[dict[str, Column]], Column]) -> Column:
    """A rule over a hit's facts, as a lambda where it is for many types: of these only the hit's own is walked through.

    As plain columns they are one generated method, longer than the JVM compiles: each row then runs through it as bytecode.
    """
    if len(kinds) <= FEW:
        return rule(facts)
    return F.transform(F.array(F.struct(*(c.alias(k) for k, c in facts.items()))), lambda x: rule({k: x.getField(k) for k in facts}))[0]


def _measured(rows: DataFrame, config: CarveConfig, late: bool) -> DataFrame:
    """rows with ok, size (0: no file) and comment by a hit's facts, or by its late ones under names that begin with late_."""
    kinds = {s.file_type.lower() for s in config.specs if not late or scan.may_wait(s)}
    h = {k: F.col(k) for k in _FACTS}
    if late:
        h |= {k: F.col(f"late.{k}") for k in ("rem", "footer_at", "marker_end", "head", "sound")}
        h |= {k: F.lit(None).cast(kind) for k, kind in (("probe_at", "long"), ("probe", "binary"), ("walked", "long"))}
    name = "late_" if late else ""
    asked = F.col("bridge") if late else F.lit(True)
    if "bmp" in kinds:
        rows = rows.withColumn("numbers", F.when(asked & (F.col("file_type") == "bmp"), _by_hit(h, kinds, lambda x: extents.bmp_numbers(x["head"]))))
        h["numbers"] = F.col("numbers")
    rows = rows.withColumn("raw", F.when(asked, _by_hit(h, kinds, lambda x: extents.size(x, kinds))))
    raw = F.col("raw")
    ok = (raw > 0) & (raw <= h["rem"])
    sound = lambda: F.when(asked & ok, _by_hit(h | {"raw": raw}, kinds, lambda x: extents.valid(x, x["raw"], kinds)))
    ok = F.coalesce(ok if config.disable_validation else ok & sound(), F.lit(False))
    dump = F.least("max_len", h["rem"]) if config.write_all else F.lit(0).cast("long")
    rows = rows.withColumn(f"{name}ok", ok)
    return rows.withColumn(f"{name}size", F.when(F.col(f"{name}ok"), raw).otherwise(dump)).withColumn(f"{name}comment", F.when(F.col(f"{name}ok"), "").otherwise("(Header dump)")).drop("raw", "numbers")


def sized(hits: DataFrame, config: CarveConfig) -> DataFrame:
    """Hits with size, advance and comment, and whether they wait for what lies beyond their chunk (bridge)."""
    specs = specs_frame(hits.sparkSession, config.specs).select("spec_idx", "file_type", "suffix", "max_len", "header_len", "footer_len", F.size("markers").alias("n_markers"))
    rows = _measured(hits.join(F.broadcast(specs), "spec_idx", "left"), config, False)
    waits = ~F.col("file_type").isin(*scan.WITHIN) & (F.col("rem") < F.col("max_len")) & (F.col("footer_len") > 0) & F.col("footer_at").isNull()
    rows = rows.withColumn("bridge", F.coalesce(waits, F.lit(False)) & F.lit(config.mode == "file")).withColumn("scan", F.when(F.col("ok"), F.col("scan")))
    on = select.advance(F.col("file_type"), F.col("size"), F.col("header_len"))
    # only what waits, or tells of a chunk's ends, still needs bytes
    needed = F.col("bridge") | (F.col("pass_no") == scan.ENDS)
    rows = rows.withColumn("advance", F.when(F.col("bridge"), F.col("header_len").cast("long")).otherwise(on))
    return rows.withColumns({c: F.when(needed, F.col(c)) for c in ("head", "probe", "probe_at", "marker_end")}).drop("ok", "walked", "sound", "rem")


def carve(images: DataFrame | None, config: CarveConfig | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """One row for each carved file: image_id, seq, filename, filesize, file_type, byte_runs, jpeg_scan, img_offset, suffix, comment.

    images has image_id and content. For images too large for a row chunks are given instead (image_id, chunk_no, chunk_offset
    and bytes, end to end). In file mode a hit whose footer isn't in its chunk is measured beyond it and comes after the
    chunk's other files: on the image itself while that is at hand for the scan, or else by what later chunks tell of
    their ends. Null contents are images without bytes.
    """
    config = config or CarveConfig()
    if config.mode == "file" and chunks is None:
        kept = _selected(scan.image_hits(images, config.specs, config.chunk_size, _block(config)), config).where("not _ends")
        return _numbered(_late(kept, config), config, True)
    if config.mode == "file":
        return finished(settle(scanned(chunks, config), "hits"), config)
    kept = _selected(scan.hits(I.chunks(images, config.chunk_size) if chunks is None else chunks, config.specs, _block(config)), config)
    return _numbered(kept, config, chunks is None)


def _block(config: CarveConfig) -> int:
    return config.block_size if config.quick else 0


def _selected(found: DataFrame, config: CarveConfig) -> DataFrame:
    """Hits sized and selected, and rows that tell of chunks' ends (_ends)."""
    rows = sized(found, config).withColumn("_ends", F.col("pass_no") == scan.ENDS)
    return select.in_order(rows, ["image_id", "chunk_no", "spec_idx", "_ends"], "pos", "advance", "_ends").drop("advance")


def scanned(chunks: DataFrame, config: CarveConfig) -> DataFrame:
    """The light rows that file mode needs of chunks: their hits that are kept, and what they tell of their ends. `finished` makes files of them."""
    stitch.check(config.specs)
    return _selected(scan.hits(chunks, config.specs, _block(config), True), config)


def finished(kept: DataFrame, config: CarveConfig) -> DataFrame:
    """The files of images from the rows of `scanned` for all of their chunks."""
    waiting = stitch.stitched(kept.where("bridge and not _ends"), kept.where("_ends"), config.specs)
    return _numbered(_late(kept.where("not bridge and not _ends").unionByName(waiting), config), config)


def _late(kept: DataFrame, config: CarveConfig) -> DataFrame:
    """Hits that waited get the size that their late facts say."""
    late = F.col("bridge")
    kept = _measured(kept, config, True)
    kept = kept.withColumn("size", F.when(late, F.col("late_size")).otherwise(F.col("size"))).withColumn("comment", F.when(late, F.col("late_comment")).otherwise(F.col("comment")))
    return kept.withColumn("scan", F.when(~late, F.col("scan"))).drop("late_ok", "late_size", "late_comment")


def _numbered(kept: DataFrame, config: CarveConfig, whole: bool = False) -> DataFrame:
    """Rows of files, in the order of their numbers' keys: within a chunk those that waited come last. whole: each image was in one row."""
    kept = kept.withColumn("late", F.col("bridge").cast("int")).drop("_ends", "head", "probe", "probe_at", "marker_end", "footer_at")
    order = [F.col(c) for c in ("late", "pass_no", "k1", "k2")]
    kept = kept.where("size > 0")
    files = select.number_whole(kept, "image_id", [F.col("chunk_no"), *order]) if whole else select.number(kept, "image_id", "chunk_no", order)
    offset = (F.col("chunk_offset") + F.col("pos")).cast("long")
    run = F.struct(F.lit(0).cast("long").alias("offset"), offset.alias("img_offset"), F.col("size").alias("len"))
    info = F.struct(F.col("scan.width").alias("width"), F.col("scan.height").alias("height"), (offset + F.col("scan.broken")).alias("fragmentation_point_img_offset"), F.col("scan.restarts").alias("has_restart_markers"), F.col("scan.status").alias("status"))
    name = bytesx.output_filename(F.col("seq"), offset, F.col("suffix"), F.col("image_id") if config.prefix_filenames else None)
    return files.select("image_id", "seq", name.alias("filename"), F.col("size").alias("filesize"), "file_type", F.array(run).alias("byte_runs"), F.when(F.col("scan").isNotNull(), info).alias("jpeg_scan"), offset.alias("img_offset"), "suffix", "comment")
