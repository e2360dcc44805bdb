"""Files that end beyond their chunk, measured without their image: from what each chunk says of its ends.

Every chunk leaves a few light rows: its first and last bytes, and for each signature where its first footer and its first
marker are. Neighbours' bytes show what lies across a boundary. For a hit that waits, the next footer is then the least
place among those after it: a scan over the rows of an image's chunks, from the last one back. No chunk is read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from bytelode.functions import walkers as W

from . import scan
from .specs import Spec

_ACROSS = "image_id string, chunk_no int, spec_idx int, footers array<long>, marks array<struct<start: long, end: long>>"


def check(specs: list[Spec]) -> None:
    """Specs whose check follows the bytes of the whole file can't be measured so."""
    for s in specs:
        if scan.may_wait(s) and s.file_type.lower() == "mov":
            raise ValueError(f"spec {s.suffix!r}: a mov with a footer is checked on its bytes, so file mode needs its image")


def _straddling(data: bytes, value: bytes, case_sensitive: bool, cut: int) -> Iterator[int]:
    """Places of a pattern that lie on both sides of the cut."""
    at = scan.find(data, value, max(0, cut - len(value) + 1), case_sensitive)
    while at is not None and at < cut:
        if at + len(value) > cut:
            yield at
        at = scan.find(data, value, at + 1, case_sensitive)


def _across(specs: list[Spec], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                tail, head = row["tail"][-size:], row["next_head"][:size]
                if len(row["next_head"]) < size and not row["next_is_last"]:
                    raise ValueError(f"chunks of fewer than {size} bytes need their images")
                data, base = tail + head, row["stop"] - len(tail)
                for idx, spec in enumerate(specs):
                    if scan.may_wait(spec):
                        footers = [base + k for k in _straddling(data, spec.footer, spec.case_sensitive, len(tail))]
                        marks = [{"start": base + k, "end": base + k + len(m)} for m in spec.markers for k in _straddling(data, m, True, len(tail))]
                        if footers or marks:
                            out.append((row["image_id"], row["chunk_no"], idx, footers, marks))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split(" ", 1)[0] for x in ("image_id", "chunk_no", "spec_idx", "footers", "marks")])

    return run


@F.udf(LongType(), useArrow=True)
def _body(fields: bytes, more: bytes, cut: bool) -> int | None:
    """`scan.gzip_body` of fields and what follows them, where the chunk has only the former."""
    if fields is None:
        return None
    whole = (fields + (more or b""))[: W.GZIP_HEAD]
    found = scan.gzip_body(whole, cut and len(whole) < W.GZIP_HEAD)
    if found is None:
        raise ValueError("a gzip header goes on beyond the next chunk: chunks so small need their images")
    return found


def stitched(waiting: DataFrame, ends: DataFrame, specs: list[Spec]) -> DataFrame:
    """waiting with late (see scan.LATE), from the rows of scan.chunk_ends of all chunks.

    waiting has image_id, chunk_no, chunk_offset, spec_idx, pos, max_len, footer_len, marker_end, head, probe_at and probe.
    Rows of an image's chunks are ordered by chunk_no and lie end to end.
    """
    size = scan.lead(specs)
    on = Window.partitionBy("image_id").orderBy("chunk_no")
    chunks = ends.where("spec_idx = -1").select("image_id", "chunk_no", (F.col("chunk_offset") + F.col("pos")).alias("stop"), F.col("probe").alias("tail"), F.lead("head").over(on).alias("next_head"), F.lead("head", 2).over(on).isNull().alias("next_is_last"))
    seams = chunks.where("next_head is not null").mapInArrow(_across(specs, size), _ACROSS)
    places = ends.where("spec_idx >= 0").select("image_id", "chunk_no", "spec_idx", (F.col("chunk_offset") + F.col("footer_at")).alias("footer"), (F.col("chunk_offset") + F.col("marker_end")).alias("marker"))
    places = places.join(seams, ["image_id", "chunk_no", "spec_idx"], "left")
    # a window that grows from an image's last chunk back, so that it costs a row once
    after = Window.partitionBy("image_id", "spec_idx").orderBy(F.desc("chunk_no")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.least("footer", F.array_min("footers")), F.least("marker", F.array_min(F.transform("marks", lambda m: m["end"])))
    places = places.select("image_id", "chunk_no", "spec_idx", "footers", "marks", F.min(nearest[0]).over(after).alias("next_footer"), F.min(nearest[1]).over(after).alias("next_marker"))
    length = chunks.groupBy("image_id").agg(F.max("stop").alias("length"))
    rows = waiting.join(places, ["image_id", "chunk_no", "spec_idx"]).join(chunks.select("image_id", "chunk_no", "next_head", "next_is_last"), ["image_id", "chunk_no"]).join(length, "image_id")
    start = F.col("chunk_offset") + F.col("pos")
    rem = F.least(F.col("length") - start, F.col("max_len"))
    footer = F.coalesce(F.array_min(F.filter("footers", lambda f: f >= start)), F.col("next_footer")) - start
    marker = F.least(F.array_min(F.transform(F.filter("marks", lambda m: m["start"] >= start), lambda m: m["end"])), F.col("next_marker")) - start
    rows = rows.withColumn("_rem", rem).withColumn("_footer", footer).withColumn("_marker", F.coalesce("marker_end", marker))
    rows = rows.withColumn("_footer", F.when(F.col("_footer") + F.col("footer_len") <= F.col("_rem"), F.col("_footer"))).withColumn("_marker", F.when(F.col("_marker") <= F.col("_rem"), F.col("_marker")))
    head = F.substring(F.concat("head", F.coalesce("next_head", F.lit(b""))), F.lit(1), F.least(F.lit(scan.HEAD), F.col("_rem")).cast("int"))
    reach = F.coalesce(F.col("_footer") + F.col("footer_len"), F.col("_rem"))
    sound = F.lit(False)
    if any(scan.may_wait(s) and s.file_type.lower() == "gzip" for s in specs):
        cut = F.col("next_head").isNotNull() & ~F.col("next_is_last")
        body = F.coalesce("probe_at", _body(F.col("probe"), F.col("next_head"), cut))
        sound = (F.col("file_type") == "gzip") & (body >= 0) & (reach > body + 8)
    late = F.struct(F.col("_rem").alias("rem"), F.col("_footer").alias("footer_at"), F.col("_marker").alias("marker_end"), head.alias("head"), F.coalesce(sound, F.lit(False)).alias("sound"))
    return rows.withColumn("late", late).select(*(c for c in waiting.columns if c != "late"), "late")
