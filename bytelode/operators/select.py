"""Which hits become files, in which order, under which numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from bytelode.sources.scratch import keep, owned, settle

#: Rows of a segment that are gathered as one array; longer ones are resolved by joins.
LONGEST = 10_000


@F.pandas_udf(ArrayType(IntegerType()))
def _kept(pos: pd.Series, advance: pd.Series) -> pd.Series:
    def one(p: np.ndarray, a: np.ndarray) -> list[int]:
        out, k = [], 0
        while k < len(p):
            out.append(k)
            k = max(k + 1, int(np.searchsorted(p, p[k] + a[k], "left")))
        return out

    return pd.Series([one(p, a) for p, a in zip(pos, advance, strict=True)])


def greedy(df: DataFrame, keys: list[str], pos: str, advance: str) -> DataFrame:
    """Per key, in order of pos: keep a row unless an earlier kept one reaches past it. Equal positions: the row of least other columns first.

    A group is gathered as one array, so its rows should be few and light: here the hits of one spec in one chunk. greedy_any has no such bound.
    """
    rest = [c for c in df.columns if c not in keys and c not in (pos, advance)]
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, advance, *rest))).alias("rows"))
    kept = rows.withColumn("kept", _kept(F.col(f"rows.{pos}"), F.col(f"rows.{advance}")))
    one = kept.select(*keys, F.explode(F.transform("kept", lambda k: F.get("rows", k))).alias("r"))
    return one.select(*keys, *(F.col(f"r.{c}").alias(c) for c in (pos, advance, *rest)))


def in_order(df: DataFrame, keys: list[str], pos: str, advance: str, always: str | None = None) -> DataFrame:
    """As greedy, for rows of a key that stand side by side in ascending order, as a scan leaves them: nothing is gathered or shuffled.

    Rows for which `always` holds are kept, and stand outside of the selection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, reach = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            coded = [np.asarray(pc.dictionary_encode(batch.column(k), null_encoding="encode").indices) for k in keys]
            new = np.ones(n, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in coded], axis=0)
            at, on = (np.asarray(batch.column(c).fill_null(0)) for c in (pos, advance))
            kept = np.asarray(batch.column(always).fill_null(False)) if always else np.zeros(n, bool)
            kept = kept.copy()
            cuts = np.flatnonzero(new).tolist()
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            if first != before:
                reach = None
            before = tuple(batch.column(k)[n - 1].as_py() for k in keys)
            for lo, hi in zip(cuts, [*cuts[1:], n], strict=True):
                if lo:
                    reach = None
                if kept[lo]:  # rows to keep always share no key with others
                    continue
                if hi - lo == 1:
                    if reach is None or at[lo] >= reach:
                        kept[lo], reach = True, int(at[lo] + on[lo])
                    continue
                k = lo if reach is None else lo + int(np.searchsorted(at[lo:hi], reach, "left"))
                while k < hi:
                    kept[k] = True
                    reach = int(at[k] + on[k])
                    k = max(k + 1, lo + int(np.searchsorted(at[lo:hi], reach, "left")))
            yield batch.filter(pa.array(kept))

    return df.mapInArrow(run, df.schema)


def _sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _idx, which ascends with order, and _part, the range of the sort a row is in; no range is a whole key's by need."""
    return settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_idx", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_idx", 33)))


def _running(df: DataFrame, keys: list[str], value: Column, name: str, last: int = 0, down: bool = False) -> DataFrame:
    """df with the greatest value of a key's rows up to here (last = -1: before here), or from the end down to here the least: within ranges, then over them."""
    best, turn = (F.min, F.desc) if down else (F.max, F.asc)
    df = df.withColumn("_value", value)
    over = Window.partitionBy(*keys).orderBy(turn("_part")).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*keys, "_part").agg(best("_value").alias("_value")).withColumn("_base", best("_value").over(over)).where("_base is not null")
    base = base.select(*(F.col(c).alias(f"_of_{n}") for n, c in enumerate(keys)), F.col("_part").alias("_of_part"), "_base")
    here = Window.partitionBy(*keys, "_part").orderBy(turn("_idx")).rowsBetween(Window.unboundedPreceding, last)
    same = F.col("_part") == F.col("_of_part")
    for n, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{n}"))
    both = (F.least if down else F.greatest)(F.col("_local"), F.col("_base"))
    out = df.withColumn("_local", best("_value").over(here)).join(base, same, "left").withColumn(name, both)
    return out.select(*(c for c in df.columns if c != "_value"), name)


def _chains(rows: DataFrame) -> DataFrame:
    """_idx of the kept rows of long segments (_seg, _idx, _at, _end): pointers to the next row to keep, doubled until they leave."""
    whole = F.col("_end") > F.col("_at")
    probes = rows.select("_seg", F.when(whole, F.col("_end")).otherwise(F.col("_at")).alias("_at"), F.when(whole, 0).otherwise(1).alias("_tag"), F.col("_idx").alias("_row"), F.lit(1).alias("_sub"))
    both = rows.select("_seg", "_at", F.lit(1).alias("_tag"), F.col("_idx").alias("_row"), F.lit(0).alias("_sub")).unionAll(probes)
    after = _running(_sorted(both, ["_seg", "_at", "_tag", "_row", "_sub"]), ["_seg"], F.expr("if(_sub = 0, _row, null)"), "_next", -1, True)
    jumps = [settle(after.where("_sub = 1 and _next is not null").select("_row", "_next"))]
    while not jumps[-1].isEmpty():
        then = jumps[-1].select(F.col("_row").alias("_next"), F.col("_next").alias("_then"))
        jumps.append(settle(jumps[-1].join(then, "_next").select("_row", F.col("_then").alias("_next"))))
    kept = rows.where("_idx = _seg").select("_idx")
    for jump in reversed(jumps[:-1]):
        kept = settle(kept.unionAll(kept.join(jump, F.col("_idx") == F.col("_row")).select(F.col("_next").alias("_idx"))))
    return kept


def greedy_any(df: DataFrame, keys: list[str], pos: str, advance: str, longest: int = LONGEST) -> DataFrame:
    """As greedy, for keys of any number of rows.

    A row that starts at or after every earlier end is kept whatever came before, so each key falls into independent
    segments. Those of up to `longest` rows are gathered, others resolved by joins; only positions and row numbers take part.
    The result is a table in the shared folder, which the caller may discard; those made on the way are gone.
    """
    with owned():
        return keep(settle(_greedy_any(df, keys, pos, advance, longest), "kept"))


def _greedy_any(df: DataFrame, keys: list[str], pos: str, advance: str, longest: int) -> DataFrame:
    names = df.columns
    rest = [c for c in names if c not in keys and c not in (pos, advance)]
    rows = _sorted(df, [*keys, pos, advance, *rest]).withColumn("_end", F.col(pos) + F.greatest(F.col(advance), F.lit(0)))
    rows = _running(rows, keys, F.col("_end"), "_before", -1)
    rows = settle(rows.withColumn("_start", F.coalesce(F.col(pos) >= F.col("_before"), F.lit(True))))
    rows = settle(_running(rows, keys, F.expr("if(_start, _idx, null)"), "_seg"))
    sizes = settle(rows.groupBy("_seg").count().where(F.col("count") > longest).select("_seg"))
    if sizes.isEmpty():
        return greedy(rows.select(*names, "_seg"), [*keys, "_seg"], pos, advance).select(*names)
    short = greedy(rows.join(sizes, "_seg", "left_anti").select(*names, "_seg"), [*keys, "_seg"], pos, advance).select(*names)
    long = rows.join(sizes, "_seg", "left_semi")
    kept = _chains(settle(long.select("_seg", "_idx", F.col(pos).alias("_at"), "_end")))
    return short.unionAll(long.join(kept, "_idx", "left_semi").select(*names))


def advance(file_type: Column, size: Column, header_len: Column) -> Column:
    """How far the search moves on: JPEGs only by their header, since they may hold thumbnails."""
    return F.when(file_type.isin("jpeg", "vjpeg") | (size <= 0), header_len.cast("long")).otherwise(size)


def number(df: DataFrame, image: str, part: str, order: list[Column], name: str = "seq") -> DataFrame:
    """Number rows from 1 within an image, by part and then order, with no window wider than a part.

    For images whose parts come from different tasks; `number_whole` takes one shuffle where a task has all of an image.
    """
    counts = df.groupBy(image, part).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(image).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(image, part, before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(image, part).orderBy(*order))
    return df.withColumn("_inside", inside).join(base, [image, part]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("int")).drop("_before", "_inside")


def number_whole(df: DataFrame, image: str, order: list[Column], name: str = "seq") -> DataFrame:
    """As `number`, for images that are rows: what one task has scanned is no more than one can order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(image).orderBy(*order)))
