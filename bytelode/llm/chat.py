"""Chat formatting: logged snapshots of growing conversations collapse to the maximal ones, which are then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Turns that one window orders; longer conversations are scanned in two levels.
STRETCH = 256
TEMPLATE = ("<|", "|>\n", "<|end|>\n")


def _turn_hash(seed: int) -> Column:
    """64 bits of a turn's role and text; null differs from empty, and the place of the cut between them counts."""
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), F.col("role"), F.length("role"), F.col("text").isNull(), F.col("text"))


def ordered(turns: DataFrame) -> DataFrame:
    """Number the turns of each conversation from 1 without a window over whole conversations.

    Turns stand in the order of turn, then role and text, nulls first; repeated rows are kept as turns of their own.
    Stretches are runs of turn numbers; a conversation whose rows all share a few turn numbers still orders right, only
    in fewer stretches.
    """
    rows = turns.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62))))
    totals = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    totals = totals.select("conv_id", "stretch", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text"))
    return rows.withColumn("k", within).join(totals, ["conv_id", "stretch"]).withColumn("k", F.col("k") + F.col("before")).drop("before")


def prefixes(turns: DataFrame) -> DataFrame:
    """For each turn the rolling hash of the conversation up to it: two running sums of turn hashes tied to their places."""
    tied = [F.xxhash64(F.lit(seed), _turn_hash(seed), F.col("k")) for seed in (1, 2)]
    # sums of longs may overflow under ANSI rules; 40-bit halves can't
    rows = ordered(turns).withColumns({f"t{i}{j}": F.shiftrightunsigned(t, 32) if j else t.bitwiseAND(F.lit(0xFFFFFFFF)) for i, t in enumerate(tied) for j in (0, 1)})
    names = [f"t{i}{j}" for i in (0, 1) for j in (0, 1)]
    sums = rows.groupBy("conv_id", "stretch").agg(*(F.sum(n).alias(n) for n in names))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("conv_id", "stretch", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"b{n}") for n in names))
    running = Window.partitionBy("conv_id", "stretch").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("conv_id", "stretch", "k", "role", "text", *(F.sum(n).over(running).alias(n) for n in names))
    return rows.join(base, ["conv_id", "stretch"]).select("conv_id", "k", "role", "text", F.xxhash64(*(F.col(n) + F.col(f"b{n}") for n in names[:2])).alias("h1"), F.xxhash64(*(F.col(n) + F.col(f"b{n}") for n in names[2:])).alias("h2"))


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that are no prefix of another; of equal ones, that of least conv_id.

    Proper prefixes are made distinct before they are shuffled to the anti-join, so that a first turn that millions of
    conversations share is one row.
    """
    last = rows.groupBy("conv_id").agg(F.max(F.struct("k", "h1", "h2")).alias("z")).select("conv_id", F.col("z.k").alias("k"), F.col("z.h1").alias("h1"), F.col("z.h2").alias("h2"))
    whole = last.groupBy("k", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    ends = last.select("conv_id", F.col("k").alias("end"))
    inner = rows.select("conv_id", "k", "h1", "h2").join(ends, "conv_id").where("k < end").select("k", "h1", "h2").distinct()
    return whole.join(inner, ["k", "h1", "h2"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"), "n_copies")


def render(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """One text for each conversation of keep: every turn in a role header and an end mark; null roles and texts are empty.

    Turns are joined within stretches first, so that one task never gathers the single turns of a long conversation.
    """
    head, middle, end = TEMPLATE
    one = F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(end))
    join = lambda key: F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(key, "t"))), lambda x: x["t"]))
    part = rows.join(keep.select("conv_id"), "conv_id").select("conv_id", "k", F.floor(F.col("k") / STRETCH).alias("s"), one.alias("t")).groupBy("conv_id", "s").agg(join("k").alias("t"))
    return part.groupBy("conv_id").agg(join("s").alias("rendered"))


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (conversations equal to it, itself included) and rendered for each maximal conversation.

    Rows without conv_id belong to no conversation and go. An empty table gives an empty one; extra columns are ignored.
    """
    rows = stash(prefixes(turns), "prefixes")
    keep = stash(maximal(rows), "maximal")
    return keep.join(render(rows, keep), "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")


def collapse_sql(table: str = "conversations") -> str:
    """The same in DuckDB SQL, with whole lists of turns in place of hashes."""
    return f"""
with c as (
  select conv_id, list(struct_pack(r := role, t := text) order by turn nulls first, role nulls first, text nulls first) as turns
  from {table} where conv_id is not null group by conv_id),
p as (select distinct list_slice(turns, 1, k) as prefix from (select turns, unnest(range(1, len(turns))) as k from c)),
u as (select min(conv_id) as conv_id, turns, count(*) as n_copies from c group by turns)
select conv_id, len(turns)::bigint as n_turns, n_copies,
  list_aggregate(list_transform(turns, lambda x: '<|' || coalesce(x.r, '') || '|>' || chr(10) || coalesce(x.t, '') || '<|end|>' || chr(10)), 'string_agg', '') as rendered
from u where not exists (select 1 from p where p.prefix is not distinct from u.turns)"""
