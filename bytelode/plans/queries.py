"""Registered queries over the given tables, and the same in DuckDB SQL.

The tables hold no disk images. Pages are carved as they are; for binary formats, rows of orders and lineitem are turned
into small files, many of them deliberately unsound, by arithmetic that both engines share.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from bytelode.functions import bytesx as B
from bytelode.functions import extents as X
from bytelode.functions import walkers as W
from bytelode.functions.huffman import context, count_all
from bytelode.operators import recover as R
from bytelode.operators import intervals, report, scan, select, stats
from bytelode.operators.reporter import JsonReporter, tell
from bytelode.operators.specs import Spec, builtin_specs, filter_types, load_specs, parse_types, save_specs, select_types, specs_frame, union_specs
from bytelode.plans.carve import CarveConfig, carve
from bytelode.sources import images as I
from bytelode.sources import store
from bytelode.sources.scratch import settle, shared_path
from bytelode.streaming.landing import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.from_table(_table(spark, sf_dir, "pages"), "page_id", "html")


# ---- carving of pages ----

_FOLD = f"translate(html, '{B.UPPER}', '{B.LOWER}')"


def _carve_sql(header: str, footer: str | None, longest: int, fold: bool = True, file_mode: bool = False) -> str:
    """Hits of one text spec in pages, chained: every step finds the next header where the last file, or only its header, ends."""
    text = _FOLD if fold else "html"
    end = f"instr(substr(f, p), '{footer}')" if footer else "0"
    size = f"case when e > 0 then strlen(substr(html, p, e - 1 + {len(footer or '')})) else least({longest}, strlen(substr(html, p))) end"
    late = "e = 0" if file_mode else "false"
    on = f"case when {late} then p + {len(header)} when e > 0 then p + e - 1 + {len(footer or '')} else p + length(left_bytes) end"
    on = on.replace("length(left_bytes)", "length(html)" if longest >= 1 << 20 else f"{longest}")
    hit = f"select page_id, html, f, s, s - 1 + instr(substr(f, s), '{header}') as p from {{}} where instr(substr(f, s), '{header}') > 0"
    full = f"select page_id, html, f, p, e, {size} as size, {on} as nxt from (select *, {end} as e from ({{}}))"
    return f"""with recursive base as (select page_id, html, {text} as f, 1 as s from pages where html is not null),
c as ({full.format(hit.format('base'))} union all {full.format(hit.format('(select page_id, html, f, nxt as s from c)'))}),
r as (select page_id, size as filesize, strlen(left(html, p - 1)) as img_offset, {late} as late from c)"""


_PICK = " select page_id, row_number() over (partition by page_id order by late, img_offset)::int as seq, filesize::bigint as filesize, img_offset::bigint as img_offset from r"
_HTM = _carve_sql("<html", "</html>", 1 << 20)


def _htm(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return carve(_pages(spark, sf_dir), CarveConfig(select_types(builtin_specs(), ["htm"]), mode))


def _picked(files: DataFrame, *more: str) -> DataFrame:
    return files.select(F.col("image_id").cast("long").alias("page_id"), "seq", "filesize", "img_offset", *more)


@query(_HTM + _PICK)
def carve_htm_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(_htm(spark, sf_dir, "buffer"))


@query(_carve_sql("<html", "</html>", 1 << 20, file_mode=True) + _PICK)
def carve_htm_filemode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(_htm(spark, sf_dir, "file"))


@query(_carve_sql("<p>", "</p>", 1 << 20, fold=False) + _PICK)
def carve_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(carve(_pages(spark, sf_dir), CarveConfig([Spec("Config", "par", b"<p>", b"</p>", 1 << 20)], "buffer")))


@query(_carve_sql("<html", None, 1000, fold=False).replace("strlen(substr(html, p))", "strlen(substr(html, p))") + _PICK)
def header_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that fail their check, kept as header dumps."""
    return _picked(carve(_pages(spark, sf_dir), CarveConfig([Spec("Png", "png", b"<html", None, 1000)], "buffer", write_all=True)))


@query(_HTM + """, n as (select page_id, row_number() over (partition by page_id order by late, img_offset) as seq, filesize, img_offset from r)
select page_id, seq || '-' || img_offset || '.htm' as filename, page_id || '-' || seq || '-' || img_offset || '.htm' as prefixed from n""")
def output_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _htm(spark, sf_dir, "buffer")
    prefixed = B.output_filename(F.col("seq"), F.col("img_offset"), F.col("suffix"), F.col("image_id"))
    return files.select(F.col("image_id").cast("long").alias("page_id"), "filename", prefixed.alias("prefixed"))


@query(_HTM + " select 'htm' as file_type, count(*) as found from r group by 1")
def found_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.found_counts(_htm(spark, sf_dir, "buffer"))


@query(_HTM + """ select p.page_id, strlen(p.html)::bigint as bytes_read, count(r.page_id)::bigint as n_files, coalesce(sum(r.filesize), 0)::bigint as bytes_carved
from pages p left join r on p.page_id = r.page_id group by p.page_id, p.html""")
def carve_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _pages(spark, sf_dir)
    return report.summary(images, _htm(spark, sf_dir, "buffer")).select(F.col("image_id").cast("long").alias("page_id"), "bytes_read", "n_files", "bytes_carved")


@query(_HTM + """, n as (select page_id, row_number() over (partition by page_id order by late, img_offset) as num, filesize, img_offset from r)
select page_id, num::int as num, num || '.htm' as name, filesize::bigint as size, img_offset::bigint as file_offset, '' as comment from n""")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.audit(_htm(spark, sf_dir, "buffer")).select(F.col("image_id").cast("long").alias("page_id"), "num", "name", "size", "file_offset", "comment")


@query("select page_id, (contains(html, '<article') or contains(html, 'class=\"ad\"')) as has_marker from pages")
def marker_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(F.col("image_id").cast("long").alias("page_id"), B.contains_any(F.col("content"), [b"<article", b'class="ad"']).alias("has_marker"))


@query("select page_id, url like 'http_://%' and length(url) >= 9 as wild, lower(left(url, 5)) = 'https' as folded from pages")
def wildcard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("url", "UTF-8")
    return _table(spark, sf_dir, "pages").select("page_id", (B.matches(data, b"http?://") & (F.octet_length("url") >= 9)).alias("wild"), B.matches(data, b"HTTPS", 0, True).alias("folded"))


@query(r"""with u as (select page_id, regexp_extract(url, '([^/]*)/*$', 1) as last from pages),
s as (select page_id, case when regexp_matches(last, '^.+\.[^.]+$') then regexp_extract(last, '^(.+)\.[^.]*$', 1) || '_' || regexp_extract(last, '\.([^.]+)$', 1) else regexp_replace(last, '^(.+)\.$', '\1') end as w from u)
select page_id, left(trim(regexp_replace(translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+', '_', 'g'), '_'), 20) as cleaned from s""")
def clean_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", B.clean_filename(F.col("url"), 20).alias("cleaned"))


# ---- search in documents ----


@query("""select b.item_id, sum((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text))::bigint as n_hits
from benchmark b join documents d on contains(d.text, b.text) where length(b.text) > 0 group by b.item_id""")
def item_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item, whole, searched for in all documents at once."""
    return _item_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _item_hits(docs: DataFrame, items: DataFrame, chars: int = scan.PATTERN_CHARS) -> DataFrame:
    """item_id and n_hits of the items whose whole text stands in documents."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("pattern"))
    return items.join(scan.occurrences(docs, items, chars), "pattern").groupBy("item_id").agg(F.sum("n_hits").alias("n_hits"))


@query("""with h as (select doc_id, hex(encode(text)) as h from documents where text is not null)
select doc_id, count(*) filter (where substr(h, 128 * k::int + 1, 4) in ('7468', '5468', '7448', '5448'))::int as n_blocks from (select doc_id, h, unnest(range(0, greatest((length(h) // 2 - 2) // 64 + 1, 1))) as k from h) group by doc_id""")
def quick_scan_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.from_table(_table(spark, sf_dir, "documents"), "doc_id", "text").where("content is not null")
    return docs.select(F.col("image_id").cast("long").alias("doc_id"), F.size(scan.block_hits(F.col("content"), b"th", 64, False)).alias("n_blocks"))


_BYTES = "(select doc_id, k, substr(h, 2 * k::int + 1, 2) as b from (select doc_id, h, unnest(range(0, length(h) // 2)) as k from (select doc_id, hex(encode(text)) as h from documents)))"


@query(f"""with c as (select doc_id, b, count(*) as n from {_BYTES} group by all), t as (select doc_id, sum(n) as t from c group by doc_id)
select d.doc_id, coalesce(round(e.e, 6), 0) + 0.0 as entropy from documents d left join (select c.doc_id, sum(-(n / t) * log2(n / t)) as e from c join t on c.doc_id = t.doc_id group by c.doc_id) e on d.doc_id = e.doc_id""")
def byte_entropy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.from_table(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return stats.entropies(docs).select(F.col("image_id").cast("long").alias("doc_id"), (F.round("entropy", 6) + 0.0).alias("entropy"))


@query(f"""with c as (select doc_id, k // 512 as block, b, count(*) as n from {_BYTES} group by all), t as (select doc_id, block, sum(n) as t from c group by all),
e as (select c.doc_id, c.block * 512 as "offset", sum(-(n / t) * log2(n / t)) as e from c join t on c.doc_id = t.doc_id and c.block = t.block group by all)
select doc_id, "offset"::bigint as "offset", round(e, 6) + 0.0 as entropy, r::int as rank from (select *, row_number() over (partition by doc_id order by round(e, 9) desc, "offset") as r from e) where r <= 3""")
def block_entropy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.from_table(_table(spark, sf_dir, "documents"), "doc_id", "text")
    top = stats.top_blocks(stats.entropies(docs, 512), 3)
    return top.select(F.col("image_id").cast("long").alias("doc_id"), "offset", (F.round("entropy", 6) + 0.0).alias("entropy"), "rank")


@query("""with recursive e as (select user_id, event_id, floor(epoch_us(ts) / 1000000)::bigint as pos, floor(value)::bigint as len from events where user_id is not null and ts is not null and value is not null),
n as (select *, row_number() over (partition by user_id order by pos, len, event_id) as rn from e),
x as (select a.user_id, a.rn, min(b.rn) as nxt from n a join n b on a.user_id = b.user_id and b.rn > a.rn and b.pos >= a.pos + a.len group by all),
k as (select user_id, 1::bigint as rn from n where rn = 1 union all select x.user_id, x.nxt from k join x on k.user_id = x.user_id and k.rn = x.rn)
select n.user_id, n.event_id, n.pos from n join k on n.user_id = k.user_id and n.rn = k.rn""")
def greedy_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals: of each user, those that start where the last kept one has ended."""
    e = _table(spark, sf_dir, "events").where("user_id is not null and ts is not null and value is not null")
    e = e.select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("pos"), F.floor("value").cast("long").alias("len"))
    return select.greedy_any(e, ["user_id"], "pos", "len").select("user_id", "event_id", "pos")


# ---- synthesised binary files: (bytes, endianness, arithmetic) or constant hex ----

Field = tuple[int, str, str] | str


def _hex_spark(fields: list[Field]) -> Column:
    out = []
    for f in fields:
        if isinstance(f, str):
            out.append(F.lit(f))
        else:
            h = F.lpad(F.hex(F.expr(f"cast({f[2]} as bigint)")), 2 * f[0], "0")
            out += [h.substr(2 * k + 1, 2) for k in (reversed(range(f[0])) if f[1] == "le" else range(f[0]))]
    return F.unhex(F.concat(*out))


def _hex_duck(fields: list[Field]) -> str:
    out = []
    for f in fields:
        if isinstance(f, str):
            out.append(f"'{f}'")
        else:
            h = f"printf('%0{2 * f[0]}X', ({f[2]})::bigint)"
            out += [f"substr({h}, {2 * k + 1}, 2)" for k in (reversed(range(f[0])) if f[1] == "le" else range(f[0]))]
    return " || ".join(out)


def _int(at: int, n: int, little: bool = True) -> str:
    """DuckDB: the unsigned integer of n bytes of the hex text h."""
    return "('0x' || " + " || ".join(f"substr(h, {2 * (at + k) + 1}, 2)" for k in (reversed(range(n)) if little else range(n))) + ")::bigint"


K = "o_orderkey"
_BMP: list[Field] = [
    "424D", (4, "le", f"50 + {K} % 12"), (4, "le", f"case when {K} % 13 = 0 then 1 else 0 end"), (4, "le", f"case when {K} % 11 = 0 then 70 else 54 end"), (4, "le", f"case {K} % 6 when 0 then 12 when 1 then 124 else 40 end"),
    (4, "le", f"{K} % 70000"), (4, "le", f"case when {K} % 5 = 0 then 4294967296 - {K} % 300 - 1 else {K} % 900 end"), (2, "le", f"case when {K} % 17 = 0 then 2 else 1 end"), (2, "le", f"case {K} % 4 when 0 then 8 when 1 then 24 when 2 then 1 else 5 end"),
    (4, "le", f"case when {K} % 7 = 0 then 1 else 0 end"), (4, "le", "0"), (4, "le", f"2835 * ({K} % 500)"), (4, "le", "2835"), (4, "le", f"{K} % 3"), (4, "le", f"{K} % 4"), "0000",
]
_PNG: list[Field] = ["89504E470D0A1A0A", (4, "be", f"13 + case when {K} % 9 = 0 then 1 else 0 end"), "49484452", (4, "be", f"({K} * 37) % 120000"), (4, "be", f"{K} % 50"), "0802000000"]
_GIF: list[Field] = ["474946383", (1, "be", f"case {K} % 3 when 0 then 144 when 1 then 112 else 128 end"), "61", (2, "le", f"{K} % 5"), (2, "le", f"{K} % 7")]
_EXE: list[Field] = ["4D5A" + "00" * 58, (4, "le", f"64 + 400 * ({K} % 2)"), "5045", (1, "be", f"case when {K} % 5 = 0 then 1 else 0 end"), "00" * 77, (4, "le", f"{K} % 300"), "00" * 100]
_MPG: list[Field] = ["000001BA", (1, "be", f"case {K} % 3 when 0 then 33 when 1 then 68 else {K} % 256 end"), "00", (1, "be", f"{K} % 2"), "00", (1, "be", f"1 + {K} % 2"), "00000000", (1, "be", f"{K} % 4"), (1, "be", f"case when {K} % 6 = 0 then 254 else 255 end"), "FFFF"]
_GZ: list[Field] = ["1F8B08", (1, "be", f"case when {K} % 10 = 0 then 224 else {K} % 32 end"), (4, "le", f"{K} * 50000 % 4000000000"), (1, "be", f"{K} % 6"), (1, "be", f"case when {K} % 4 = 0 then 255 else {K} % 16 end")]
_ZIP: list[Field] = ["504B0304" + "00" * 26, "504B0506" + "00" * 16, (2, "le", f"{K} % 400"), "00" * 10]


def _orders(spark: SparkSession, sf_dir: str, fields: list[Field]) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(K, _hex_spark(fields).alias("b"))


def _of(fields: list[Field], what: str) -> str:
    return f"with x as (select {K}, {_hex_duck(fields)} as h from orders) select {K}, {what} from x"


def _check(name: str, fields: list[Field], column: Callable[[Column, Column], Column], sql: str, out: str = "valid") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _orders(spark, sf_dir, fields).select(K, column(F.col("b"), F.octet_length("b").cast("long")).alias(out))

    QUERIES[name], ORACLES[name] = run, _of(fields, f"{sql} as {out}")


_h = f"case when {_int(22, 4)} > 2147483648 then 4294967296 - {_int(22, 4)} else {_int(22, 4)} end"
_LEN = "(length(h) // 2)"
_check("validate_bmp", _BMP, X.bmp_valid, f"""left(h, 4) = '424D' and {_int(2, 4)} between 54 and {_LEN} and {_int(6, 4)} = 0 and {_int(10, 4)} between 54 and {_int(2, 4)} and {_int(14, 4)} in (40, 52, 56, 108, 124)
 and {_int(18, 4)} between 1 and 65536 and {_h} between 1 and 65536 and {_int(26, 2)} = 1 and {_int(28, 2)} in (1, 4, 8, 16, 24, 32) and {_int(30, 4)} <= 5 and ({_int(30, 4)} <> 1 or {_int(28, 2)} = 8) and {_int(38, 4)} <= 1000000
 and case {_int(28, 2)} when 1 then {_int(46, 4)} <= 2 when 4 then {_int(46, 4)} <= 16 when 8 then {_int(46, 4)} <= 256 else true end and ({_int(46, 4)} = 0 or {_int(50, 4)} <= {_int(46, 4)})""")
_check("validate_png", _PNG, X.png_valid, f"{_int(8, 4, False)} = 13 and {_int(16, 4, False)} between 1 and 99999 and {_int(20, 4, False)} between 1 and 99999 and {_LEN} >= 29")
_check("validate_gif", ["4749463839", (1, "be", f"case {K} % 3 when 0 then 97 else 98 end"), *_GIF[3:]], X.gif_valid, f"substr(h, 11, 2) = '61' and {_int(6, 2)} > 0 and {_int(8, 2)} > 0")
_probe = lambda b: B.piece(b, B.u32(b, 0x3C), 84)
_check("validate_exe", _EXE, lambda b, n: X.exe_valid(b, _probe(b), n), f"{_int(60, 4)} + 4 <= {_LEN} and substr(h, 2 * {_int(60, 4)} + 1, 8) = '50450000'")
_check("validate_mpg", _MPG, X.mpg_valid, f"""{_LEN} >= 14 and case when ({_int(4, 1)} & 192) = 64 then substr(h, 29, 2 * ({_int(13, 1)} & 7)::int) = repeat('FF', ({_int(13, 1)} & 7)::int) or {_LEN} < 14 + ({_int(13, 1)} & 7)
 else ({_int(4, 1)} & 240) = 32 and ({_int(4, 1)} & 1) = 1 and ({_int(6, 1)} & 1) = 1 and ({_int(8, 1)} & 1) = 1 end""")
_check("validate_gz_header", _GZ, X.gzip_head_valid, f"({_int(3, 1)} & 224) = 0 and ({_int(4, 4)} = 0 or {_int(4, 4)} between 86400 and 3153600000) and {_int(8, 1)} in (0, 2, 4) and ({_int(9, 1)} <= 13 or {_int(9, 1)} = 255)")
_check("size_bmp", _BMP, lambda b, n: X.bmp_size(b, n, F.lit(58).cast("long")), f"least({_int(2, 4)}, 58)", "size")
_check("size_exe", _EXE, lambda b, n: X.exe_size(_probe(b), n, F.lit(200).cast("long")), f"(case when substr(h, 2 * {_int(60, 4)} + 1, 8) = '50450000' and {_int(144, 4)} between 1 and 200 then least({_int(144, 4)}, {_LEN}) else least({_LEN}, 200) end)::bigint", "size")
_check("size_zip_eocd", _ZIP, lambda b, n: X.zip_size(B.find(b, b"PK\5\6"), B.piece(b, 30, 22), n, F.lit(300).cast("long"), F.lit(0).cast("long")), f"least(30 + 22 + {_int(50, 2)}, 300)", "size")
_check("size_footer", [*_PNG, "0000000049454E44AE426082"] , lambda b, n: X.footer_size(n, F.lit(1 << 20).cast("long"), B.find(b, bytes.fromhex("49454E44AE426082")), F.lit(8)), f"((instr(h, '49454E44AE426082') - 1) // 2 + 8)::bigint", "size")


@query(f"""with x as (select l_orderkey, l_linenumber, {_hex_duck([(4, 'be', 'l_orderkey'), (4, 'be', 'l_partkey * 77777 % 4294967296'), (8, 'be', 'l_suppkey * 1000003')])} as h from lineitem)
select l_orderkey, l_linenumber, {_int(0, 2)} as u16_le, {_int(2, 2, False)} as u16_be, {_int(4, 4)} as u32_le, {_int(4, 4, False)} as u32_be, {_int(8, 8, False)} as u64_be, 0::bigint as short from x""")
def decode_u16_u32(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("b")
    blob = _hex_spark([(4, "be", "l_orderkey"), (4, "be", "l_partkey * 77777 % 4294967296"), (8, "be", "l_suppkey * 1000003")])
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", blob.alias("b"))
    return rows.select("l_orderkey", "l_linenumber", B.u16(b, 0).alias("u16_le"), B.u16(b, 2, False).alias("u16_be"), B.u32(b, 4).alias("u32_le"), B.u32(b, 4, False).alias("u32_be"), B.u64(b, 8, False).alias("u64_be"), B.u32(b, 14).alias("short"))


@F.pandas_udf(DoubleType())
def _validities(rows: pd.Series) -> pd.Series:
    n = rows.str.len().to_numpy(np.int64)
    flat = np.frombuffer(b"".join(rows), np.uint8)
    return pd.Series(R.validity(flat, np.repeat(np.arange(len(n)), n), np.cumsum(n)))


_PAIRS: list[Field] = ["FF", (1, "be", "l_partkey % 256"), "41FF", (1, "be", "l_suppkey % 3 * 108"), "42FF", (1, "be", "208 + l_linenumber"), "FF"]
_good = "(b in (0, 217) or b between 208 and 215)"


@query(f"""select l_orderkey, l_linenumber, ((case when {_good.replace('b ', 'l_partkey % 256 ').replace('(b', '(l_partkey')} then 1 else 0 end) + (case when {_good.replace('b ', 'l_suppkey % 3 * 108 ')} then 1 else 0 end)
 + (case when {_good.replace('b ', '208 + l_linenumber ')} then 1 else 0 end)) / 3.0 as score from lineitem""".replace("(l_partkey in", "(l_partkey % 256 in"))
def ff_validity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _hex_spark(_PAIRS).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", _validities("b").alias("score"))


@query("""with s as (select o_custkey as seq, o_orderkey * 512 as "offset", (o_orderkey * 7919 % 800) / 100.0::double as entropy, (o_orderkey % 11) / 10.0::double as ff, o_orderkey % 9 as units, o_orderkey % 4 <> 0 as ends from orders),
p as (select *, row_number() over (partition by seq order by entropy desc, "offset") as prior from s where entropy >= 2),
v as (select *, row_number() over (partition by seq order by ff desc, entropy desc, prior) as rank1 from p where prior <= 9 and (ff >= 0.3 or "offset" % 1024 = 0)),
w as (select *, row_number() over (partition by seq order by units desc, ff desc, entropy desc, rank1) as rank2 from v where rank1 <= 3 and ends)
select seq, "offset", prior::int as prior, rank1::int as rank1, units from w where rank2 = 1""")
def recovery_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking stages of recovery on scores made from orders; a customer's orders are one JPEG's candidates."""
    c = R.RecoveryConfig(min_entropy=2.0, min_ff_validity=0.3)
    s = _table(spark, sf_dir, "orders").select(F.lit("orders").alias("image_id"), F.col("o_custkey").alias("seq"), (F.col("o_orderkey") * 512).alias("offset"), (F.expr("o_orderkey * 7919 % 800") / 100.0).alias("entropy"), (F.expr("o_orderkey % 11") / 10.0).alias("ff"), F.expr("o_orderkey % 9").alias("units"), F.expr("o_orderkey % 4 <> 0").alias("ends"))
    rows = R.pool(s.withColumn("direct", F.lit(False)), c).withColumn("direct", F.col("offset") % 1024 == 0)
    won = R.rank_by_units(R.rank_by_validity(rows, c).withColumn("size", F.when(F.col("ends"), 1)))
    return won.select("seq", "offset", "prior", "rank1", "units")


_FOUND = " union all ".join(f"select '{suffix}' as suffix, sum((length({text}) - length(replace({text}, '{header}', ''))) // {len(header)})::bigint as n from pages" for suffix, header, text in (("bmp", "BM", "html"), ("exe", "MZ", "html"), ("htm", "<html", _FOLD), ("cpp", "#include", "html")))


@query(f"select * from ({_FOUND}) where n > 0")
def spec_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in pages tied to their specs by index, for the types chosen."""
    types = ["bmp", "exe", "htm", "cpp"]
    specs = filter_types(specs_frame(spark, builtin_specs()), types).select("spec_idx", "suffix")
    chosen = select_types(builtin_specs(), types)
    numbers = spark.createDataFrame([(k, builtin_specs().index(s)) for k, s in enumerate(chosen)], "place int, spec_idx int")
    hits = scan.tally(I.chunks(_pages(spark, sf_dir)), chosen).withColumnRenamed("spec_idx", "place")
    return hits.join(numbers, "place").join(specs, "spec_idx").select("suffix", F.col("n_hits").alias("n"))


@query("""with w as (select distinct unnest(string_split(text, ' ')) as word from benchmark), v as (select word, word || ' ' as h from w where regexp_full_match(word, '[a-z]{4,}'))
select word, sum((length(text) - length(replace(text, h, ''))) // length(h))::bigint as n_hits from v join documents on contains(text, h) group by word""")
def catalog_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of some thousand signatures, the words of the benchmark with the space after them: a table, looked for in one pass over all documents."""
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).where(F.col("word").rlike("^[a-z]{4,}$")).distinct()
    catalog = settle(words.select(F.row_number().over(Window.orderBy("word")).alias("spec_idx"), F.col("word").alias("suffix"), F.encode(F.concat("word", F.lit(" ")), "UTF-8").alias("header"), F.lit(True).alias("case_sensitive"), F.lit("Forward").alias("search_type")), "catalog")
    chunks = I.chunks(I.from_table(_table(spark, sf_dir, "documents"), "doc_id", "text"))
    found = scan.tally(chunks, catalog)
    return found.join(catalog, "spec_idx").select(F.col("suffix").alias("word"), "n_hits")


_CUT = 512


@query(f"""with parts as (select page_id, html, strlen(html) as n, string_split(html, '<p>') as a, string_split(html, '</p>') as b from pages where html is not null),
o as (select page_id, n, sum(strlen(part) + 3) over (partition by page_id order by k) - 3 as p, k, many from (select page_id, n, len(a) as many, unnest(a) as part, generate_subscripts(a, 1) as k from parts)),
c as (select page_id, sum(strlen(part) + 4) over (partition by page_id order by k) - 4 as q, k, many from (select page_id, len(b) as many, unnest(b) as part, generate_subscripts(b, 1) as k from parts)),
h as (select o.page_id, o.n, o.p, c.q, o.p // {_CUT} as chunk from (select * from o where k < many) o asof left join (select * from c where k < many) c on o.page_id = c.page_id and o.p <= c.q where o.p // {_CUT} = (o.p + 2) // {_CUT}),
f as (select *, coalesce(q + 4 <= (chunk + 1) * {_CUT}, false) as here from h),
r as (select page_id, chunk, p, not here as late, coalesce(q + 4, n) - p as size from (select *, min(p) over (partition by page_id, chunk, q) as first from f) where not here or p = first)
select page_id, row_number() over (partition by page_id order by chunk, late, p)::int as seq, size::bigint as filesize, p::bigint as img_offset from r""")
def carve_pages_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File mode over chunks without their images: what ends beyond its chunk is measured by what later chunks tell of their ends."""
    chunks = I.chunks(_pages(spark, sf_dir), _CUT)
    return _picked(carve(None, CarveConfig([Spec("Config", "par", b"<p>", b"</p>", 1 << 20)]), chunks))


@query("""with h as (select page_id, hex(encode(coalesce(html, ''))) as h from pages where page_id is not null)
select page_id, (length(substr(h, 2 * (page_id * 37 % 200)::int + 1, 2 * (1 + page_id % 300)::int)) // 2)::bigint as n_bytes, substr(h, 2 * (page_id * 37 % 200)::int + 1, 2 * (1 + page_id % 300)::int) as bytes from h""")
def ranges_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files, and of each one range read back by a table of ranges."""
    at = shared_path(spark, "pages")
    pages = _table(spark, sf_dir, "pages").where("page_id is not null")
    store.write_files(pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("filename"), F.encode("html", "UTF-8").alias("data")), at)
    asked = pages.select("page_id", F.concat(F.lit(f"{at}/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), (F.col("page_id") * 37 % 200).alias("offset"), (1 + F.col("page_id") % 300).alias("length"))
    return store.read_ranges(asked).select("page_id", F.octet_length("bytes").cast("long").alias("n_bytes"), F.hex("bytes").alias("bytes"))


@query(f"""with c as (select doc_id, k // 64 as block, b, count(*) as n from {_BYTES} group by all), t as (select doc_id, block, sum(n) as t from c group by all),
e as (select c.doc_id, c.block * 64 as "offset", round(sum(-(n / t) * log2(n / t)), 9) as e from c join t on c.doc_id = t.doc_id and c.block = t.block group by all),
w as (select doc_id, strlen(text) as n, doc_id % 7 * 64 as lo, doc_id % 7 * 64 + 64 * (5 + doc_id % 40) as hi, doc_id % 7 * 64 + 100 as a, doc_id % 7 * 64 + 100 + doc_id % 5 * 64 as b from documents)
select doc_id, "offset"::bigint as "offset", round(e, 6) + 0.0 as entropy, r::int as rank from (select e.*, row_number() over (partition by e.doc_id order by e.e desc, e."offset") as r from e join w on e.doc_id = w.doc_id
 where "offset" < n - 64 and "offset" >= lo and "offset" < hi and not ("offset" >= a and "offset" < b)) where r <= 3""")
def blocks_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three blocks of highest entropy in a window of each document, without those in a part of it: a join on bins."""
    docs = _table(spark, sf_dir, "documents")
    sizes = docs.select(F.col("doc_id").cast("string").alias("image_id"), F.octet_length("text").alias("n"))
    points = stats.entropies(I.from_table(docs, "doc_id", "text"), 64).join(sizes, "image_id").where(F.col("offset") < F.col("n") - 64).select("image_id", "offset", F.round("entropy", 9).alias("entropy"))
    lo = F.col("doc_id") % 7 * 64
    spans = docs.select(F.col("doc_id").cast("string").alias("image_id"), F.lit(1).alias("seq"), lo.alias("lo"), (lo + 64 * (5 + F.col("doc_id") % 40)).alias("hi"), (lo + 100).alias("skip_lo"), (lo + 100 + F.col("doc_id") % 5 * 64).alias("skip_hi"))
    best = intervals.best(points, spans, ["image_id"], "seq", 3, "entropy", 512)
    return best.select(F.col("image_id").cast("long").alias("doc_id"), "offset", (F.round("entropy", 6) + 0.0).alias("entropy"), "rank")


# ---- walkers on synthesised files ----


def _walk(name: str, fields: list[Field], walker: Callable[[bytes], int | None], sql: str, out: str = "size") -> None:
    _check(name, fields, lambda b, n: F.coalesce(F.udf(walker, "long", useArrow=True)(b), F.lit(-1)), f"coalesce(({sql})::bigint, -1)", out)


_LOCAL = lambda size, name, extra: ["504B0304" + "00" * 14, (4, "le", size), "00000000", (2, "le", name), (2, "le", extra)]
_ENTRIES: list[Field] = [*_LOCAL(f"{K} % 90", f"{K} % 7", f"{K} % 5"), "AA" * 70, *_LOCAL(f"{K} * 11 % 400", "3", "0"), "BB" * 40]
_first = f"(30 + {_int(18, 4)} + {_int(26, 2)} + {_int(28, 2)})"
_walk("walk_zip_entries", _ENTRIES, lambda b: W.zip_by_headers(b, 420), f"least(case when {_first} <= 100 then greatest({_first}, 133 + {_int(118, 4)}) else {_first} end, 420)")
_walk("walk_mov_atoms", [(4, "be", f"8 + {K} % 40"), "66747970", "0000000866726565" * 8], lambda b: W.mov_size(b, 70), f"case when {_int(0, 4, False)} % 8 = 0 then 70 else {_int(0, 4, False)} end")
_PDF: list[Field] = ["255044462D312E340A", "78726566" + "0A" + "30" * 20 + "0A", "2525454F46", "41" * 5, "7374617274787265660A", (1, "be", f"48 + {K} % 10"), "0A2525454F46", (1, "be", f"case when {K} % 3 = 0 then 13 else 66 end"), "0A42"]
_walk("walk_pdf_ends", _PDF, lambda b: W.pdf_size(b, 1 << 20), f"case when {_int(55, 1)} in (48, 56, 57) then 62 + case when {_int(62, 1)} = 13 then 2 else 0 end else 40 end")
_skip = f"(10 + case when {_int(3, 1)} & 4 = 4 then 2 + {_int(10, 2)} else 0 end)"
_walk("walk_gzip_fields", ["1F8B08", (1, "be", f"2 * ({K} % 4)"), "00000000" + "00FF", (2, "le", f"{K} % 9"), "00" * 6], lambda b: W.gzip_header_end(b), f"case when {_skip} + ({_int(3, 1)} & 2) <= {_LEN} then {_skip} + ({_int(3, 1)} & 2) end", "body")
_walk("walk_gzip_name", ["1F8B0808" + "00000000" + "00FF", (1, "be", f"{K} * 7 % 60"), (1, "be", f"{K} % 130"), "42" + "00" + "0000"], lambda b: W.gzip_header_end(b), f"""case when {_int(10, 1)} = 0 then 11 when {_int(10, 1)} < 32 and {_int(10, 1)} not in (9, 10, 13) then null
 when {_int(11, 1)} = 0 then 12 when ({_int(11, 1)} < 32 and {_int(11, 1)} not in (9, 10, 13)) or {_int(11, 1)} = 127 then null else 14 end""", "body")
_check("walk_gzip_payload", ["1F8B0800" + "00000000" + "00FF", (1, "be", f"{K} % 8"), (2, "le", f"{K} % 3"), (2, "le", f"65535 - {K} % 2"), "00" * 9], lambda b, n: F.udf(lambda x: W.gzip_payload_valid(x, 10), "boolean", useArrow=True)(b), f"({_int(10, 1)} >> 1) <> 3 and (({_int(10, 1)} >> 1) <> 0 or {_int(11, 2)} + {_int(13, 2)} = 65535)")
_PATCHED: list[Field] = [_JPEG := "FFD8FFE000104A46494600010100000100010000" + "FFDB004300" + "10" * 64 + "FFC4001400" + (_ONE_CODE := "01" + "00" * 15) + "03" + "FFC4001410" + _ONE_CODE + "00" + "FFC0000B080100010001011100" + "FFDA0008010100003F00", "1122", "FF", (1, "be", f"case {K} % 4 when 0 then 217 when 1 then 1 when 2 then 0 else 211 end"), "3344", "FFD9", "55" * 4]
_scan_at = len(_JPEG) // 2 + 2
_walk("walk_jpeg", _PATCHED, lambda b: W.jpeg_size(W.jpeg(b, 1 << 20), b, 1 << 20), f"case {_int(_scan_at + 1, 1)} when 217 then {_scan_at + 2} when 1 then {_scan_at} else {_scan_at + 6} end")
_UNITS: list[Field] = [(1, "be", f"{K} % 120"), (1, "be", f"{K} * 7 % 200"), (1, "be", f"{K} * 13 % 250"), (1, "be", f"{K} * 31 % 97")]
_unit_bits = " || ".join(f"lpad(bin({_int(k, 1)}), 8, '0')" for k in range(4))
_unit_bits_of = f"length(regexp_extract({_unit_bits}, '^(0...0)*')) // 5"


def _units_of(header: bytes | int) -> Callable[[Column], Column]:
    """Units of a batch of rows decoded together: after one header, or each after the header that its first bytes are."""

    @F.pandas_udf(LongType())
    def count(rows: pd.Series) -> pd.Series:
        whole = isinstance(header, bytes)
        heads = [header] * len(rows) if whole else [b[:header] for b in rows]
        known = {h: context(h) for h in {*heads}}
        found = count_all([(known[h], b if whole else b[header:]) for h, b in zip(heads, rows, strict=True)])
        return pd.Series([-1 if n is None else n for n in found])

    return count


_check("count_jpeg_units", _UNITS, lambda b, n: _units_of(bytes.fromhex(_JPEG))(b), f"({_unit_bits_of})::bigint", "units")
# Headers with a sampling of 0, 1 or 2 blocks, a start or padding within, and scans of one to four components where two fit.
_HEAD: list[Field] = ["FFD8FFE000104A46494600010100000100010000" + "FF", (1, "be", f"case when {K} % 2 = 0 then 216 else 255 end"), "FFDB004300" + "10" * 64 + "FFC4001400" + _ONE_CODE + "03" + "FFC4001410" + _ONE_CODE + "00" + "FFC0000B0800080008010" + "1", (1, "be", f"case {K} % 3 when 0 then 0 when 1 then 17 else 33 end"), "00" + "FFDA0008", (1, "be", f"1 + {K} % 4"), "0100003F00"]
_head_size = sum(len(f) if isinstance(f, str) else 2 * f[0] for f in _HEAD) // 2
_bits_after = " || ".join(f"lpad(bin({_int(_head_size + k, 1)}), 8, '0')" for k in range(4))
_check("count_units_by_header", [*_HEAD, *_UNITS], lambda b, n: _units_of(_head_size)(b), f"(case when {K} % 4 > 1 then -1 else length(regexp_extract({_bits_after}, '^(0...0)*')) // 5 // (case when {K} % 3 = 2 then 2 else 1 end) end)::bigint", "units")
_atom = lambda kind, size, body="": f"{size:08X}" + kind.encode().hex().upper() + body
_MOV: list[Field] = ["00", (1, "be", f"{K} % 3"), "0001", (4, "be", f"232 + case when {K} % 11 = 0 then 4 else 0 end"), b"moov".hex(), _atom("mvhd", 108), (1, "be", f"{K} % 4"), "000000", (4, "be", f"{K} % 5"), "00000000", (4, "be", f"case {K} % 7 when 0 then 0 when 1 then 1000001 else 1000 end"), "00" * 84, _atom("trak", 116), _atom("tkhd", 92, "00" * 84), _atom("mdia", 16, "00" * 8)]
_check("walk_mov_valid", _MOV, lambda b, n: F.udf(W.mov_valid, "boolean", useArrow=True)(b), f"{K} % 11 <> 0 and {K} % 4 < 2 and {K} % 5 <> 0 and {K} % 7 > 1")
_WHITE: list[Field] = ["255044462D312E340A", "78726566" + "0A" + "30" * 20 + "0A", "2525454F46", "41" * 5, "737461727478726566", (1, "be", f"case {K} % 6 when 0 then 32 when 1 then 9 when 2 then 13 when 3 then 0 when 4 then 11 else 12 end"), "39", "0A2525454F46", "0D0A42"]
_walk("walk_pdf_white", _WHITE, lambda b: W.pdf_size(b, 1 << 20), f"case when {K} % 6 < 3 then 64 else 40 end")
_CAPPED: list[Field] = ["FFD8FFE000104A46494600010100000100010000" + "FFDB004300" + "10" * 64 + "FFC4001400" + _ONE_CODE + "03" + "FFC0000B08", (2, "be", f"{K} % 40"), (2, "be", f"{K} % 30"), "01011100" + "FFDA0008010100003F00", "1122" * 40]
_walk("walk_jpeg_cap", _CAPPED, lambda b: W.jpeg_size(W.jpeg(b, 1 << 20), b, 1 << 20), f"case when {K} % 40 * ({K} % 30) = 0 then {_LEN} else least({_LEN}, {K} % 40 * ({K} % 30) * 9 // 10) end")


@query(f"""select {K}, {K} * 37 // 512 * 512 as below, ({K} * 37 + 511) // 512 * 512 as above, {K} * 1000003 // 1048576 as mib, case when {K} % 2 = 0 then '{{0}}' else 'x.y_' end || {K} || '_recovered.jpg' as name from orders""".replace("{0}", "a-"))
def names_and_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col(K) * 37
    name = F.concat(F.lit("/d.e/"), F.when(F.col(K) % 2 == 0, "a-").otherwise("x.y_"), F.col(K).cast("string"), F.lit(".jpg"))
    return _table(spark, sf_dir, "orders").select(K, B.align_down(at, 512).alias("below"), B.align_up(at, 512).alias("above"), B.mebibytes(F.col(K) * 1_000_003).alias("mib"), B.recovered_filename(name).alias("name"))


@query("""with t as (select doc_id, translate(text, 'THE', 'the') as text from documents), p as (select doc_id, text, string_split(text, 'the') as p from t where contains(text, 'the')), q as (select doc_id, strlen(text) as n, strlen(p[1]) as first, strlen(text) - strlen(p[-1]) - 3 as last, len(p) - 1 as n_hits from p)
select doc_id, first, last, n_hits from q""")
def searches_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pattern by three search types: the first place forward, the first one from the end, and the number of printable ones."""
    specs = [Spec("Config", "t", b"the", None, 9, False, kind) for kind in ("ForwardNext", "Reverse", "Ascii")]
    found = scan.hits(I.chunks(I.from_table(_table(spark, sf_dir, "documents"), "doc_id", "text")), specs)
    one = lambda idx, what: F.min(F.when((F.col("spec_idx") == idx) & what, F.col("pos") + F.col("chunk_offset")))
    first = F.col("spec_idx") == 1
    return found.groupBy(F.col("image_id").cast("long").alias("doc_id")).agg(one(0, F.lit(True)).alias("first"), F.min_by(F.when(first, F.col("pos") + F.col("chunk_offset")), F.when(first, F.col("k2"))).alias("last"), F.count_if(F.col("spec_idx") == 2).alias("n_hits"))


@query("""with s as (select o_custkey as seq, o_orderkey * 512 as "offset", (o_orderkey * 7919 % 800) / 100.0::double as entropy, (o_orderkey % 11) / 10.0::double as ff from orders),
d as (select seq, min("offset") as direct_at from s group by seq),
b as (select * from (select *, row_number() over (partition by seq order by entropy desc, "offset") as prior from s where entropy >= 6) where prior <= 9),
p as (select seq, "offset", entropy, prior from b union all select d.seq, d.direct_at, 0.0, 0 from d where not exists (select 1 from b where b.seq = d.seq and b."offset" = d.direct_at)),
v as (select p.*, s.ff, p."offset" = d.direct_at as direct, row_number() over (partition by p.seq order by s.ff desc, p.entropy desc, p.prior) as rank1 from p join s using (seq, "offset") join d on d.seq = p.seq where s.ff >= 0.3 or p."offset" = d.direct_at)
select seq, "offset", prior::int as prior, direct, rank1::int as rank1 from v where rank1 <= 3""")
def recovery_direct_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking where the block right after the fragment, a customer's first order, is put in front whatever its scores are."""
    c = R.RecoveryConfig(min_entropy=6.0, min_ff_validity=0.3)
    s = _table(spark, sf_dir, "orders").select(F.lit("orders").alias("image_id"), F.col("o_custkey").alias("seq"), (F.col("o_orderkey") * 512).alias("offset"), (F.expr("o_orderkey * 7919 % 800") / 100.0).alias("entropy"), (F.expr("o_orderkey % 11") / 10.0).alias("ff"))
    rows = s.withColumn("direct", F.col("offset") == F.min("offset").over(Window.partitionBy("image_id", "seq")))
    return R.rank_by_validity(R.pool(rows, c), c).select("seq", "offset", "prior", "direct", "rank1")


# ---- reports, catalogs and streams ----


_NUMBERED = _HTM + """, n as (select page_id, row_number() over (partition by page_id order by late, img_offset)::int as seq, filesize::bigint as filesize, img_offset::bigint as img_offset from r)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as sources of a report: image_id and bytes_read."""
    return _pages(spark, sf_dir).select("image_id", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("bytes_read"))


@query(_NUMBERED + " select page_id, seq, page_id || '-' || seq || '-' || img_offset || '.htm' as filename, filesize, 'htm' as file_type, 0::bigint as \"offset\", img_offset, filesize as len, false as has_scan from n")
def merged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON report over all pages, written by many tasks in order, and read back."""
    at = f"{shared_path(spark, 'report')}/carve_report.json"
    files = settle(carve(_pages(spark, sf_dir), CarveConfig(select_types(builtin_specs(), ["htm"]), "buffer", prefix_filenames=True)), "files")
    tell(JsonReporter(at), _sources(spark, sf_dir), files)
    back, run = report.read_report(spark, at), F.col("byte_runs")[0]
    part = lambda k: F.split("filename", "-")[k]
    return back.select(part(0).cast("long").alias("page_id"), part(1).cast("int").alias("seq"), "filename", "filesize", "file_type", run["offset"].alias("offset"), run["img_offset"].alias("img_offset"), run["len"].alias("len"), F.col("jpeg_scan").isNotNull().alias("has_scan"))


@query(_NUMBERED + """, l as (select page_id, 0 as place, 0 as num, 'Num\tName\tSize\tFile Offset\tComment' || chr(10) as line from pages
union all select page_id, 1, seq, seq || chr(9) || seq || '.htm' || chr(9) || filesize || chr(9) || img_offset || chr(9) from n
union all select page_id, 2, 0, chr(10) || 'Finished carving. Total bytes read: ' || coalesce(strlen(html), 0) from pages) select page_id, place, num::bigint as num, line from l""".replace("\t", "' || chr(9) || '"))
def audit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = report.audit_text(_sources(spark, sf_dir), _htm(spark, sf_dir, "buffer"))
    return lines.select(F.col("image_id").cast("long").alias("page_id"), "place", "num", "line")


@query("""with x as (select o_orderkey, o_orderkey % 5 as kind, o_orderkey * 37 as pos, 1 + o_orderkey % 9 as len from orders)
select kind, count(*) as incomplete, count(*) filter (where len >= 4) as searched, sum(case when kind = 2 then pos + 7 else pos + len end)::bigint as search_at from x where kind in (1, 2) group by kind""")
def incomplete_jpegs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File objects made from orders: those of JPEGs without an end, how many are long enough, and where their rest is looked for."""
    status = F.when(F.col(K) % 5 == 1, "truncated").when(F.col(K) % 5 == 2, "fragmented").otherwise("complete")
    run = F.struct(F.lit(0).cast("long").alias("offset"), (F.col(K) * 37).alias("img_offset"), (1 + F.col(K) % 9).alias("len"))
    broken = F.when(F.col(K) % 5 == 2, F.col(K) * 37 + 7)
    info = F.when(F.col(K) % 5 < 4, F.struct(F.lit(1).alias("width"), F.lit(1).alias("height"), broken.alias("fragmentation_point_img_offset"), F.lit(False).alias("has_restart_markers"), status.alias("status")))
    files = _table(spark, sf_dir, "orders").select(F.lit("i").alias("image_id"), F.col(K).cast("int").alias("seq"), F.lit("f").alias("filename"), F.lit("jpeg").alias("file_type"), F.array(run).alias("byte_runs"), info.alias("jpeg_scan"))
    found = R.incomplete(files)
    return found.groupBy((F.col("seq") % 5).cast("long").alias("kind")).agg(F.count("*").alias("incomplete"), F.count_if(F.col("fragment_len") >= R.LEAST_FRAGMENT).alias("searched"), F.sum("search_at").alias("search_at"))


@query(f"""with b as (select page_id, hex(encode(html)) as h from pages where html is not null), s as (select page_id, unhex(substr(h, 2 * 64 * 3 + 1))::blob as rest, substr(h, 2 * 64 * 3 + 1) as h from b),
k as (select page_id, h, unnest(range(0, greatest(length(h) // 2 - 2, 0))) as pos from s)
select page_id, count(*)::bigint as n_files, min(pos)::bigint as first_at, sum(length(h) // 2 - pos)::bigint as bytes from k where substr(h, 2 * pos::int + 1, 4) = '3C70' and pos % 16 = 0 group by page_id""")
def quick_after_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without their first three blocks, carved at block boundaries only, without checks: whatever starts there is taken whole."""
    rest = I.skip_blocks(_pages(spark, sf_dir).where("content is not null"), 3, 64)
    files = carve(rest, CarveConfig([Spec("Jpeg", "p", b"<p", None, 1 << 20)], "buffer", quick=True, block_size=16, disable_validation=True))
    return files.groupBy(F.col("image_id").cast("long").alias("page_id")).agg(F.count("*").alias("n_files"), F.min("img_offset").alias("first_at"), F.sum("filesize").alias("bytes"))


@query(f"select doc_id, coalesce(round(e, 6), 0) + 0.0 as entropy from (select c.doc_id, sum(-(n / t) * log2(n / t)) as e from (select doc_id, b, count(*) as n from {_BYTES} group by all) c join (select doc_id, count(*) as t from {_BYTES} group by doc_id) t on c.doc_id = t.doc_id group by c.doc_id)")
def entropy_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entropy of documents that are given in pieces of 700 bytes."""
    pieces = I.chunks(I.from_table(_table(spark, sf_dir, "documents"), "doc_id", "text"), 700)
    found = stats.entropy_of(stats.byte_counts(pieces))
    return found.select(F.col("image_id").cast("long").alias("doc_id"), (F.round("entropy", 6) + 0.0).alias("entropy"))


@query("""with w as (select distinct lower(split_part(n_name, ' ', 1)) as word from nation), c as (select row_number() over (order by word) - 1 as spec_idx, word from w)
select spec_idx::int as spec_idx, case when spec_idx % 3 = 0 then 'config' else 'htm' end as file_type, word as suffix, hex(encode(word)) as header, strlen(word)::int as header_len, case when spec_idx % 2 = 0 then hex(encode('/' || word)) end as footer, (1000 + spec_idx)::bigint as max_len, spec_idx % 3 <> 0 as case_sensitive,
 case spec_idx % 4 when 1 then 'Reverse' when 2 then 'Ascii' else 'Forward' end as search_type, (spec_idx % 5)::int as n_markers from c where word not like '%1' union all
select (select count(*) from c)::int + row_number() over (order by spec_idx)::int - 1, case when spec_idx % 3 = 0 then 'config' else 'htm' end, word, hex(encode(word)), strlen(word)::int, case when spec_idx % 2 = 0 then hex(encode('/' || word)) end, (1000 + spec_idx)::bigint, spec_idx % 3 <> 0, case spec_idx % 4 when 1 then 'Reverse' when 2 then 'Ascii' else 'Forward' end, (spec_idx % 5)::int from c where word like '%1'""")
def catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog made from nations, written as TOML, read back and chosen from; the rest of it is put behind as a second one."""
    words = sorted({r[0] for r in _table(spark, sf_dir, "nation").select(F.lower(F.split("n_name", " ")[0])).collect()})
    made = [Spec("Nope" if k % 3 == 0 else "Htm", w, w.encode(), f"/{w}".encode() if k % 2 == 0 else None, 1000 + k, k % 3 != 0, ["Sideways", "Reverse", "Ascii", "Forward"][k % 4], tuple(b"m" * n for n in range(1, k % 5 + 1))) for k, w in enumerate(words)]
    with tempfile.TemporaryDirectory() as folder:
        save_specs(made, f"{folder}/specs.toml")
        back = load_specs(f"{folder}/specs.toml")
    first = specs_frame(spark, back)
    chosen = filter_types(first, parse_types(",".join(s.suffix for s in select_types(back, [w for w in words if not w.endswith("1")]))))
    # numbers go on behind the whole first catalog
    rest = specs_frame(spark, select_types(back, [w for w in words if w.endswith("1")]))
    both = union_specs(first, rest)
    both = both.join(chosen.select("spec_idx"), "spec_idx", "left_semi").unionByName(both.where(F.col("spec_idx") >= len(words)))
    return both.select("spec_idx", "file_type", "suffix", F.hex("header").alias("header"), "header_len", F.hex("footer").alias("footer"), "max_len", "case_sensitive", "search_type", F.size("markers").alias("n_markers"))


@query("select o_orderkey, strftime(o_orderdate::timestamp, '%Y-%m-%dT%H:%M:%S') || '+0000' as stamp, case when o_orderkey % 2 = 0 then 'jpg' else 'htm' end as suffix, (case when o_orderkey % 2 = 0 then 3 when o_orderkey % 3 = 0 then 5 else o_orderkey % 100 end)::bigint as on_by from orders")
def stamps_and_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as reports have them, and how far a search goes on after a hit: JPEGs by their header only."""
    even = F.col(K) % 2 == 0
    size = F.when(F.col(K) % 3 == 0, 0).otherwise(F.col(K) % 100).cast("long")
    on = F.when(~even & (F.col(K) % 3 != 0) & (F.col(K) % 100 == 0), F.lit(0).cast("long")).otherwise(select.advance(F.when(even, "jpeg").otherwise("htm"), size, F.when(even, 3).otherwise(5)))
    return _table(spark, sf_dir, "orders").select(K, B.timestamp(F.col("o_orderdate").cast("timestamp")).alias("stamp"), F.when(even, "jpg").otherwise("htm").alias("suffix"), on.alias("on_by"))


@query("with h as (select doc_id, encode(text) as b, text from documents where text is not null) select doc_id, (case when contains(text, 'th') then strlen(text) - strlen(string_split(text, 'th')[-1]) - 2 else -1 end)::bigint as last_at from h")
def last_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last place of a pattern in each document."""

    @F.udf(LongType(), useArrow=True)
    def last(data: bytes) -> int:
        at = scan.find_last(bytes(data), b"th")
        return -1 if at is None else at

    docs = I.from_table(_table(spark, sf_dir, "documents"), "doc_id", "text").where("content is not null")
    return docs.select(F.col("image_id").cast("long").alias("doc_id"), last("content").alias("last_at"))


@query(_NUMBERED + " select page_id, seq, filesize, img_offset from n")
def carve_landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that land as files in a folder, carved by a stream as they come; files that can't be read are named and passed over."""
    at = shared_path(spark, "landing")
    pages = _table(spark, sf_dir, "pages").where("page_id is not null and html is not null")
    store.write_files(pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("filename"), F.encode("html", "UTF-8").alias("data")), f"{at}/in")
    config = CarveConfig(select_types(builtin_specs(), ["htm"]), "buffer")
    watch(spark, f"{at}/in", f"{at}/out", f"{at}/state", config, 50_000).awaitTermination()
    files = spark.read.schema("image_id string, seq int, filesize long, img_offset long").parquet(f"{at}/out")
    return files.select(F.regexp_extract("image_id", r"(\d+)\.html$", 1).cast("long").alias("page_id"), "seq", "filesize", "img_offset")


# ---- whole images, made of the files above: no SQL; tests hold them against plain Python ----

_ONE_CODE = "01" + "00" * 15
_JPEG = "FFD8FFE000104A46494600010100000100010000" + "FFDB004300" + "10" * 64 + "FFC4001400" + _ONE_CODE + "03" + "FFC4001410" + _ONE_CODE + "00" + "FFC0000B080008000801011100" + "FFDA0008010100003F00"


def images(spark: SparkSession, sf_dir: str, *more: Column, key: str = "image_id") -> DataFrame:
    """One image for each order: a page's start, pictures and archives of varying soundness, and a JPEG that often lacks its end.

    key: the column, one of more if need be, that they are joined or grouped by later.
    """
    gap = "00" * 16
    fields: list[Field] = [gap, *_BMP, gap, *_PNG, "0000000049454E44AE426082", gap, "474946383961", *_GIF[3:], "00003B", gap, *_GZ, "0102030405060708090A0B0C0D0E0F", "00000000", gap, *_ZIP, gap, _JPEG, (4, "be", f"{K} * 7919 % 2147483648"), (1, "be", f"case when {K} % 3 = 0 then 255 else 17 end"), (1, "be", f"case {K} % 2 when 0 then 217 else 1 end"), "112233445566778899" * 20, "FFD9", gap]
    keys = _dealt(_table(spark, sf_dir, "orders").select(K, F.col(K).cast("string").alias("image_id"), *more), key)
    return keys.select(*keys.columns[1:], _hex_spark(fields).alias("content"))


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows, dealt out before they grow: a small file is one task otherwise, whatever is made of its rows.

    By the key that they are joined or grouped by later, so that what they have grown to need not be dealt out again.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


@query()
def carve_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carve(images(spark, sf_dir))


@query()
def carve_images_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carve(images(spark, sf_dir), CarveConfig(quick=True, block_size=2, mode="buffer"))


@query()
def recover_jpegs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images(spark, sf_dir)
    files = carve(found, CarveConfig(select_types(builtin_specs(), ["jpg"])))
    return R.recover(found, files, R.RecoveryConfig(64, 512, 3, 0.0, 0.0)).drop("fragment_len")


@query()
def recover_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As recover_jpegs, over files of a hundred images each that are read by ranges: no image is in a row."""
    at = shared_path(spark, "disks")
    parts = images(spark, sf_dir, F.expr(f"{K} div 100").alias("disk"), key="disk").select("disk", F.col("image_id").cast("long").alias("n"), "content")
    joined = parts.groupBy("disk").agg(F.array_sort(F.collect_list(F.struct("n", "content"))).alias("z"))
    disks = joined.select(F.concat(F.col("disk").cast("string"), F.lit(".img")).alias("filename"), F.unhex(F.concat_ws("", F.transform("z", lambda x: F.hex(x["content"])))).alias("data"))
    store.write_files(disks, at)
    found = spark.read.format("binaryFile").load(at).select(F.col("path").alias("image_id"), "content")
    files = settle(carve(found, CarveConfig(select_types(builtin_specs(), ["jpg"]))), "files")
    won = R.recover(None, files, R.RecoveryConfig(64, 512, 3, 0.0, 0.0)).drop("fragment_len")
    return won.withColumn("image_id", F.regexp_extract("image_id", r"(\d+)\.img$", 1))
