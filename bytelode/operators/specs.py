"""The catalog of file signatures: a small dimension table."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEARCH_TYPES = ("Forward", "Reverse", "ForwardNext", "Ascii")
SCHEMA = "spec_idx int, file_type string, suffix string, max_len long, header binary, header_len int, footer binary, footer_len int, case_sensitive boolean, search_type string, markers array<binary>, comment string"
MIB = 1 << 20


@dataclass(frozen=True)
class Spec:
    file_type: str
    suffix: str
    header: bytes
    footer: bytes | None
    max_len: int
    case_sensitive: bool = True
    search_type: str = "Forward"
    markers: tuple[bytes, ...] = ()
    comment: str = ""

    def __post_init__(self) -> None:
        if not self.header:
            raise ValueError(f"spec {self.suffix!r} has an empty header")

    @cached_property
    def literal(self) -> bool:
        """Found in the one pass over all literal headers."""
        return self.case_sensitive and b"?" not in self.header

    @cached_property
    def kind(self) -> str:
        return self.file_type.lower()


#: File type, suffix, header, footer, longest MiB, markers. The order gives spec_idx.
_BUILTIN = [
    ("Jpeg", "jpg", "FFD8FF", "FFD9", 50, []),
    ("Gif", "gif", "47494638", "003B", 10, ["00003B"]),
    ("Bmp", "bmp", "424D", None, 2, []),
    ("Pdf", "pdf", "255044462D312E", "2525454F46", 40, ["2F4C20", "6F626A", "2F4C696E656172697A6564", "2F4C656E677468"]),
    ("Zip", "zip", "504B0304", "504B0506", 100, []),
    ("Png", "png", "89504E470D0A1A0A", "0000000049454E44AE426082", 10, []),
    ("Mpg", "mpg", "000001BA", "000001B9", 50, ["000001"]),
    ("Rar", "rar", "526172211A0700", None, 100, []),
    ("Exe", "exe", "4D5A", None, 10, []),
    ("Htm", "htm", "3C68746D6C", "3C2F68746D6C3E", 1, []),
    ("Ole", "ole", "D0CF11E0A1B11AE10000000000000000", None, 10, []),
    ("Wmv", "wmv", "3026B2758E66CF11", "A1DCAB8C47A9", 40, []),
    ("Mov", "mov", "6D6F6F76", None, 40, []),
    ("Mp4", "mp4", "0000001C66747970", None, 600, []),
    ("Riff", "rif", "52494646", "494E464F", 50, []),
    ("Cpp", "cpp", "23696E636C756465", "63686172", 1, ["696E74"]),
    ("Wpd", "wpd", "FF575043", None, 1, []),
    ("Gzip", "gz", "1F8B08", "00000000", 100, []),
]

#: Names of file types, as TOML catalogs write them: those of the built-in specs and, fixed values, these.
FILE_TYPES = {kind for kind, *_ in _BUILTIN} | {"Avi", "Config", "Doc", "Docx", "Elf", "Ppt", "Pptx", "Reg", "Sxc", "Sxi", "Sxw", "VJpeg", "Wav", "Xls", "Xlsx"}


def builtin_specs() -> list[Spec]:
    return [Spec(t, s, bytes.fromhex(h), bytes.fromhex(f) if f else None, m * MIB, t != "Htm", markers=tuple(map(bytes.fromhex, marks))) for t, s, h, f, m, marks in _BUILTIN]


def parse_types(text: str) -> list[str]:
    """A comma list; blank gives none, and `all` stands for itself."""
    return ["all"] if text.strip() == "all" else [t.strip() for t in text.split(",") if t.strip()]


def select_types(specs: list[Spec], types: list[str]) -> list[Spec]:
    """Specs of the given suffixes in catalog order; jpg and jpeg are the same; no types, or `all` among them, select everything."""
    if not types or "all" in types:
        return list(specs)
    wanted = {*types} | ({"jpg", "jpeg"} if {"jpg", "jpeg"} & {*types} else set())
    return [s for s in specs if s.suffix in wanted]


def load_specs(path: str) -> list[Spec]:
    """Specs of a TOML catalog; an unknown file type counts as Config, an unknown search type as Forward."""
    with open(path, "rb") as f:
        rows = tomllib.load(f)["specs"]
    known = lambda name, names, default: name if name in names else default
    raw = lambda v: bytes(v if isinstance(v, list) else v["value"])
    return [
        Spec(known(r["file_type"], FILE_TYPES, "Config"), r["suffix"], bytes(r["header"]), bytes(r["footer"]) if r.get("footer") else None, r["max_len"], r.get("case_sensitive", True), known(r.get("search_type", "Forward"), SEARCH_TYPES, "Forward"), tuple(map(raw, r.get("markers", []))), r.get("comment", ""))
        for r in rows
    ]


def save_specs(specs: list[Spec], path: str) -> None:
    """Write a TOML catalog that `load_specs` reads back as the same specs."""
    text = lambda v: json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007f")
    with open(path, "w", encoding="utf-8") as f:
        for s in specs:
            row = {"file_type": text(s.file_type), "suffix": text(s.suffix), "header": [*s.header], "footer": None if s.footer is None else [*s.footer], "max_len": s.max_len}
            row |= {"case_sensitive": text(s.case_sensitive), "search_type": text(s.search_type), "markers": [[*m] for m in s.markers], "comment": text(s.comment)}
            f.write("[[specs]]\n" + "".join(f"{k} = {v}\n" for k, v in row.items() if v is not None) + "\n")


def combined_specs(types: list[str] | None = None, disable_builtin: bool = False, config_file: str | None = None) -> list[Spec]:
    """Built-in specs unless disabled, then those of a TOML catalog; both restricted to the types. Duplicates stay."""
    out = [] if disable_builtin else select_types(builtin_specs(), types or [])
    return out + (select_types(load_specs(config_file), types or []) if config_file else [])


def specs_frame(spark: SparkSession, specs: list[Spec]) -> DataFrame:
    rows = [(k, s.file_type.lower(), s.suffix, s.max_len, s.header, len(s.header), s.footer, len(s.footer or b""), s.case_sensitive, s.search_type, list(s.markers), s.comment) for k, s in enumerate(specs)]
    return spark.createDataFrame(rows, SCHEMA)


def filter_types(specs: DataFrame, types: list[str]) -> DataFrame:
    """`select_types` on the dimension table."""
    if not types or "all" in types:
        return specs
    alias = F.when(F.col("suffix").isin("jpg", "jpeg"), F.lit(bool({"jpg", "jpeg"} & {*types}))).otherwise(False)
    return specs.where(F.col("suffix").isin(types) | alias)


def union_specs(first: DataFrame, second: DataFrame) -> DataFrame:
    """All of first, then all of second, numbered on."""
    n = first.count()
    return first.unionByName(second.withColumn("spec_idx", F.col("spec_idx") + n))
