"""Extracts of several formats -> DataFrames. Only headers and the first bytes of a file are looked at by the driver; encodings are told in parallel."""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyloom.session import ensure_checkpoint_dir
from tallyloom.sources.colmap import map_headers
from tallyloom.sources.xlsx import XlsxSource

SUFFIXES = (".xlsx", ".xls", ".xlsm", ".xlsb", ".csv", ".tsv", ".parquet")
#: Bytes of a file's head that tell the separator.
HEAD = 4096
#: Fields whose values are codes.
CODES = ("store_code", "item_code", "barcode")


#: The upper half of the Cyrillic code page: each byte as Latin-1 reads it, and what it means.
_UPPER = [b for b in range(128, 256) if b != 0x98]
_CP1251 = ("".join(map(chr, _UPPER)), bytes(_UPPER).decode("cp1251"))


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 (with or without mark), else the Cyrillic code page, else Latin-1: the first in which every byte of the file has a meaning.

    The lines are read as bytes in parallel; no line break lies within a character of any of the three.
    """
    raw = spark.read.text(path)
    undefined = F.contains(F.col("value").cast("binary"), F.lit(bytes([0x98])))
    told = raw.agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(undefined).alias("undefined")).first()
    if told["utf8"] is not False:  # null: no line at all
        return "UTF-8"
    return "ISO-8859-1" if told["undefined"] else "windows-1251"


def separator_of(head: str) -> str:
    """Semicolon if the head holds more of them than commas, else comma."""
    return ";" if head.count(";") > head.count(",") else ","


def head_of(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, through Spark's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        return bytes(stream.readNBytes(HEAD))
    finally:
        stream.close()


def read_text_table(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A delimited file with a header; the encoding by all its bytes, the separator by its head. All columns as Spark infers them."""
    head = head_of(spark, path)
    enc = encoding_of(spark, path)
    text = head.decode({"UTF-8": "utf-8-sig", "windows-1251": "cp1251", "ISO-8859-1": "latin-1"}[enc], errors="ignore")
    one_byte = enc == "windows-1251"  # not among Spark's encodings: read byte by byte, then the upper half is put right
    reader = spark.read.options(sep=separator or separator_of(text), header=True, encoding="ISO-8859-1" if one_byte else enc)
    df = reader.option("inferSchema", True).csv(path)
    # codes and barcodes stay text, leading zeros included
    names = {c: (c.encode("latin-1", "replace").decode("cp1251", "replace") if one_byte else c).lstrip("\ufeff").strip() for c in df.columns}
    codes = {h for h, f in map_headers(list(names.values())).items() if f in CODES}
    if any(n in codes and kind != "string" for (_, kind), n in zip(df.dtypes, names.values())):
        schema = StructType([StructField(f.name, StringType() if names[f.name] in codes else f.dataType) for f in df.schema])
        df = reader.schema(schema).csv(path)
    if one_byte:
        raw = [c.encode("latin-1", "replace").decode("cp1251", "replace") for c in df.columns]
        kinds = dict(df.dtypes)
        df = df.select(*(F.translate(f"`{c}`", *_CP1251).alias(n) if kinds[c] == "string" else F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, raw)))
    return df.toDF(*(c.lstrip("\ufeff").strip() for c in df.columns))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Reads a file by its suffix; an unknown one is a ValueError."""
    suffix = Path(path).suffix.lower()
    if suffix == ".csv":
        return read_text_table(spark, path)
    if suffix == ".tsv":
        return read_text_table(spark, path, "\t")
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix in (".xlsx", ".xlsm", ".xls", ".xlsb"):
        spark.dataSource.register(XlsxSource)
        return spark.read.format("xlsx").load(path)
    raise ValueError(f"no reader for {suffix or path}")


def read_bytes(spark: SparkSession, name: str, data: bytes) -> DataFrame:
    """An uploaded file: written into the shared checkpoint folder, where every executor can read it, and read by its suffix; delimited text with
    broken characters is repaired first."""
    at = Path(Path(name).name)
    if at.suffix.lower() not in SUFFIXES:
        at = at.with_suffix(".csv")
    path = f"{ensure_checkpoint_dir(spark)}/upload-{uuid.uuid4().hex}/{at.name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data.decode("utf-8", errors="replace").encode() if at.suffix.lower() in (".csv", ".tsv") else data))
    finally:
        out.close()
    return read_table(spark, path)


def source_files(folder: str) -> list[str]:
    """The files of a folder with a known suffix, sorted."""
    return sorted(str(p) for p in Path(folder).iterdir() if p.suffix.lower() in SUFFIXES)


def newest_first(folder: str, prefix: str = "merged_") -> list[str]:
    """The result files of a folder, the latest first by the time in their names, then by name."""
    return sorted((str(p) for p in Path(folder).iterdir() if p.name.startswith(prefix)), key=lambda p: Path(p).name, reverse=True)


def read_folder(spark: SparkSession, folder: str) -> tuple[list[tuple[str, DataFrame]], dict[str, str]]:
    """(name, table with ``source_file``) of every readable file, and the message of each that is not."""
    tables, failed = [], {}
    for path in source_files(folder):
        try:
            tables.append((Path(path).name, read_table(spark, path).withColumn("source_file", F.lit(Path(path).name))))
        except Exception as e:  # one bad file does not end the run
            failed[path] = str(e).splitlines()[0]
    return tables, failed


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name): the different non-blank lines of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> '' and name <> 'nan'").distinct()


def archive(files: list[str], folder: str) -> dict[str, str]:
    """Moves files, with _1, _2 … where the name is taken. Gives the new paths; a file that can't be moved keeps its own."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    moved = {}
    for f in map(Path, files):
        target, k = Path(folder) / f.name, 1
        while target.exists():
            target, k = Path(folder) / f"{f.stem}_{k}{f.suffix}", k + 1
        try:
            moved[str(f)] = str(shutil.move(str(f), target))
        except OSError:
            moved[str(f)] = str(f)
    return moved


def read_json(path: str, default):
    """A JSON state file; ``default`` where it is missing or broken."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default


def write_json(path: str, value) -> None:
    """Written beside and put in place at once, so that a reader never sees half of it."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    beside = p.with_suffix(p.suffix + ".new")
    beside.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
    beside.replace(p)


def migrated_mappings(maps: dict) -> dict:
    """Old mapping files kept manufacturers and suppliers apart; both are companies."""
    m = {k: dict(v) for k, v in maps.items()}
    companies = m.pop("manufacturers", {}) | m.pop("suppliers", {})
    m["companies"] = companies | m.get("companies", {})
    return {k: m.get(k, {}) for k in ("stores", "brands", "companies", "products")}


@dataclass
class Settings:
    """Options of a run. All of them hold everywhere."""

    source_folder: str = "data"
    output_folder: str = "merged"
    archive_folder: str = "archive"
    anonymize: bool = False
    categorize: bool = True
    match_names: bool = False
    match_threshold: float = 0.90
    aggregate_after_merge: bool = False
    target_categories: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Settings:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in read_json(path, {}).items() if k in known})

    def save(self, path: str) -> None:
        write_json(path, read_json(path, {}) | asdict(self))


def lines(iterator: Iterator[str]) -> Iterator[dict]:
    """Objects of JSON lines; broken lines are left out."""
    for line in iterator:
        try:
            yield json.loads(line)
        except ValueError:
            continue
