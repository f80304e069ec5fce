"""Delimited files as tables of text columns, with encoding and delimiter found from the head of the file."""

from __future__ import annotations

import contextlib
import csv
import importlib
import importlib.util
import io
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableproof.plans.cells import ROW
from tableproof.plans.rows import number_rows

#: Encodings tried in turn, delimiters looked for, and how much of a file is looked at.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
DELIMITERS = (",", ";", "\t", "|")
ENCODING_BYTES = 1_000_000
DELIMITER_CHARS = 65_536
BOM = b"\xef\xbb\xbf"
#: What Spark's reader calls the encodings it knows under another name.
SPARK_NAMES = {"utf-8-sig": "UTF-8", "utf_8": "UTF-8", "utf_8_sig": "UTF-8", "ascii": "UTF-8", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "latin_1": "ISO-8859-1"}
#: Encodings Spark's reader takes by itself. Others of one byte a character are read as ISO-8859-1 and translated.
NATIVE = {"UTF-8", "utf-8", "ISO-8859-1"}
LATIN = "".join(map(chr, range(128, 256)))
BEYOND = "_fields_beyond"


@dataclass
class CsvTable:
    df: DataFrame
    truncated: bool
    encoding: str
    delimiter: str


def _reads(data: bytes, encoding: str) -> bool:
    try:
        return data.decode(encoding) is not None
    except UnicodeDecodeError:
        return False


def _recognised(data: bytes) -> str | None:
    """What charset_normalizer makes of the bytes, where it is installed and makes something of them."""
    if importlib.util.find_spec("charset_normalizer") is None:
        return None
    match = importlib.import_module("charset_normalizer").from_bytes(data).best()
    return (match.encoding or None) if match else None


def detect_encoding(data: bytes, hint: str | None = None) -> str:
    """The hint; else by the byte order mark, by recognition, or the first of ENCODINGS that reads the bytes."""
    asked = "" if hint in (None, "auto") else hint
    marked = "utf-8-sig" if data[: len(BOM)] == BOM else ""
    return asked or marked or _recognised(data[:ENCODING_BYTES]) or next(name for name in ENCODINGS if _reads(data, name))


def sniff_delimiter(sample: str, hint: str | None = None) -> str:
    """The hint, else what the standard sniffer finds, else the most frequent delimiter (ties, and none: the first listed)."""
    if hint not in (None, "auto"):
        return hint
    with contextlib.suppress(csv.Error):
        return csv.Sniffer().sniff(sample, "".join(DELIMITERS)).delimiter
    return min(enumerate(DELIMITERS), key=lambda at: (-sample.count(at[1]), at[0]))[1]


def header_names(fields: list[str]) -> list[str]:
    """Names of the columns: blank ones by their place, repeated ones numbered."""
    seen: dict[str, int] = {}
    names: list[str] = []
    for i, name in enumerate(fields):
        name = name if name != "" else f"Unnamed: {i}"
        fresh = name
        while fresh in names:
            seen[name] = seen.get(name, 0) + 1
            fresh = f"{name}.{seen[name]}"
        names.append(fresh)
    return names


def _head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, by Spark's file systems: any store it reads will do."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(where).isDirectory():
        names = sorted(str(s.getPath().toString()) for s in system.listStatus(where) if not s.getPath().getName().startswith(("_", ".")))
        where = jvm.org.apache.hadoop.fs.Path(names[0])
    stream = system.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def read_csv(spark: SparkSession, path: str, *, max_rows: int | None = None, sep: str = "auto", encoding: str = "auto") -> CsvTable:
    """The file's rows as text columns with row_index. Short rows end in nulls; a row with too many fields is an error.

    A file is read in splits, unless a quoted field of it holds a line break; then it is one task, as the format doesn't
    allow more. One pass over the raw lines tells.
    """
    head = _head(spark, path, ENCODING_BYTES)
    if not head.strip():
        raise ValueError(f"{path} is empty")
    found = detect_encoding(head, encoding)
    text = head.decode(found, errors="replace")
    delimiter = sniff_delimiter(text[:DELIMITER_CHARS], sep)
    names = header_names(next(csv.reader(io.StringIO(text.lstrip("\ufeff")), delimiter=delimiter)))
    spark_name = SPARK_NAMES.get(found, found)
    upper = None if spark_name in NATIVE else _upper_half(found)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(BEYOND, T.StringType())])
    options = {"header": "true", "sep": delimiter, "quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": "", "mode": "PERMISSIVE", "enforceSchema": "true"}
    if spark_name in NATIVE or upper:
        whole = str(_breaks_in_quotes(spark, path)).lower()
        read = spark.read.schema(schema).options(**options, multiLine=whole, encoding="ISO-8859-1" if upper else spark_name).csv(path)
        rows = read.select(*[(F.translate(f"c{i}", LATIN, upper) if upper else F.col(f"c{i}")).alias(f"c{i}") for i in range(len(names))], BEYOND, "_metadata.file_path", "_metadata.file_block_start")
        table, beyond = _numbered(rows)
    else:
        rows = _decoded(spark, path, found, delimiter, len(names))
        table, beyond = number_rows(rows), not rows.where(F.col(BEYOND).isNotNull()).isEmpty()
    if beyond:
        raise ValueError(f"{path} has a row with more than {len(names)} fields")
    table = table.select(ROW, *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
    truncated = False
    if max_rows is not None:
        truncated = not table.where(F.col(ROW) >= max_rows).isEmpty()
        table = table.where(F.col(ROW) < max_rows)
    return CsvTable(table, truncated, found, delimiter)


def _breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field holds a line break: then the line it begins on has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def _upper_half(encoding: str) -> str | None:
    """The characters of bytes 128 to 255 in an encoding of one byte a character that extends ASCII; None for others."""
    try:
        if bytes(range(128)).decode(encoding) != "".join(map(chr, range(128))):
            return None
        chars = [bytes([b]).decode(encoding, errors="replace") for b in range(128, 256)]
        whole = bytes(range(128, 256)).decode(encoding, errors="replace")
    except (LookupError, UnicodeDecodeError):
        return None
    return whole if len(whole) == 128 and whole == "".join(chars) and whole.count("\ufffd") < 64 else None


def _numbered(rows: DataFrame) -> tuple[DataFrame, bool]:
    """rows with row_index in the order of files and of their splits, and whether one has too many fields."""
    key = ["file_path", "file_block_start"]
    marked = rows.withColumn("_at", F.monotonically_increasing_id())
    splits = marked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"), F.bool_or(F.col(BEYOND).isNotNull()).alias("beyond")).collect()  # a row a split
    at, offsets = 0, []
    for r in sorted(splits, key=lambda r: (r["file_path"], r["file_block_start"])):
        offsets.append((r["file_path"], r["file_block_start"], at - r["first"]))
        at += r["n"]
    shift = rows.sparkSession.createDataFrame(offsets, "file_path string, file_block_start long, _shift long")
    placed = marked.join(F.broadcast(shift), key)
    return placed.select((F.col("_at") + F.col("_shift")).alias(ROW), *[c for c in rows.columns if c.startswith("c")]), any(r["beyond"] for r in splits)


def _decoded(spark: SparkSession, path: str, encoding: str, delimiter: str, width: int) -> DataFrame:
    """Rows of a file in an encoding of several bytes that Spark's reader doesn't take: a file is decoded in one task."""
    import pandas as pd

    names = [f"c{i}" for i in range(width)] + [BEYOND]

    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                lines = csv.reader(io.StringIO(content.decode(encoding, errors="replace"), newline=""), delimiter=delimiter)
                next(lines, None)
                rows = [(row + [None] * (width - len(row)))[:width] + ["".join(row[width:]) or "beyond" if len(row) > width else None] for row in lines if row]
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, ", ".join(f"{n} string" for n in names))


def clean_text(df: DataFrame) -> DataFrame:
    """Every column as the text a clean file shows: True and False, empty for missing."""
    shown = [F.when(F.col(f"`{c}`"), "True").when(~F.col(f"`{c}`"), "False") if kind == "boolean" else F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if c != ROW]
    names = [c for c in df.columns if c != ROW]
    return df.select(ROW, *[F.coalesce(s, F.lit("")).alias(n) for s, n in zip(shown, names, strict=True)])


def write_csv(df: DataFrame, path: str, *, blocked: bool = False) -> None:
    """The table as delimited files in row order, with a header; refused while the dates' gate is closed."""
    if blocked:
        raise PermissionError("the export is blocked until the date warnings are resolved")
    clean_text(df).repartitionByRange(F.col(ROW)).sortWithinPartitions(ROW).drop(ROW).write.mode("errorifexists").option("header", "true").options(emptyValue="", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
