"""Reading invoice, vendor and contract files of unknown layout as columns of text, and writing results."""

from __future__ import annotations

import html
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODINGS = ["utf-8-sig", "cp1252", "latin-1"]
DELIMITERS = [",", ";", "\t", "|"]
#: Bytes of a file that are looked at to find its encoding and delimiter.
SAMPLE = 65_536


def sniff(sample: bytes, delimiters: list[str] = DELIMITERS) -> tuple[str, str]:
    """(encoding, delimiter) of a text table: the first pair that reads and splits the header; the best of the delimiters that do.

    A sample may end inside a character, so its last line is left out.
    """
    whole = sample.rsplit(b"\n", 1)[0] if b"\n" in sample else sample
    for encoding in ENCODINGS:
        try:
            first = whole.decode(encoding).splitlines()[:20]
        except UnicodeDecodeError:
            continue
        if not first:
            return encoding, delimiters[0]
        counts = {d: first[0].count(d) for d in delimiters}
        best = max(delimiters, key=lambda d: (counts[d], -delimiters.index(d)))
        if counts[best] or len(delimiters) == 1:
            return encoding, best
        return encoding, delimiters[0]
    return "latin-1", delimiters[0]


def _head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of a file, or of the first file of a folder, wherever it is stored; only they are read."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.globStatus(where) or []]
    if not found:
        raise FileNotFoundError(path)
    if fs.getFileStatus(found[0]).isDirectory():
        found = sorted((s.getPath() for s in fs.listStatus(found[0]) if not s.getPath().getName().startswith(("_", "."))), key=str)
    if not found:
        return b""
    stream = fs.open(found[0])
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def trimmed(df: DataFrame) -> DataFrame:
    """Headers and text without outer blanks; blank text is null."""
    return df.select([F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) if kind == "string" else F.col(f"`{c}`").alias(c.strip()) for c, kind in df.dtypes])


def _quoted_breaks(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether a line of the files has an odd number of quotes: a quoted value goes on in the next line."""
    lines = spark.read.option("encoding", encoding).text(path)
    return not lines.where(F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)) == 1).isEmpty()


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A delimited file or folder, all columns text. Encoding and delimiter come from a bounded sample.

    Files are split among tasks by lines, unless a quoted value holds a line break: then each file is read by one task.
    """
    encoding, found = sniff(_head(spark, path, SAMPLE), [delimiter] if delimiter else DELIMITERS)
    spark_name = {"utf-8-sig": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}[encoding]
    whole = _quoted_breaks(spark, path, spark_name)
    reader = spark.read.option("header", True).option("sep", delimiter or found).option("encoding", spark_name).option("multiLine", whole).option("escape", '"').option("inferSchema", False)
    df = reader.csv(path)
    return trimmed(df.toDF(*[c.removeprefix("\ufeff") for c in df.columns]))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, one object a line, an object whose first list of objects is the table, or one object; scalar columns become text.

    The form is told from the start of the file: `[` opens an array, whose objects are the rows as they are; an object that ends on its first line is
    one of many lines, which tasks share; of any other object the first field, in the order of the file, that is a list of objects is
    the table.
    """
    head = _head(spark, path, SAMPLE).decode("utf-8", "replace").lstrip("\ufeff \t\r\n")
    text = [x for x in head.splitlines() if x.strip()]
    lines = head.startswith("{") and len(text) > 1 and text[0].rstrip().endswith("}") and text[1].lstrip().startswith("{")
    df = spark.read.option("multiLine", not lines).option("primitivesAsString", True).json(path)
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if lists and head.startswith("{") and not lines:
        # the schema has the fields in the order of their names
        at = {c: m.start() for c in lists if (m := re.search(rf'"{re.escape(c)}"\s*:\s*\[', head))}
        df = df.select(F.inline(f"`{min(lists, key=lambda c: at.get(c, len(head)))}`"))
    return trimmed(df)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet, all columns text; needs a reader of such files on the driver."""
    import pandas as pd

    try:
        sheet = pd.read_excel(path, sheet_name=0, dtype=str, keep_default_na=False)
    except ImportError as e:
        raise RuntimeError("reading spreadsheets needs openpyxl, which is not installed") from e
    return trimmed(spark.createDataFrame(sheet.astype(str), ", ".join(f"`{c}` string" for c in sheet.columns)))


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table file by its ending: .csv, .tsv, .txt, .json, .parquet, .orc, .xlsx, .xls."""
    ending = Path(path.rstrip("/")).suffix.lower()
    readers = {
        ".csv": read_delimited, ".txt": read_delimited, ".tsv": lambda s, p: read_delimited(s, p, "\t"), ".json": read_json, ".xlsx": read_excel, ".xls": read_excel,
        ".parquet": lambda s, p: s.read.parquet(p), ".orc": lambda s, p: s.read.orc(p),
    }
    if ending not in readers:
        raise ValueError(f"unsupported file type: {ending or path}")
    return readers[ending](spark, path)


_RATE = "array<struct<item_description string, description string, unit string, rate string, unit_price string>>"
_TIER = "struct<threshold_quantity string, threshold string, discount_pct string>"
_CONTRACT = f"""vendor_id string, contract_start_date string, contract_start string, contract_end_date string, contract_end string, auto_renewal string, auto_renewal_notice_days string, payment_terms string,
  rates {_RATE}, contracted_items {_RATE}, volume_discounts array<{_TIER}>, volume_discount {_TIER}, scope_of_work array<string>, scope array<string>, annual_escalation_pct string, escalation_clause struct<max_annual_increase_pct string>"""


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Contracts from a JSON array of objects in one typed schema; either of the two names of a field is read."""
    from ledgersift.functions.dates import parse_date

    df = spark.read.schema(_CONTRACT.replace("\n", " ")).option("multiLine", True).json(path)
    rates = F.transform(F.coalesce("rates", "contracted_items"), lambda r: F.struct(F.coalesce(r["item_description"], r["description"], F.lit("")).alias("item_description"), F.coalesce(r["unit"], F.lit("ea")).alias("unit"), F.coalesce(r["rate"], r["unit_price"], F.lit("0")).try_cast("decimal(18,4)").alias("rate")))
    tiers = F.coalesce(F.when(F.size("volume_discounts") > 0, F.col("volume_discounts")), F.when(F.col("volume_discount").isNotNull(), F.array("volume_discount")), F.col("volume_discounts"))
    tiers = F.transform(tiers, lambda t: F.struct(F.coalesce(t["threshold_quantity"], t["threshold"], F.lit("0")).try_cast("int").alias("threshold_quantity"), F.coalesce(t["discount_pct"], F.lit("0")).try_cast("decimal(9,4)").alias("discount_pct")))
    return df.select(
        "vendor_id", parse_date(F.coalesce("contract_start_date", "contract_start")).alias("contract_start_date"), parse_date(F.coalesce("contract_end_date", "contract_end")).alias("contract_end_date"),
        F.coalesce(F.col("auto_renewal").try_cast("boolean"), F.lit(False)).alias("auto_renewal"), F.coalesce(F.col("auto_renewal_notice_days").try_cast("int"), F.lit(0)).alias("auto_renewal_notice_days"), F.coalesce("payment_terms", F.lit("")).alias("payment_terms"),
        F.coalesce(rates, F.array().cast("array<struct<item_description:string,unit:string,rate:decimal(18,4)>>")).alias("rates"), F.coalesce(tiers, F.array().cast("array<struct<threshold_quantity:int,discount_pct:decimal(9,4)>>")).alias("volume_discounts"),
        F.coalesce("scope_of_work", "scope", F.array().cast("array<string>")).alias("scope_of_work"), F.coalesce(F.col("annual_escalation_pct"), F.col("escalation_clause.max_annual_increase_pct")).try_cast("decimal(9,4)").alias("annual_escalation_pct"),
    )


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a result as parquet, json or csv (with a header), in as many files as it has partitions."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        nested = [c for c, k in df.dtypes if k.startswith(("array", "map", "struct"))]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(path)
    elif kind in ("parquet", "json", "orc"):
        getattr(writer, kind)(path)
    else:
        raise ValueError(f"unsupported kind: {kind}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new added or put in place of those with the same keys; of repeated keys in new the largest row, so that a repeated run gives the same."""
    rest = [c for c in new.columns if c not in keys]
    fresh = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]) if rest else new.distinct()
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def summary_json(df: DataFrame, path: str) -> None:
    """A report as one JSON file on the driver, a row at a time; write_table is for large results."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, r in enumerate(df.toLocalIterator()):
            out.write(",\n" if i else "\n")
            out.write(json.dumps(r.asDict(recursive=True), default=str))
        out.write("\n]\n")


def summary_html(df: DataFrame, path: str, title: str) -> None:
    """A report as a page with one table, written a row at a time."""
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    with open(path, "w", encoding="utf-8") as out:
        out.write(f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{''.join(cell('th', c) for c in df.columns)}</tr>")
        for r in df.toLocalIterator():
            out.write("<tr>" + "".join(cell("td", x) for x in r) + "</tr>\n")
        out.write("</table>")
