"""Sources and sinks: JSON catalogs, CSV, XLSX names, JSON lines, file groups, exported documents."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_catalog(spark: SparkSession, path: str, entry: T.StructType | None = None) -> DataFrame:
    """The entries of one catalog file, one row each, with dataVersion, category and their place ``pos``; fails on bad JSON."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    if entry is not None:
        reader = reader.schema(T.StructType([T.StructField("dataVersion", T.StringType()), T.StructField("category", T.StringType()), T.StructField("entries", T.ArrayType(entry))]))
    df = reader.json(path)
    return df.select("dataVersion", "category", F.posexplode("entries").alias("pos", "entry")).select("dataVersion", "category", "pos", "entry.*")


def read_catalogs(spark: SparkSession, paths: dict[str, str], entries: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """Several catalogs by name; all fail together if one cannot be read."""
    out = {n: read_catalog(spark, p, (entries or {}).get(n)) for n, p in paths.items()}
    for df in out.values():
        df.limit(1).count()
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV with a header; quotes are doubled inside quotes, a byte-order mark is dropped."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def column_like(df: DataFrame, name: str) -> str:
    """The column of that name, else the first that begins with it."""
    for c in df.columns:
        if c == name:
            return c
    return next(c for c in df.columns if c.startswith(name))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; lines that cannot be parsed are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def xlsx_column(data: bytes, column: str = "A", sheet: int = 1) -> list[str]:
    """The texts of one column of a sheet."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in root.findall("m:si", ns)]
        out = []
        for c in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{{{ns['m']}}}c"):
            if re.fullmatch(column + r"\d+", c.get("r", "")):
                v, inline = c.find("m:v", ns), c.find("m:is", ns)
                if c.get("t") == "s" and v is not None:
                    out.append(shared[int(v.text)])
                elif inline is not None:
                    out.append("".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")))
                elif v is not None:
                    out.append(v.text or "")
        return out


def read_xlsx_names(spark: SparkSession, path: str, column: str = "A") -> DataFrame:
    """(path, pos, name) of the non-empty cells of a column, from every workbook at ``path``."""

    @F.udf("array<string>")
    def names(data):
        return [x.strip() for x in xlsx_column(bytes(data), column) if x.strip()]

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.posexplode(names("content")).alias("pos", "name"))


def complete_groups(files: DataFrame, path: str, pattern: str = r"block-times-(.+)-s(\d+)of(\d+)") -> DataFrame:
    """(stamp, shards, paths) of file groups all of whose numbered parts are there, the newest first."""
    part = lambda i: F.regexp_extract(path, pattern, i)
    f = files.select(F.col(path).alias("p"), part(1).alias("stamp"), part(2).alias("no"), part(3).alias("of")).where("stamp <> ''")
    g = f.groupBy("stamp", F.col("of").cast("int").alias("shards")).agg(F.count_distinct("no").alias("n"), F.array_sort(F.collect_set("p")).alias("paths"))
    return g.where("n = shards").drop("n").orderBy(F.desc("stamp"))


def newest_group(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The JSON lines of the newest complete group of timing files."""
    files = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("__path"))
    group = complete_groups(files.select("__path").distinct(), "__path").limit(1).select(F.explode("paths").alias("__path"))
    return files.join(F.broadcast(group), "__path", "left_semi").drop("__path")


INBOX = T.StructType([
    T.StructField("format", T.StringType()), T.StructField("race", T.StringType()), T.StructField("owner", T.StringType()), T.StructField("sentAt", T.StringType()),
    T.StructField("send", T.ArrayType(T.StringType())),
    T.StructField("persons", T.ArrayType(T.StructType([T.StructField("uma", T.StringType()), T.StructField("skills", T.MapType(T.StringType(), T.IntegerType()))]))),
])


def parse_inbox(df: DataFrame, text: str, form: str, most: int = 3) -> DataFrame:
    """Hand-off messages from JSON: null where they are corrupt or of another format; at most ``most`` persons, bad stars dropped."""
    m = F.from_json(text, INBOX)
    persons = F.transform(F.slice(m["persons"], 1, most), lambda p: p.withField("skills", F.map_filter(p["skills"], lambda k, v: v.isNotNull() & (v >= -1) & (v <= 3) & (v != 0))))
    return df.withColumn("message", F.when(m["format"] == form, m.withField("persons", persons)))


def export_document(df: DataFrame, parts: list[str]) -> DataFrame:
    """One JSON text per row; parts that are null are left out."""
    return df.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "true"}).alias("document"))


def write_rows(entries: list[dict], head: dict, old: str) -> str:
    """A catalog's text, one entry a line; refuses if ``old`` is not itself in that form, and keeps its line ends."""
    end = "\r\n" if "\r\n" in old else "\n"

    def text(h: dict, rows: list[dict]) -> str:
        lines = [f"  {json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}," for k, v in h.items()]
        body = [f"    {json.dumps(r, ensure_ascii=False)}" for r in rows]
        return end.join(["{", *lines, '  "entries": [', (f",{end}").join(body), "  ]", "}", ""])

    was = json.loads(old)
    if text({k: v for k, v in was.items() if k != "entries"}, was["entries"]) != old:
        raise ValueError("the file is not in canonical form")
    return text(head, entries)
