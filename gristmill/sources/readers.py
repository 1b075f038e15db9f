"""Readers that bring mixed-format files into DataFrames, and writers for what comes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gristmill.functions.text import decode_text, format_of, mail_body, mail_subject, strip_html


def read_csv(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """All columns as trimmed text; headers trimmed, short rows filled with nulls, blank rows dropped.

    ``comment`` opens lines to skip.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
                        mode="PERMISSIVE", **({"comment": comment} if comment else {}))
    df = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])
    return df.filter(F.concat_ws("", *[F.col(f"`{c}`") for c in df.columns]) != "")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """``timestamp, value`` of a telemetry file with ``#`` comment lines; values that are no numbers are left out."""
    df = read_csv(spark, path, comment="#")
    return df.select("timestamp", F.col("value").try_cast("double").alias("value")).filter("value is not null")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """One record per line; a line that does not parse is an error where ``strict``, else left out."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def broken_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """``path, line``: the lines of JSON-lines files that do not parse."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*fields.fields, T.StructField("_broken", T.StringType())])
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line")).filter("trim(line) <> ''")
    parsed = F.from_json("line", marked, {"columnNameOfCorruptRecord": "_broken"})
    return lines.filter(parsed["_broken"].isNotNull()).select("path", "line")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_master(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a plant file: machines with their codenames, lines and programs."""
    machine = "array<struct<id:string,codename:string,type:string,line:string,line_codename:string,program:string>>"
    m = spark.read.schema(f"plant string, machines {machine}").json(path, multiLine=True).select(F.inline("machines"))
    node = lambda c, kind, alias: m.filter(F.col(c).isNotNull()).select(
        F.col(c).alias("id"), F.lit(kind).alias("type"), F.array_compact(F.array(F.lower(alias))).alias("aliases"), F.array(F.input_file_name()).alias("sources"))
    nodes = node("id", "machine", "codename").unionByName(node("line", "line", "line_codename")).unionByName(node("program", "program", "program"))
    edge = lambda c, rel: m.filter(F.col(c).isNotNull()).select(F.col("id").alias("src"), F.lit(rel).alias("rel"), F.col(c).alias("dst"))
    return nodes.distinct(), edge("line", "ON_LINE").unionByName(edge("program", "RUNS_PROGRAM")).distinct()


def csv_text(content: Column) -> Column:
    """The text of a delimited file with the cells of a row joined by `` | ``, blank rows left out.

    Rows are cut at line breaks outside quotes, cells at commas outside quotes.
    """
    row = F.regexp_extract_all(content, F.lit(r'(?:"(?:[^"]|"")*"|[^"\n])+'), F.lit(0))
    cells = lambda r: F.regexp_extract_all(F.concat(r, F.lit(",")), F.lit(r'((?:"(?:[^"]|"")*"|[^",])*),'), F.lit(1))
    quoted = lambda c: F.replace(F.regexp_replace(F.trim(c), r'^"|"$', ""), F.lit('""'), F.lit('"'))
    plain = lambda c: F.trim(F.when(F.trim(c).rlike(r'(?s)^".*"$'), quoted(c)).otherwise(c))
    lines = F.transform(row, lambda r: F.array_join(F.transform(cells(r), plain), " | "))
    return F.array_join(F.filter(lines, lambda line: F.regexp_replace(line, r"[\s|]+", "") != ""), "\n")


def json_text(content: Column) -> Column:
    """The values of a JSON text as compact text with one form of blanks; what does not parse stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(content)), content)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, format, title, text, error`` of every file under a folder, by its format.

    HTML loses its markup, mails their quotes and signatures, CSV becomes lines of cells joined by
    `` | ``, JSON compact text. Office and PDF files, which need libraries of their own, have a null text and the reason. Files are
    read whole, each within one task.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    typed = raw.select("path", format_of(F.col("path"), F.col("content")).alias("format"), decode_text(F.col("content")).alias("raw"))
    known, c = ~F.col("format").isin("docx", "xlsx", "pdf"), F.col("raw")
    text = F.when(F.col("format") == "html", strip_html(c)).when(F.col("format") == "eml", mail_body(c)).when(F.col("format") == "csv", csv_text(c))
    text = text.when(F.col("format") == "json", json_text(c)).otherwise(c)
    return typed.select(
        "path", "format", F.when(F.col("format") == "eml", mail_subject(c)).alias("title"), F.when(known, text).alias("text"),
        F.when(~known, F.concat(F.lit("no reader for "), "format")).alias("error"),
    )


def split_documents(df: DataFrame, mark: str = r"(?im)^=+\s*DATASHEET\b.*$", text: str = "text") -> DataFrame:
    """Files that hold several documents taken apart at marker lines: ``df`` with ``part`` (from 1) and one text each."""
    parts = F.filter(F.transform(F.split(text, mark), F.trim), lambda t: F.regexp_replace(t, r"\s+", "") != "")
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(parts).alias("part", text)).withColumn("part", F.col("part") + 1)


def write_csv(df: DataFrame, path: str) -> None:
    """Lists joined by ``;``, booleans as true and false, everything else as text."""
    flat = [
        F.array_join(f.name, ";").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name).cast("string").alias(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')
