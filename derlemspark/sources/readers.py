"""Sources: JSON documents, PDF folders, crawl outputs, manifests, run summaries."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = "category string, subcategory string, source_url string, source_type string, source_id string, last_updated string, title string, doc_kind string, language string, contact_unit string, contact_info string"
DOCUMENT = f"content string, meta struct<{META.replace(' string', ':string')}>"
PAGE = "url string, title string, body_content string, char_count int, is_valid boolean, depth int, discovered_new_urls int, placeholder string"
CHARSETS = ("utf-8", "windows-1254", "iso-8859-9")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON arrays; entries without content are skipped, entries of another shape have null fields and go with them."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).filter(F.length(F.trim("content")) > 0)


def decoded(raw: Column, charsets: tuple[str, ...] = CHARSETS) -> Column:
    """Text of bytes in the first charset that fits; the last one with replacements."""

    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        out = []
        for b in values.to_pylist():
            text = None
            for c in charsets if b is not None else ():
                try:
                    text = b.decode(c)
                    break
                except UnicodeDecodeError:
                    continue
            out.append(b.decode(charsets[-1], "replace") if b is not None and text is None else text)
        return pa.array(out, pa.string())

    return run(raw)


def pdf_folder(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], folders: DataFrame | None = None) -> DataFrame:
    """path, content (pages joined by a blank line, empty pages dropped), pages, error; one file's failure stays in its row.

    extract turns the bytes of a file into its pages' texts (a PDF library of the caller's choice).
    folders (folder, category, doc_kind), if given, sets the defaults by the file's folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)

    @F.arrow_udf(T.StructType([T.StructField("content", T.StringType()), T.StructField("pages", T.IntegerType()), T.StructField("error", T.StringType())]))
    def run(values: pa.Array) -> pa.Array:
        rows = []
        for b in values.to_pylist():
            try:
                pages = [p for p in extract(b) if p and p.strip()]
                rows.append({"content": "\n\n".join(pages), "pages": len(pages), "error": None})
            except Exception as e:  # noqa: BLE001
                rows.append({"content": None, "pages": 0, "error": f"{type(e).__name__}: {e}"})
        return pa.array(rows, pa.struct([("content", pa.string()), ("pages", pa.int32()), ("error", pa.string())]))

    out = files.select("path", run("content").alias("r")).select("path", "r.*", F.element_at(F.split("path", "/"), -2).alias("folder"))
    return out.join(F.broadcast(folders), "folder", "left") if folders is not None else out  # a folder list is configuration


def crawl_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Saved crawl files, one row for each page, with the file's category and department."""
    schema = f"meta struct<task:string,category:string,department:string>, page_results array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in PAGE.split(', '))}>>"
    files = spark.read.schema(schema).option("multiLine", True).json(path)
    return files.select("meta.*", F.explode_outer("page_results").alias("p")).select("task", "category", "department", "p.*").filter("url is not null")


def manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """pdf_links of manifest files; paths that don't exist are tolerated."""
    jvm = spark._jvm.org.apache.hadoop.fs
    there = [p for p in paths if jvm.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(p))]
    link = "struct<url:string,resolved_url:string,text:string,filename:string,source_page:string,doc_kind:string,category:string>"
    schema = f"pdf_links array<{link}>"
    files = spark.read.schema(schema).option("multiLine", True).json(there) if there else spark.createDataFrame([], schema)
    return files.select(F.explode("pdf_links").alias("l")).select("l.*").withColumn("resolved_url", F.coalesce("resolved_url", "url"))


def run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """task, units, documents, valid, failed, chars of summary files."""
    schema = "task string, birimler array<struct<department:string,total_documents:int,total_valid:int,total_failed:int,total_chars:bigint>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("task", F.explode_outer("birimler").alias("b"))
    total = lambda c: F.coalesce(F.sum(f"b.{c}"), F.lit(0))
    return rows.groupBy("task").agg(F.count("b").alias("units"), total("total_documents").alias("documents"), total("total_valid").alias("valid"), total("total_failed").alias("failed"), total("total_chars").alias("chars"))
