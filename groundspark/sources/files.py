"""File and text sources: registry rows, sections, quarantine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.functions.text import strip, title_case
from groundspark.operators.chunking import section_array
from groundspark.runtime import cut


def registry(files: DataFrame) -> DataFrame:
    """``(doc_id, title, filename, mime_type, file_size_bytes, checksum_sha256)`` of ``(path, content, title)``.

    The id is the content's SHA-256. A null title becomes the file's stem with underscores as spaces, in title case.
    """
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "_", " ")
    digest = F.sha2(F.col("content").cast("binary"), 256)
    return files.select(
        digest.alias("doc_id"), F.coalesce("title", title_case(stem)).alias("title"), name.alias("filename"), F.when(is_pdf(F.col("path")), "application/pdf").otherwise("text/markdown").alias("mime_type"),
        F.octet_length(F.col("content")).cast("long").alias("file_size_bytes"), digest.alias("checksum_sha256"),
    )


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def dedupe(batch: DataFrame, known: DataFrame | None, key: str = "checksum_sha256", order_col: str = "filename") -> DataFrame:
    """Rows of ``batch`` whose ``key`` is new: the first of each by ``order_col``, none that ``known`` has."""
    order = Window.partitionBy(key).orderBy(order_col)
    first = batch.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    return first if known is None else first.join(known.select(key).distinct(), key, "left_anti").select(*batch.columns)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content binary, title)`` of the files under a path; unreadable ones are skipped by the caller's options."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", F.lit(None).cast("string").alias("title"))


def texts_as_files(texts: DataFrame) -> DataFrame:
    """``(title, content)`` as files named after the lower-cased title; of equal names the last content by order of text counts."""
    named = texts.select(F.concat(F.regexp_replace(F.lower("title"), " ", "_"), F.lit(".md")).alias("path"), F.encode("content", "UTF-8").alias("content"), "title")
    order = Window.partitionBy("path").orderBy(F.desc("content"))
    return named.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def pdf_sections(pages: DataFrame) -> DataFrame:
    """Paragraphs of ``pages (doc_id, page_no, text)``: split at blank lines, crumb ``Page n``; a null page is empty."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"), strip), lambda p: p != "")
    return pages.select("doc_id", "page_no", F.posexplode(parts).alias("k", "text")).select(
        "doc_id", (F.col("page_no").cast("long") * 100000 + F.col("k")).alias("section_index"), "text", F.array(F.concat(F.lit("Page "), F.col("page_no").cast("string"))).alias("breadcrumbs"), F.col("page_no").alias("page_number")
    )


def _each_file(pdf_pages: Callable) -> Callable:
    """The extractor on one file at a time: a file on which it raises gives one row with the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.iloc[[i]]
                try:
                    found = [p[["doc_id", "page_no", "text"]].assign(reason=None) for p in pdf_pages(iter([one[["doc_id", "content"]]]))]
                except Exception as error:  # whatever an extractor makes of a broken file
                    found = [pd.DataFrame({"doc_id": one["doc_id"], "page_no": None, "text": None, "reason": f"PDF extractor: {error}"[:500]})]
                yield from (p.assign(path=one["path"].iloc[0]) for p in found)

    return run


def parse(files: DataFrame, pdf_pages: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Sections and quarantine of ``(path, content, title)``.

    Text is UTF-8 with bad bytes replaced. PDFs need ``pdf_pages``, a ``mapInPandas`` function from (doc_id, content) to
    (doc_id, page_no, text); it is called for one file at a time, and a file on which it raises goes to quarantine with the reason, alone.
    So do all PDFs without an extractor, and null contents. Of files with equal contents the first by path is read.
    """
    keyed = files.withColumn("doc_id", F.sha2("content", 256))
    usable = keyed.where("content is not null")
    plain = usable.where(~is_pdf(F.col("path"))).dropDuplicates(["doc_id"])
    text = F.make_valid_utf8(F.col("content").cast("string"))
    found = plain.select("doc_id", F.posexplode(section_array(text)).alias("section_index", "s")).select(
        "doc_id", F.col("section_index").cast("long").alias("section_index"), F.col("s.text").alias("text"), F.col("s.crumbs").alias("breadcrumbs"), F.lit(1).alias("page_number")
    )
    bad = keyed.where("content is null").select("path", F.lit("unreadable").alias("reason"))
    pdfs = usable.where(is_pdf(F.col("path")))
    if pdf_pages is None:
        bad = bad.unionByName(pdfs.select("path", F.lit("no PDF extractor").alias("reason")))
    else:
        once = pdfs.groupBy("doc_id").agg(F.min("path").alias("path"), F.first("content").alias("content"))
        pages = cut(once.mapInPandas(_each_file(pdf_pages), "path string, doc_id string, page_no int, text string, reason string"))
        found = found.unionByName(pdf_sections(pages.where("reason is null")))
        failed = pages.where("reason is not null").select("doc_id", "reason")
        bad = bad.unionByName(pdfs.join(failed, "doc_id").select("path", "reason"))
    return found, bad
