"""Readers: text, Word and web pages from binary files, markdown sections, JSON rules and gzipped tables, guides in markdown;
writers: documents with their sections, a history that is trimmed, snapshots of profiles, markdown."""

from __future__ import annotations

import gzip
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.operators.udfs import page_text

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


#: Suffixes that can be read (a PDF has no text here).
KINDS = ("docx", "html", "htm", "txt", "md", "pdf")


def docx_text(data: bytes) -> str:
    """The paragraphs of a Word file that aren't empty, a blank line between them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p"))
    return "\n\n".join(p for p in paragraphs if p.strip())


def file_text(path: str, data: bytes) -> str | None:
    """By suffix; PDF needs a library that isn't here, so such files have no text. Other suffixes are an error."""
    kind = path.rpartition(".")[2].lower()
    if kind not in KINDS:
        raise ValueError(f"no reader for {path}")
    if kind == "docx":
        return docx_text(data)
    if kind in ("html", "htm"):
        return page_text(data.decode(errors="replace"))
    return data.decode(errors="replace") if kind in ("txt", "md") else None


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of every file below a folder; files that can't be read have no text, so that one doesn't end the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [file_text(p, d) if p.rpartition(".")[2].lower() in KINDS else None for p, d in zip(b["path"], b["content"], strict=True)]})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_order, heading and text: cut at markdown headings, else at blank lines."""
    text = F.concat(F.lit("\n"), "text")
    heading = "\n[ \t]*#{1,4}\\s+(\\S[^\n]*)"
    # Bodies stand between headings; both are found in one pass over the text.
    bodies, heads = F.split(text, "\n[ \t]*#{1,4}\\s+\\S[^\n]*"), F.concat(F.array(F.lit("Section 1")), F.regexp_extract_all(text, F.lit(heading), 1))
    by_heading = F.filter(F.arrays_zip(heads.alias("heading"), bodies.alias("text")), lambda s: F.trim(F.regexp_replace(s["text"], "\\s+", " ")) != "")
    by_heading = F.transform(by_heading, lambda s: F.struct(F.trim(s["heading"]).alias("heading"), s["text"].alias("text")))
    parts = F.filter(F.split("text", "\n\\s*\n"), lambda p: F.trim(F.regexp_replace(p, "\\s+", " ")) != "")
    by_blank = F.transform(parts, lambda p, i: F.struct(F.concat(F.lit("Section "), (i + 1).cast("string")).alias("heading"), p.alias("text")))
    has = F.size(heads) > 1
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.when(has, by_heading).otherwise(by_blank)).alias("section_order", "s")).select("doc_id", "section_order", "s.heading", F.regexp_replace("s.text", "^\\s+|\\s+$", "").alias("text"))


def parse_version(v: str) -> tuple[int, ...]:
    """Versions compare as numbers."""
    return tuple(int(x) for x in re.findall(r"\d+", v))


def load_rules(text: str, defaults: dict) -> dict:
    """Rules from JSON over the defaults, section by section."""
    return defaults | {k: v for k, v in json.loads(text).items() if k in defaults}


def export_profile(profile: DataFrame, keys: list[str]) -> DataFrame:
    """O3: one JSON document for each profile."""
    rest = [c for c in profile.columns if c not in keys]
    return profile.groupBy(*keys).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rest)))).alias("elements"))


def import_profile(exported: DataFrame, keys: list[str], schema: str) -> DataFrame:
    return exported.select(*keys, F.inline(F.from_json("elements", f"array<struct<{schema}>>")))


def load_tables(data: bytes) -> dict:
    """A gzipped JSON table."""
    return json.loads(gzip.decompress(data))


def save_tables(tables: dict) -> bytes:
    """O5."""
    return gzip.compress(json.dumps(tables, separators=(",", ":")).encode())


def read_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_documents(docs: DataFrame, path: str) -> None:
    """O1: documents and their sections, as two tables."""
    docs.write.mode("append").parquet(f"{path}/documents")
    sections(docs).write.mode("append").parquet(f"{path}/sections")


def trimmed(history: DataFrame, now: str, days: int, most: int) -> DataFrame:
    """O2: of a history (id, ts, ..) what is younger than so many days, and of that the newest rows."""
    young = history.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    return young.orderBy(F.desc("ts"), F.desc("id")).limit(most)


def save_snapshot(profile: DataFrame, path: str, name: str) -> None:
    """A profile as it is now, under a name; an older one of that name is replaced."""
    profile.write.mode("overwrite").parquet(f"{path}/snapshot={name}")


def load_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/snapshot={name}")


def markdown(parts: DataFrame) -> DataFrame:
    """doc_id and markdown from sections (doc_id, section_order, heading, text, rewrite, status): an accepted rewrite stands for
    its text; headings that only number a section are left out."""
    body = F.when(F.col("status") == "accepted", F.col("rewrite")).otherwise(F.col("text"))
    titled = F.when(F.col("heading").rlike("^Section [0-9]+$"), body).otherwise(F.concat(F.lit("## "), "heading", F.lit("\n\n"), body))
    rows = F.sort_array(F.collect_list(F.struct("section_order", titled.alias("t"))))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n---\n\n").alias("markdown"))


def guide_rules(lines: DataFrame) -> DataFrame:
    """Rules from a guide in markdown (guide, line number, line): each bullet or table row with the part and heading above it."""
    above = Window.partitionBy("guide").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    part, head = F.regexp_extract("line", "^## PART ([0-9]+)", 1), F.regexp_extract("line", "^### (.+)$", 1)
    marked = lines.withColumn("part", F.last(F.when(part != "", part), ignorenulls=True).over(above))
    marked = marked.withColumn("heading", F.last(F.when(head != "", head).when(F.col("line").startswith("## "), F.lit("")), ignorenulls=True).over(above))
    rule = F.regexp_extract("line", "^\\s*[-*] +(.+)$", 1)
    return marked.where(rule != "").select("guide", "n", "part", "heading", rule.alias("rule"))
