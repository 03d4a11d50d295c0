"""Cleaning of page text as projections, and the running headers of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import DOI, squeezed

# Section badges, headings at which a body starts, the citation mark, names of journals.
BADGES = "ORIGINAL ARTICLE|KLİNİK ÇALIŞMA|KLINIK CALISMA|ORIGINAL INVESTIGATION|REVIEW ARTICLE|CASE REPORT"
LINE_BADGES = BADGES + "|EDITORIAL|SPECIAL REPORT"
BODY_STARTS = "ABSTRACT|ÖZET|SUMMARY|GİRİŞ|INTRODUCTION"
CITE = "Cite this article as:"
JOURNALS = r"ARCHIVES OF [^.\n]+|JOURNAL OF [^.\n]+|ANATOLIAN JOURNAL OF [^.\n]+|TURKISH SOCIETY OF [^.\n]+|[A-Za-z\s]+ JOURNAL|[A-Za-z\s]+ ARŞİVİ"


def doi(text: Column) -> Column:
    """The first DOI without trailing full stops, commas and semicolons; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, DOI, 0), "[.;,]+$", ""), F.lit(""))


def citation(text: Column) -> Column:
    """What follows the citation mark, over lines until a heading; white space runs as one space; null without one."""
    found = F.regexp_extract(text, rf"(?iU){CITE}\s*([^\r\n]+(?:\r?\n(?!\s*(?:ABSTRACT|ÖZET|DOI|Received|Accepted|\d{{4}}))[^\r\n]+)*)", 1)
    return F.nullif(squeezed(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


def citation_parts(cite: Column) -> tuple[Column, Column]:
    """Authors and journal: the first, and the third (or, of exactly two, a second of more than three characters) part between full stops."""
    parts = F.filter(F.transform(F.split(cite, r"\."), squeezed), lambda x: x != "")
    second = F.try_element_at(parts, F.lit(2))
    return F.try_element_at(parts, F.lit(1)), F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(3))).when((F.size(parts) == 2) & (F.length(second) > 3), second)


def banner_journal(text: Column) -> Column:
    """A journal name in the first four filled lines; null without one."""
    lines = F.slice(F.filter(F.split(text, r"\r?\n"), lambda x: x != ""), 1, 4)
    return F.nullif(squeezed(F.regexp_replace(F.regexp_extract(F.array_join(lines, " "), f"(?iU)({JOURNALS})", 1), r"\s+", " ")), F.lit(""))


def header_line(line: Column) -> Column:
    """The line without page numbers and dashes at its ends, white space runs as one space."""
    bare = F.regexp_replace(squeezed(line), r"(^\s*\d+[\s\-–]*|[\s\-–]*\d+\s*$)", "")
    return F.regexp_replace(squeezed(bare), r"\s+", " ")


def drop_caps(text: Column) -> Column:
    """A capital letter set apart joins the word after it, real one-letter words included."""
    return F.regexp_replace(text, r"\b([A-Z])\s+([a-z]{2,})\b", "$1$2")


def without_badges(text: Column) -> Column:
    """Section badges on lines of their own become a line feed, inline ones go; blanks run as one, trimmed."""
    t = F.regexp_replace(text, rf"(?iU)(^|\n|\r)\s*({LINE_BADGES})\s*($|\n|\r)", "\n")
    t = F.regexp_replace(t, rf"(?iU)\b({BADGES})\b", "")
    return squeezed(F.regexp_replace(t, r"[ \t]+", " "))


def body_start(text: Column) -> Column:
    """From the first abstract or introduction heading, or after the line of the citation mark, else unchanged."""
    at = F.regexp_instr(text, F.lit(rf"(?iU)(^|\n|\r)\s*({BODY_STARTS})\b"))
    cite = F.regexp_instr(text, F.lit(f"(?i){CITE}"))
    feed = F.locate("\n", F.substring(text, cite, F.length(text)))
    return F.when(at > 1, squeezed(F.substring(text, at, F.length(text)))).when((cite > 0) & (feed > 0), squeezed(F.substring(text, cite + feed - 1, F.length(text)))).otherwise(text)


def page_metadata(docs: Column, file: Column, page_no: Column, pages: Column, scanned: Column, kind: str = "PDF") -> Column:
    """Metadata of a page: that of its document, and five keys of its own, which win."""
    own = F.create_map(F.lit("SourceFile"), file, F.lit("PageNumber"), page_no.cast("string"), F.lit("TotalPages"), pages.cast("string"), F.lit("FileType"), F.lit(kind), F.lit("IsScannedOrImageOnly"), F.when(scanned, "True").otherwise("False"))
    kept = F.map_filter(F.coalesce(docs, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("SourceFile", "PageNumber", "TotalPages", "FileType", "IsScannedOrImageOnly"))
    return F.map_concat(kept, own)


def fingerprints(pages: DataFrame, least: int = 10, times: int = 2) -> DataFrame:
    """file, header, n: normalised first two and last lines that occur so often among the pages (file, page_no, text) of a file."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: x != "")
    picked = pages.where(F.coalesce(squeezed(F.col("text")), F.lit("")) != "").select("file", lines.alias("l")).select("file", F.concat(F.slice("l", 1, 2), F.when(F.size("l") > 2, F.slice("l", -1, 1)).otherwise(F.array().cast("array<string>"))).alias("c"))
    norm = picked.select("file", F.explode("c").alias("line")).select("file", F.lower(header_line(F.col("line"))).alias("header"))
    return norm.where(F.length("header") >= least).groupBy("file", "header").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def strip_headers(pages: DataFrame) -> DataFrame:
    """file, page_no, text, removed: pages without leading lines up to the last of the first two that is a running header of the file."""
    heads = fingerprints(pages).groupBy("file").agg(F.collect_list("header").alias("heads"))
    j = pages.join(heads, "file", "left").withColumn("l", F.split("text", r"\r?\n"))
    norm = lambda i: F.lower(header_line(F.try_element_at("l", F.lit(i))))
    is_head = lambda i: F.coalesce((norm(i) != "") & F.exists("heads", lambda h: (h == norm(i)) | ((F.length(norm(i)) >= 15) & (F.contains(norm(i), h) | F.contains(h, norm(i))))), F.lit(False))
    removed = F.when(is_head(2), 2).when(is_head(1), 1).otherwise(0)
    return j.select("file", "page_no", F.when(removed > 0, F.array_join(F.slice("l", removed + 1, F.greatest(F.size("l"), F.lit(1))), "\n")).otherwise(F.col("text")).alias("text"), removed.cast("int").alias("removed"))
