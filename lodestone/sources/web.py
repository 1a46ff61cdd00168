"""Web pages and markup: text, links, titles, as column expressions."""

from __future__ import annotations

from abc import ABC, abstractmethod
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

# Character references that occur in text, by name.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def html_text(html: Column) -> Column:
    """Text outside script and style, one piece a line, trimmed, split at double blanks, blank lines dropped."""
    bare = F.regexp_replace(html, "(?is)<(script|style)\\b[^>]*>.*?</\\1\\s*>", "\n")
    bare = F.regexp_replace(F.regexp_replace(bare, "(?s)<!--.*?-->", "\n"), "(?s)<[^>]+>", "\n")
    pieces = F.transform(F.split(unescape(bare), "\n|  "), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    return F.array_join(F.filter(pieces, lambda x: x != ""), "\n")


def section_texts(xml: str | None) -> str:
    """Texts of all section elements, nested ones too, then of all content elements, one block each; '' for what is no XML."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return ""
    found = (" ".join(" ".join(e.itertext()).split()) for e in [*root.findall(".//section"), *root.findall(".//content")])
    return "\n\n".join(t for t in found if t)


def xml_text(xml: Column) -> Column:
    """``section_texts`` in Arrow batches: nested elements are beyond a regular expression."""
    return arrow_udf(lambda c: pa.array([section_texts(x) for x in c.to_pylist()], pa.string()), "string")(xml)


def first_element(xml: Column, tag: str, default: str = "") -> Column:
    """Text of the first element of a kind, tags inside dropped."""
    found = F.regexp_extract(xml, f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>", 1)
    text = F.trim(unescape(F.regexp_replace(found, "<[^>]+>", "")))
    return F.when(text != "", text).otherwise(F.lit(default))


def links(pages: DataFrame, key: str, html: str = "html", url: str = "url", ending: str | None = None, most: int | None = None) -> DataFrame:
    """link_no, href, absolute and name of every link, or of those with an ending, at most the first ``most`` of a page."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit('(?i)<a\\b[^>]*\\bhref="([^"]*)"'), F.lit(1))
    if ending is not None:
        hrefs = F.filter(hrefs, lambda h: F.endswith(h, F.lit(ending)))
    if most is not None:
        hrefs = F.slice(hrefs, 1, most)
    base = F.regexp_extract(F.col(url), "^(https?://[^/?#]+)", 1)
    rows = pages.select(key, base.alias("__base"), F.posexplode(hrefs).alias("link_no", "href"))
    absolute = F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(F.concat("__base", "href"))
    return rows.select(key, "link_no", "href", absolute.alias("absolute"), F.regexp_extract(absolute, "[^/]+$", 0).alias("name"))


def document_id(text: Column, pattern: str = "(AC\\s\\d+-\\d+)") -> Column:
    return F.regexp_extract(text, pattern, 1)


def by_kind(files: DataFrame, readers: dict, name: str = "filename") -> DataFrame | None:
    """Rows dispatched by file ending to a reader (DataFrame to DataFrame), and joined again."""
    out = None
    for ending, reader in readers.items():
        part = reader(files.where(F.endswith(F.lower(name), F.lit(ending))))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


class Source(ABC):
    """A named place that documents come from; a subclass says how to read them."""

    name: str
    kind: str = "document"

    @abstractmethod
    def read(self, spark: SparkSession) -> DataFrame:
        """filename and text, and any further columns, of the documents that are there."""

    def documents(self, spark: SparkSession, **extra: str) -> DataFrame:
        """The documents with their metadata map: source, scrape_date, document_type, filename and what is given besides."""
        said = {"source": F.lit(self.name), "scrape_date": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "document_type": F.lit(self.kind), "filename": F.col("filename")}
        said |= {k: F.lit(v) for k, v in extra.items()}
        return self.read(spark).withColumn("metadata", F.create_map(*[x for k, v in said.items() for x in (F.lit(k), v.cast("string"))]))


def gathered(spark: SparkSession, sources: list[Source]) -> DataFrame | None:
    """The documents of all sources; columns that one lacks are null."""
    out = None
    for source in sources:
        rows = source.documents(spark)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
