"""Links in robots.txt and sitemap.xml snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.url import abs_url


def robots_links(files: DataFrame) -> DataFrame:
    """(root, ref) of Allow and Disallow lines; 'name: value' needs the blank after the colon, other lines give nothing."""
    line = F.explode(F.split("content", r"\r?\n")).alias("line")
    rows = files.filter("kind = 'robots.txt' and content is not null").select("root", line)
    name, value = F.lower(F.substring_index("line", ": ", 1)), F.trim(F.regexp_replace("line", r"^.*?: ", ""))
    ok = F.contains("line", F.lit(": ")) & (F.startswith(name, F.lit("allow")) | (name == "disallow"))
    return rows.filter(ok).select("root", value.alias("ref"))


def sitemap_links(files: DataFrame) -> DataFrame:
    """(root, ref) of loc elements of url and sitemap entries, trimmed; broken files give what is whole in them."""
    rows = files.filter("kind = 'sitemap.xml' and content is not null")
    inner = F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<(?:\w+:)?(?:url|sitemap)>(.*?)(?=</(?:\w+:)?(?:url|sitemap)>|<(?:\w+:)?(?:url|sitemap)>|$)"), F.lit(1))).alias("entry")
    loc = F.regexp_extract("entry", r"(?s)<(?:\w+:)?loc>(.*?)</(?:\w+:)?loc>", 1)
    ref = F.regexp_replace(F.regexp_replace(F.regexp_replace(loc, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), "&amp;", "&"), r"<!\[CDATA\[|\]\]>", "")
    return rows.select("root", inner).select("root", ref.alias("ref")).filter("ref <> ''")


def known_links(files: DataFrame, which: str = "all") -> DataFrame:
    """(source, url, tag, attribute, depth): robotstxt, sitemapxml, or both for any other selector."""
    parts = []
    if which != "sitemapxml":
        parts.append(robots_links(files).withColumn("attribute", F.lit("robotstxt")))
    if which != "robotstxt":
        parts.append(sitemap_links(files).withColumn("attribute", F.lit("sitemapxml")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    base = F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"))
    return out.select(F.col("root").alias("source"), abs_url(base, "ref").alias("url"), F.lit("file").alias("tag"), "attribute", F.lit(2).alias("depth")).filter("url <> ''")
