"""Feed readers: RSS, news sitemaps, HTML lists, a JSON API, mail, JSON lines, and a paged range source.

Payloads are read as whole files by Spark's own readers and parsed by Spark's
XML and JSON functions; only HTML lists and MIME need Python, in Arrow batches.
All give ``source_id, position, title, url, published, summary`` with at most
``cap`` entries a payload; entries without title or link are dropped.
"""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CAP = 20
SCHEMA = "source_id string, position bigint, title string, url string, published timestamp, summary string"
_RSS = "channel struct<item:array<struct<title:string,link:string,description:string,pubDate:string>>>"
_MAP = "url array<struct<loc:string,lastmod:string,news:struct<title:string,publication_date:string>>>"


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """``source_id, body``: whole text files, the file's name without ending as the source."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z]+)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("source_id"), F.regexp_replace("value", "^﻿", "").alias("body"))


def _numbered(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """Blank entries go, a payload's repeated links go after the first, positions count from 1."""
    good = rows.where("trim(coalesce(title, '')) <> '' and trim(coalesce(url, '')) <> ''")
    first = W.partitionBy("source_id", "url").orderBy("seq")
    order = W.partitionBy("source_id").orderBy("seq")
    unique = good.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return unique.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= cap).select(
        "source_id", "position", F.trim("title").alias("title"), F.trim("url").alias("url"), F.col("published").cast("timestamp").alias("published"), "summary")


def mail_time(text: Column) -> Column:
    """RFC-2822 time, else ISO time, else null."""
    bare = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    zone = F.regexp_replace(F.regexp_replace(bare, r"\s*(GMT|UTC|UT|Z)$", " +0000"), r"\s+", " ")
    return F.coalesce(F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def rss(bodies: DataFrame, cap: int = CAP) -> DataFrame:
    """RSS 2.0; a payload whose root isn't ``rss`` gives nothing."""
    parsed = bodies.where(F.col("body").rlike(r"(?s)^\s*(<\?xml[^>]*>)?\s*(<!--.*?-->\s*)*<rss[\s>]")).select("source_id", F.from_xml("body", _RSS).alias("x"))
    items = parsed.select("source_id", F.posexplode("x.channel.item").alias("seq", "i"))
    return _numbered(items.select("source_id", "seq", F.col("i.title").alias("title"), F.col("i.link").alias("url"), mail_time(F.col("i.pubDate")).alias("published"), F.regexp_replace(F.coalesce("i.description", F.lit("")), "<[^>]*>", " ").alias("summary")), cap)


def sitemap(bodies: DataFrame, prefix: str | None = None, skip: str = r"(?i)summary$|OFR", cap: int = CAP) -> DataFrame:
    """A news sitemap: publication date, else lastmod; optional path prefix; some titles skipped."""
    plain = bodies.select("source_id", F.regexp_replace("body", r"(</?)news:", "$1").alias("body"))
    items = plain.select("source_id", F.posexplode(F.from_xml("body", _MAP)["url"]).alias("seq", "i"))
    rows = items.select("source_id", "seq", F.col("i.news.title").alias("title"), F.col("i.loc").alias("url"), mail_time(F.coalesce("i.news.publication_date", "i.lastmod")).alias("published"), F.lit("").alias("summary"))
    rows = rows.where(~F.coalesce(F.col("title").rlike(skip), F.lit(False)))
    if prefix:
        rows = rows.where(F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1).startswith(prefix))
    return _numbered(rows, cap)


def json_api(bodies: DataFrame, cap: int = CAP) -> DataFrame:
    """A JSON list, or an object with the list under Data, data or items; Chinese morning/afternoon times."""
    item = "array<struct<Title:string,URL:string,PublishDate:string,Description:string>>"
    inner = F.coalesce(*[F.get_json_object("body", f"$.{k}") for k in ("Data", "data", "items")])
    # an object read as a list would be one empty entry
    whole = F.from_json(F.when(F.ltrim("body").startswith("["), F.col("body")).otherwise(inner), item)
    items = bodies.select("source_id", F.posexplode(whole).alias("seq", "i"))
    return _numbered(items.select("source_id", "seq", F.col("i.Title").alias("title"), F.col("i.URL").alias("url"), half_day_time(F.col("i.PublishDate")).alias("published"), F.col("i.Description").alias("summary")), cap)


def half_day_time(text: Column) -> Column:
    """``2026/7/17 下午 04:48:00`` as local time: afternoon adds 12 hours except at 12, morning 12 is 0."""
    pattern = r"^(\d{4})/(\d{1,2})/(\d{1,2})\s*(上午|下午)?\s*(\d{1,2}):(\d{2})(?::(\d{2}))?"
    n = lambda i: F.expr("try_cast('0' as int)") if i is None else F.regexp_extract(text, pattern, i).try_cast("int")
    hour = F.when(F.regexp_extract(text, pattern, 4) == "下午", F.pmod(n(5), F.lit(12)) + 12).when(F.regexp_extract(text, pattern, 4) == "上午", F.pmod(n(5), F.lit(12))).otherwise(n(5))
    return F.try_make_timestamp(n(1), n(2), n(3), hour, n(6), F.coalesce(n(7), F.lit(0)).cast("decimal(8,6)"))


class _Links(HTMLParser):
    """Anchors with text inside elements of one class, and the last <time> seen before each."""

    def __init__(self, marker: str):
        super().__init__()
        self.marker, self.depth, self.href, self.text, self.time, self.found, self.in_time = marker, 0, None, [], "", [], False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.depth or not self.marker or self.marker in (a.get("class") or "").split():
            self.depth += tag not in ("br", "img", "meta", "link", "input", "hr")
        if tag == "a" and (self.depth or not self.marker):
            self.href, self.text = a.get("href"), []
        if tag == "time":
            self.in_time, self.time = True, a.get("datetime") or ""

    def handle_endtag(self, tag):
        if tag == "a" and self.href:
            self.found.append((" ".join(" ".join(self.text).split()), self.href, self.time))
            self.href = None
        self.in_time = self.in_time and tag != "time"
        self.depth = max(0, self.depth - 1) if self.depth else 0

    def handle_data(self, data):
        if self.href:
            self.text.append(data)
        elif self.in_time and not self.time:
            self.time = data.strip()


def html_list(bodies: DataFrame, marker: str = "", cap: int = CAP) -> DataFrame:
    """Links of an HTML list page, within elements of class ``marker`` if one is named."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                p = _Links(marker)
                p.feed(r.body or "")
                rows += [(r.source_id, i, t, u, when) for i, (t, u, when) in enumerate(p.found)]
            yield pd.DataFrame(rows, columns=["source_id", "seq", "title", "url", "when"])

    rows = bodies.select("source_id", "body").mapInPandas(parse, "source_id string, seq long, title string, url string, when string")
    return _numbered(rows.withColumn("published", mail_time(F.col("when"))).withColumn("summary", F.lit("")), cap)


#: Link words of newsletters that aren't articles, and caps of a message walk.
BOILERPLATE = re.compile(r"(?i)^(unsubscribe|view in browser|manage preferences|privacy|terms|contact us|advertise|subscribe|read more|sign up)\b")
MAX_PARTS, MAX_BYTES = 50, 2 << 20


def newsletter(bodies: DataFrame, cap: int = CAP) -> DataFrame:
    """Links of a mail message: HTML parts first, else bare links of plain ones; attachments and nested mails are skipped."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                message = email.message_from_string(r.body or "", policy=email.policy.default)
                html, plain, size = [], [], 0
                for n, part in enumerate(message.walk()):
                    if n >= MAX_PARTS or size > MAX_BYTES:
                        break
                    kind = part.get_content_type()
                    if part.get_content_disposition() == "attachment" or kind == "message/rfc822" or kind not in ("text/html", "text/plain"):
                        continue
                    body = part.get_content()
                    size += len(body)
                    (html if kind == "text/html" else plain).append(body)
                found = []
                if html:
                    p = _Links("")
                    p.feed("\n".join(html))
                    found = [(t, u) for t, u, _ in p.found]
                else:
                    for block in re.split(r"\n\s*\n", "\n".join(plain)):
                        link = re.search(r"https?://\S+", block)
                        if link:
                            found.append((" ".join(block[: link.start()].split()), link[0]))
                rows += [(r.source_id, i, t, u, message.get("Date")) for i, (t, u) in enumerate(found) if t and not BOILERPLATE.match(t)]
            yield pd.DataFrame(rows, columns=["source_id", "seq", "title", "url", "when"])

    rows = bodies.select("source_id", "body").mapInPandas(parse, "source_id string, seq long, title string, url string, when string")
    return _numbered(rows.withColumn("published", mail_time(F.col("when"))).withColumn("summary", F.lit("")), cap)


class PagedSource(DataSource):
    """A Python data source for sources that come in numbered pages: one partition a page, retried by Spark.

    Options: ``pages`` and ``rows``; a subclass overrides ``fetch``.
    """

    @classmethod
    def name(cls) -> str:
        return "newsloom_pages"

    def schema(self) -> str:
        return "page int, position int, url string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self)

    def fetch(self, page: int) -> Iterator[tuple]:
        for i in range(int(self.options.get("rows", "10"))):
            yield page, i, f"https://example.org/{page}/{i}"


class _PageReader(DataSourceReader):
    def __init__(self, source: PagedSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(int(self.source.options.get("pages", "1")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.source.fetch(partition.value)
