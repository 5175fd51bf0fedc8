"""HTML pages as rows of blocks and links, by a table function over the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType

_BLOCKS = frozenset(("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "td", "th", "pre", "article", "div", "body"))
_CHROME = frozenset(("script", "style", "nav", "footer", "header", "aside", "form", "noscript", "title"))


class _Reader(HTMLParser):
    """Collects (type, text, level) blocks and (href, anchor) links outside of page furniture."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.links: list[tuple[str, str]] = []
        self.kind, self.text, self.hidden, self.anchor = "body", [], [], None

    def _close(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.kind, text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in _CHROME:
            self._close()
            self.hidden.append(tag)
        if self.hidden:
            if tag == "a":  # links count wherever they stand, but only leave placeholders in content
                self.links.append((dict(attrs).get("href") or "", ""))
            return
        if tag == "br":
            self.text.append(" ")
        if tag == "a":
            self.anchor = (dict(attrs).get("href") or "", len(self.text))
        if tag in _BLOCKS:
            self._close()
            self.kind = tag

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if tag == "a" and self.anchor:
            href, at = self.anchor
            self.links.append((href, " ".join("".join(self.text[at:]).split())))
            self.text.append(f" [[LINK_{len(self.links):04d}]]")
            self.anchor = None
        if tag in _BLOCKS:
            self._close()
            self.kind = "body"

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)

    @classmethod
    def read(cls, html: str | None) -> _Reader:
        r = cls()
        r.feed(html or "")
        r.close()
        r._close()
        return r


@udtf(returnType=StructType().add("ordinal", IntegerType()).add("block_type", StringType()).add("text", StringType()))
class HtmlBlocks:
    def eval(self, html: str):
        for i, (kind, text) in enumerate(_Reader.read(html).blocks, 1):
            yield i, kind, text


@udtf(returnType=StructType().add("occurrence", IntegerType()).add("placeholder", StringType()).add("raw_href", StringType()).add("anchor_text", StringType()))
class HtmlLinks:
    def eval(self, html: str):
        for i, (href, anchor) in enumerate(_Reader.read(html).links, 1):
            yield i, f"[[LINK_{i:04d}]]", href, anchor


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, ordinal, block_type, text of each block outside of navigation, scripts and the like; links leave placeholders."""
    pages.sparkSession.udtf.register("html_blocks", HtmlBlocks)
    pages.select("page_id", "html").createOrReplaceTempView("_pages_for_blocks")
    return pages.sparkSession.sql("SELECT page_id, b.* FROM _pages_for_blocks, LATERAL html_blocks(html) b")


def links(pages: DataFrame) -> DataFrame:
    pages.sparkSession.udtf.register("html_links", HtmlLinks)
    pages.select("page_id", "html").createOrReplaceTempView("_pages_for_links")
    return pages.sparkSession.sql("SELECT page_id, b.* FROM _pages_for_links, LATERAL html_links(html) b")


def headings(block_rows: DataFrame) -> DataFrame:
    """page_id, ordinal, heading_level, heading and heading_path: for each heading the texts of those it stands under, itself last."""
    h = block_rows.where(F.col("block_type").rlike("^h[1-6]$")).select("page_id", "ordinal", F.substring("block_type", 2, 1).cast("int").alias("heading_level"), F.col("text").alias("heading"))
    order = F.array_sort(F.collect_list(F.struct("ordinal", "heading_level", "heading")))
    start = F.struct(F.array().cast("array<struct<l:int,h:string>>").alias("stack"), F.array().cast("array<struct<o:int,l:int,h:string,p:array<string>>>").alias("out"))

    def step(acc, x):
        stack = F.concat(F.filter(acc["stack"], lambda s: s["l"] < x["heading_level"]), F.array(F.struct(x["heading_level"].alias("l"), x["heading"].alias("h"))))
        row = F.struct(x["ordinal"].alias("o"), x["heading_level"].alias("l"), x["heading"].alias("h"), F.transform(stack, lambda s: s["h"]).alias("p"))
        return F.struct(stack.alias("stack"), F.array_append(acc["out"], row).alias("out"))

    paths = h.groupBy("page_id").agg(order.alias("hs")).select("page_id", F.explode(F.aggregate("hs", start, step, lambda a: a["out"])).alias("r"))
    return paths.select("page_id", F.col("r.o").alias("ordinal"), F.col("r.l").alias("heading_level"), F.col("r.h").alias("heading"), F.col("r.p").alias("heading_path"))
