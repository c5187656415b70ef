"""Readers and writers: OCR pages, JSON lines, Markdown, HTML, archives, EPUB packages."""

from __future__ import annotations

import io
import posixpath
import unicodedata
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAGE_SCHEMA = "prunedResult struct<parsing_res_list: array<struct<block_id: string, block_order: string, block_label: string, block_content: string, block_bbox: array<double>>>>"


def read_ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of layout JSON files, each a list of pages: path, page_index, prunedResult. A file that is no list is an error."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    checked = text.withColumn("value", F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a list of pages: "), F.col("path")))))
    return checked.select("path", F.posexplode(F.from_json("value", f"array<struct<{PAGE_SCHEMA.replace(' ', ': ', 1)}>>")).alias("page_index", "p")).select("path", "page_index", "p.*")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines by schema: strict fails on a malformed line, otherwise such lines are skipped; blank lines never count."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; the commit protocol makes a write appear whole or not at all."""
    df.write.mode("append" if append else "overwrite").json(path)


def markdown_lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, level, title, page of the headings of Markdown texts.

    ``<!-- PAGE n -->`` marks carry the page on; a plain line "Part N" is a heading of level 0.
    """
    lines = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("line_no", "line"))
    mark = F.regexp_extract("line", r"<!--\s*PAGE(?:_JSON)?[ :=]*(\d+)\s*-->", 1).try_cast("int")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    paged = lines.withColumn("page", F.last(mark, True).over(w))
    level = F.when(F.col("line").rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract("line", r"^(#{1,6})", 1))).when(F.col("line").rlike(r"(?i)^part\s+(?:\d+|[ivxlcdm]+|one|two|three|four|five)\s*$"), 0)
    return paged.withColumn("level", level).where("level is not null").select(key, "line_no", "level", F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("title"), "page")


def marked_sections(documents: DataFrame, key: str, text: str, marker: str = r"^<!-- BOOK_SEGMENT (\{.*\}) -->$") -> DataFrame:
    """key, section, payload, body: texts split at hidden markers, page marks dropped."""
    lines = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("n", "line")).where(~F.col("line").rlike(r"^<!--\s*PAGE"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    cut = lines.withColumn("_m", F.col("line").rlike(marker)).withColumn("section", F.sum(F.col("_m").cast("int")).over(w)).where("section > 0")
    parts = F.array_sort(F.collect_list(F.when(~F.col("_m"), F.struct("n", "line"))))
    return cut.groupBy(key, "section").agg(
        F.max(F.when(F.col("_m"), F.regexp_extract("line", marker, 1))).alias("payload"), F.trim(F.array_join(F.transform(parts, lambda x: x["line"]), "\n")).alias("body")
    )


def render_markdown(segments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, markdown: segments of kinds heading, caption, quote, list_item, definition, footnote, table, paragraph as one text per key.

    segments: key, kind, level, text, page. Notes are collected at the end; a change of page leaves a comment.
    """
    t = F.col("text")
    line = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(2), F.least(F.lit(6), F.coalesce("level", F.lit(2))))), F.lit(" "), t))
        .when(F.col("kind") == "caption", F.concat(F.lit("*"), t, F.lit("*")))
        .when(F.col("kind") == "quote", F.concat(F.lit("> "), t))
        .when(F.col("kind") == "list_item", F.concat(F.lit("- "), t))
        .when(F.col("kind") == "definition", F.concat(F.lit("**"), t, F.lit("**")))
        .otherwise(t)
    )
    w = Window.partitionBy(key).orderBy(*order)
    turned = (F.col("page") != F.lag("page").over(w)) & (F.col("kind") != "footnote")
    rows = segments.where(t.isNotNull()).withColumn("_n", F.row_number().over(w)).withColumn("_l", F.when(turned, F.concat(F.lit("<!-- PAGE "), F.col("page").cast("string"), F.lit(" -->\n\n"), line)).otherwise(line))
    parts = F.array_sort(F.collect_list(F.struct((F.col("kind") == "footnote").alias("late"), F.col("_n").alias("n"), F.col("_l").alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n").alias("markdown"))


class _Blocks(HTMLParser):
    """Tolerant block extractor: the outermost block wins, unclosed tags end with the next block."""

    KINDS = {"p": "paragraph", "li": "list_item", "blockquote": "quote", "figcaption": "caption", "caption": "caption", "dt": "definition", "dd": "definition_body", "td": "table_cell", "th": "table_cell", "pre": "code"}
    ENDS = {"ul", "ol", "dl", "table", "tr", "body", "section", "div"}
    INNER = {"li", "dt", "dd", "td", "th", "p"}
    SKIP = {"script", "style", "noscript", "template", "math", "svg"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int | None, str]] = []
        self.links: list[tuple[str, str, str]] = []
        self.ids: list[str] = []
        self.loose: list[str] = []
        self.title: list[str] = []
        self.now: list | None = None
        self.skip = 0
        self.in_title = False

    def _close(self) -> None:
        if self.now:
            kind, level, parts, _ = self.now
            text = "\n".join(x for x in (" ".join(line.split()) for line in "".join(parts).split("\n")) if x)
            if text:
                self.blocks.append((kind, level, text))
        self.now = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if a.get("id"):
            self.ids.append(a["id"])
        for name in ("href", "src"):
            if a.get(name):
                self.links.append((tag, name, a[name]))
        if tag in self.SKIP:
            self.skip += 1
        if self.skip:
            return
        if tag == "title":
            self.in_title = True
        if tag == "br" and self.now:
            self.now[2].append("\n")
        level = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else None
        mark = f"{a.get('class', '')} {a.get('id', '')}".lower()
        if level is None and tag in ("p", "div") and any(x in mark for x in ("heading", "title", "chapter")):
            digit = next((c for c in mark if c in "123456"), "2")
            level = int(digit)
        kind = "heading" if level else self.KINDS.get(tag)
        if not kind:
            return
        if self.now and (self.now[3] in ("p", "h") or kind == "heading"):
            self._close()
        if not self.now:
            self.now = [kind, level, [], "h" if kind == "heading" else tag]

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP and self.skip:
            self.skip -= 1
        elif tag == "title":
            self.in_title = False
        elif self.now and tag in self.ENDS and self.now[3] in self.INNER:
            self._close()
        elif self.now and (tag == self.now[3] or self.now[3] == "h" and (tag[:1] == "h" or tag in ("p", "div"))):
            self._close()

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.in_title:
            self.title.append(data)
        elif self.now:
            self.now[2].append(data)
        elif data.strip():
            self.loose.append(data)


def _parsed(html: str) -> _Blocks:
    p = _Blocks()
    p.feed(html)
    p.close()
    p._close()
    if not p.blocks and (text := " ".join("".join(p.loose).split())):
        p.blocks.append(("paragraph", None, text))
    title = " ".join("".join(p.title).split())
    if title and not any(k == "heading" for k, _, _ in p.blocks):
        p.blocks.insert(0, ("heading", 2, title))
    return p


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, position, kind, level, text of the blocks of HTML pages; null pages have none."""

    @F.pandas_udf("array<struct<kind:string,level:int,text:string>>")
    def blocks(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [{"kind": k, "level": n, "text": t} for k, n, t in _parsed(x).blocks])

    return pages.select(key, F.posexplode(blocks(F.col(html))).alias("position", "b")).select(key, "position", "b.*")


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, element, attribute, href of the links of HTML pages."""

    @F.pandas_udf("array<struct<element:string,attribute:string,href:string>>")
    def links(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [{"element": e, "attribute": a, "href": h} for e, a, h in _parsed(x).links])

    return pages.select(key, F.explode(links(F.col(html))).alias("l")).select(key, "l.*")


def resolve_member(base: str, href: str) -> str | None:
    """Member name an href points to from a base member; None for remote links and ways out of the archive."""
    parts = urlsplit(href)
    if parts.scheme or parts.netloc or href.startswith("/"):
        return None
    name = posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(parts.path))) if parts.path else base
    return None if name.startswith("..") else unicodedata.normalize("NFC", name)


def decode_markup(data: bytes) -> str:
    """Text of a markup file: UTF-16 by its mark, UTF-8, Windows-1252, else with replacements."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for code in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def archive_members(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, position, name, size, packed, stored, problem for every member of ZIP archives (columns of binaryFile)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for where, data in zip(p["path"], p["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for i, m in enumerate(z.infolist()):
                        bad = m.filename.startswith("/") or "\\" in m.filename or ".." in m.filename.split("/") or any(ord(c) < 32 for c in m.filename)
                        link = m.external_attr >> 28 == 0xA
                        rows.append((where, i, unicodedata.normalize("NFC", m.filename), m.file_size, m.compress_size, m.compress_type == zipfile.ZIP_STORED, "unsafe name" if bad else "link" if link else None))
            yield pd.DataFrame(rows, columns=["path", "position", "name", "size", "packed", "stored", "problem"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, position int, name string, size long, packed long, stored boolean, problem string")


def unsafe_archives(members: DataFrame, entries: int = 10_000, file_bytes: int = 128 << 20, total_bytes: int = 1 << 30, ratio: float = 100.0) -> DataFrame:
    """path, problem for archives beyond the limits, with unsafe members, or with names that differ only in case."""
    fold = members.groupBy("path", F.lower("name").alias("_n")).agg(F.count("*").alias("_c")).where("_c > 1").select("path", F.lit("colliding names").alias("problem"))
    single = members.where("problem is not null").select("path", "problem")
    large = members.where((F.col("size") > file_bytes) | (F.col("size") > ratio * F.greatest(F.col("packed"), F.lit(1)))).select("path", F.lit("member too large").alias("problem"))
    whole = members.groupBy("path").agg(F.count("*").alias("_n"), F.sum("size").alias("_s")).where((F.col("_n") > entries) | (F.col("_s") > total_bytes)).select("path", F.lit("archive too large").alias("problem"))
    return fold.unionByName(single).unionByName(large).unionByName(whole).distinct()


def parse_xml(data: bytes, most_depth: int = 100) -> ElementTree.Element:
    """XML without document types or entities and within a depth."""
    text = decode_markup(data)
    if "<!DOCTYPE" in text.upper() and ("<!ENTITY" in text.upper() or "[" in text[text.upper().index("<!DOCTYPE") :].split(">")[0]):
        raise ValueError("document type with declarations")
    root = ElementTree.fromstring(text.encode() if not text.startswith("<?xml") else data)
    stack = [(root, 1)]
    while stack:
        node, depth = stack.pop()
        if depth > most_depth:
            raise ValueError("too deep")
        stack += [(x, depth + 1) for x in node]
    return root


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def epub_spine(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, position, href, media_type, markup of the reading order of EPUB files; a damaged spine falls back to the manifest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for where, data in zip(p["path"], p["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = set(z.namelist())
                    opf = None
                    if "META-INF/container.xml" in names:
                        opf = next((e.get("full-path") for e in parse_xml(z.read("META-INF/container.xml")).iter() if _tag(e) == "rootfile"), None)
                    opf = opf if opf in names else next((n for n in sorted(names) if n.endswith(".opf")), None)
                    if opf is None:
                        continue
                    root = parse_xml(z.read(opf))
                    items = {e.get("id"): (resolve_member(opf, e.get("href", "")), e.get("media-type", "")) for e in root.iter() if _tag(e) == "item"}
                    order = [items[e.get("idref")] for e in root.iter() if _tag(e) == "itemref" and e.get("idref") in items]
                    order = order or [x for x in items.values() if "html" in x[1]]
                    rows += [(where, i, href, kind, decode_markup(z.read(href))) for i, (href, kind) in enumerate(order) if href in names]
            yield pd.DataFrame(rows, columns=["path", "position", "href", "media_type", "markup"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, position int, href string, media_type string, markup string")


def content_key(c: Column) -> Column:
    """sha256 of a binary or string column."""
    return F.sha2(c, 256)
