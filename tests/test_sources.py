import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import readers
from quire.streaming.log import compact, follow, windowed_counts

HTML = "<html><head><title>Book</title><style>x{}</style></head><body><h1 id=a>One</h1><p>First<br>line<p>Second <b>bold</b><ul><li>item</ul><a href='b.xhtml#x'>l</a><script>no()</script></body></html>"


def test_json_and_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"prunedResult": {"parsing_res_list": [{"block_id": 1, "block_label": "text", "block_content": "x", "block_bbox": [0, 0, 1, 1]}]}}, {}]))
    assert readers.read_ocr_pages(spark, str(tmp_path / "p.json")).select("page_index", F.size("prunedResult.parsing_res_list")).collect()[0] == (0, 1)
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="not a list"):
        readers.read_ocr_pages(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int", strict=False).count() == 2
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int").collect()
    readers.write_jsonl(spark.range(3), str(tmp_path / "out"))
    readers.write_jsonl(spark.range(2), str(tmp_path / "out"), append=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_markdown(spark):
    df = spark.createDataFrame([("d", "# A\n<!-- PAGE 3 -->\ntext\n## B c\nPart II\n")], "k string, t string")
    assert [tuple(r)[2:] for r in readers.markdown_lines(df, "k", "t").orderBy("line_no").collect()] == [(1, "A", None), (2, "B c", 3), (0, "Part II", 3)]
    m = spark.createDataFrame([("d", 'x\n<!-- BOOK_SEGMENT {"id": 1} -->\na\n<!-- PAGE 2 -->\nb\n<!-- BOOK_SEGMENT {"id": 2} -->\nc')], "k string, t string")
    assert [(r.payload, r.body) for r in readers.marked_sections(m, "k", "t").orderBy("section").collect()] == [('{"id": 1}', "a\nb"), ('{"id": 2}', "c")]
    s = spark.createDataFrame([("b", 1, "heading", 1, "T", 1), ("b", 2, "footnote", None, "N", 1), ("b", 3, "list_item", None, "I", 2)], "book string, n int, kind string, level int, text string, page int")
    assert readers.render_markdown(s, "book", ["n"]).first().markdown == "## T\n\n<!-- PAGE 2 -->\n\n- I\n\nN"


def test_html(spark):
    df = spark.createDataFrame([("p", HTML), ("n", None), ("t", "just text")], "k string, h string")
    got = [(r.kind, r.level, r.text) for r in readers.html_blocks(df, "k", "h").where("k = 'p'").orderBy("position").collect()]
    assert got == [("heading", 1, "One"), ("paragraph", None, "First\nline"), ("paragraph", None, "Second bold"), ("list_item", None, "item")]
    assert [r.href for r in readers.html_links(df, "k", "h").where("element = 'a'").collect()] == ["b.xhtml#x"]
    assert readers.html_blocks(df, "k", "h").where("k = 't'").first().text == "just text"
    assert readers.resolve_member("a/b.opf", "../c%20d.html#x") == "c d.html" and readers.resolve_member("a", "http://x") is None and readers.resolve_member("a", "../../x") is None
    assert readers.decode_markup("é".encode("cp1252")) == "é" and readers.decode_markup("é".encode("utf-16")) == "é"


def test_epub(spark, tmp_path):
    def book(path, names):
        with zipfile.ZipFile(path, "w") as z:
            for n, t in names.items():
                z.writestr(n, t)

    opf = "<package xmlns='x'><manifest><item id='a' href='t/a.xhtml' media-type='application/xhtml+xml'/><item id='b' href='b.xhtml' media-type='application/xhtml+xml'/></manifest><spine><itemref idref='b'/><itemref idref='a'/></spine></package>"
    book(tmp_path / "ok.epub", {"mimetype": "application/epub+zip", "META-INF/container.xml": "<c><rootfiles><rootfile full-path='x.opf'/></rootfiles></c>", "x.opf": opf, "t/a.xhtml": "<p>A</p>", "b.xhtml": "<p>B</p>"})
    book(tmp_path / "bad.epub", {"../up": "x", "A": "x", "a": "x"})
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.epub"))
    spine = readers.epub_spine(files.where(F.col("path").endswith("ok.epub"))).orderBy("position").collect()
    assert [(r.href, r.markup) for r in spine] == [("b.xhtml", "<p>B</p>"), ("t/a.xhtml", "<p>A</p>")]
    problems = {(r.path[-8:], r.problem) for r in readers.unsafe_archives(readers.archive_members(files)).collect()}
    assert problems == {("bad.epub", "unsafe name"), ("bad.epub", "colliding names")}
    with pytest.raises(ValueError):
        readers.parse_xml(b"<!DOCTYPE a [<!ENTITY x 'y'>]><a/>")
    assert readers.parse_xml(io.BytesIO(b"<a><b/></a>").getvalue()).tag == "a"


def test_stream_keeps_the_last_row(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "k string, n long, v string"

    def put(name, rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip("knv", r))) + "\n" for r in rows))

    def run():
        compact(follow(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "t"), str(tmp_path / "c"), "k", "n").awaitTermination()
        last = max(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("version="))
        return {r.k: r.v for r in spark.read.parquet(str(tmp_path / "t" / last)).collect()}

    put("1.json", [("a", 1, "x"), ("b", 2, "y")])
    assert run() == {"a": "x", "b": "y"}
    put("2.json", [("a", 3, "z"), ("b", 1, "old")])
    assert run() == {"a": "z", "b": "y"}
    e = spark.createDataFrame([("2026-01-01 00:10:00", "k"), ("2026-01-01 00:50:00", "k")], "ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    assert windowed_counts(e, "ts", "kind").first().n == 2
