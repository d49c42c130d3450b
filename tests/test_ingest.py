"""Files to index: parsers, incremental sync, streaming, and small operators."""

import io
import shutil
import zipfile

import pytest
from larkspur.operators import ingest, rank, search, tracing
from larkspur.plans.settings import Settings
from larkspur.plans.sync import Store, sync
from larkspur.sources import files, ooxml, remote
from pyspark.sql import functions as F

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(*items):
    """Paragraphs as (style, text), tables as lists of rows."""
    body = ""
    for item in items:
        if isinstance(item, list):
            body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in item) + "</w:tbl>"
        else:
            style = f'<w:pPr><w:pStyle w:val="{item[0]}"/></w:pPr>' if item[0] else ""
            body += f"<w:p>{style}<w:r><w:t>{item[1]}</w:t></w:r></w:p>"
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("Title", "Title"), ("Heading1", "heading 1"), ("ListParagraph", "List Paragraph")))
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>"})


def xlsx():
    rows = [["Rate Card"], ["Effective: March 2026 | Version 2.0"], [], ["Tier", "Price", "Share"], ["Gold", ("1", "1234.5"), ("2", "0.155")], [], ["Term:", "Annual"], ["Seats", ("", "42.0")]]
    cells = ""
    for r, row in enumerate(rows, 1):
        cells += f'<row r="{r}">'
        for c, cell in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            cells += f'<c r="{ref}" t="inlineStr"><is><t>{cell}</t></is></c>' if isinstance(cell, str) else f'<c r="{ref}"' + (f' s="{cell[0]}"' if cell[0] else "") + f"><v>{cell[1]}</v></c>"
        cells += "</row>"
    sheet = lambda body: f"<worksheet {S}><sheetData>{body}</sheetData></worksheet>"
    styles = f'<styleSheet {S}><numFmts><numFmt numFmtId="170" formatCode="&quot;$&quot;#,##0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="10"/></cellXfs></styleSheet>'
    book = f'<workbook {S}><sheets>' + "".join(f'<sheet name="S{i}"/>' for i in range(1, 12)) + "</sheets></workbook>"
    parts = {f"xl/worksheets/sheet{i}.xml": sheet("") for i in range(2, 12)}
    return zipped({"xl/worksheets/sheet1.xml": sheet(cells), "xl/styles.xml": styles, "xl/workbook.xml": book, **parts})


def by_change(report):
    found = {}
    for r in report.orderBy("doc_id").collect():
        found.setdefault(r.change, []).append(r.doc_id)
    return found


def test_docx():
    p = ooxml.parse_docx(docx(("Title", "Travel"), ("", "Effective: May 1, 2026 | Version 3"), ("Heading1", "Scope"), ("ListParagraph", "item"), [["a", "b"], ["1", "2"]], ("", "2.1 Hotels")), "x")
    assert p.title == "Travel" and p.header.startswith("Effective")
    assert [(k, t) for k, t, _, _ in p.blocks] == [("title", "Travel"), ("text", "Effective: May 1, 2026 | Version 3"), ("heading", "Scope"), ("text", "- item"), ("table", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("heading", "2.1. Hotels")]
    assert p.plain.endswith("a | b\n1 | 2")


def test_xlsx():
    p = ooxml.parse_xlsx(xlsx(), "x")
    assert p.title == "Rate Card" and p.header.startswith("Effective")
    assert p.blocks[:5] == [("heading", "1. S1", 1, None), ("text", "Rate Card", 0, None), ("text", "Effective: March 2026 | Version 2.0", 0, None), ("table", "| Tier | Price | Share |\n| --- | --- | --- |\n| Gold | $1,234.50 | 15.50% |", 0, None), ("table", "- Term: Annual\n- Seats: 42", 0, None)]
    assert [t for k, t, _, _ in p.blocks if k == "heading"][-1] == "11. S11"  # parts go by number


def write(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def test_lifecycle(spark, tmp_path):
    root, store = tmp_path / "docs", Store(spark, str(tmp_path / "store"))
    rate = lambda price: docx(("Title", "Rate card"), ("Heading1", "Prices"), ("", f"Gold costs {price} a year."))
    write(root, "Sales/Pricing2025.docx", rate("$10"))
    write(root, "Sales/Pricing2026.docx", rate("$12"))
    write(root, "HR/Leave.xlsx", xlsx())
    write(root, "HR/~$Leave.xlsx", b"lock")
    write(root, "HR/Broken.docx", b"not a zip")
    report = by_change(sync(spark, str(root), store))
    assert report["new"] == ["HR/Leave.xlsx", "Sales/Pricing2025.docx", "Sales/Pricing2026.docx"] and report["failed"] == ["HR/Broken.docx"] and report["superseded"] == ["Sales/Pricing2025.docx"]
    read = lambda t: spark.read.parquet(f"{store.path}/{store.current()[1]}/{t}")
    first, vectors = {r.chunk_id: r.is_current for r in read("chunks").collect()}, sorted((r.cid, tuple(r.vector)) for r in read("vectors").collect())
    assert len(first) == len(vectors)
    # nothing changed: no chunk is made anew
    (root / "HR/Broken.docx").unlink()
    report = by_change(sync(spark, str(root), store))
    assert set(report) == {"unchanged"} and {r.chunk_id: r.is_current for r in read("chunks").collect()} == first
    # a successor arrives, one document goes: vectors of the others stay as they are
    write(root, "Sales/Pricing2027.docx", rate("$14"))
    (root / "HR/Leave.xlsx").unlink()
    report = by_change(sync(spark, str(root), store))
    assert report["new"] == ["Sales/Pricing2027.docx"] and report["deleted"] == ["HR/Leave.xlsx"] and report["superseded"] == ["Sales/Pricing2026.docx"]
    chunks = read("chunks").collect()
    assert {c.doc_id for c in chunks} == {f"Sales/Pricing{y}.docx" for y in (2025, 2026, 2027)}
    assert {c.doc_id for c in chunks if c.is_current} == {"Sales/Pricing2027.docx"}
    kept = {c.cid for c in chunks if "2027" not in c.doc_id}
    now = {(r.cid, tuple(r.vector)) for r in read("vectors").collect()}
    assert {v for v in vectors if v[0] in kept} <= now and {c.cid for c in chunks} == {c for c, _ in now}
    # the successor goes: its predecessor is reinstated
    (root / "Sales/Pricing2027.docx").unlink()
    report = by_change(sync(spark, str(root), store))
    assert report["reinstated"] == ["Sales/Pricing2026.docx"]
    # the kept index is that of the chunks as they are now
    from larkspur.operators import index

    built, kept = index.build(read("chunks"), "cid", "embed_text"), store.lexicon()
    assert {tuple(r) for r in kept.postings.select("cid", "term", "tf", "length").collect()} == {tuple(r) for r in built.postings.select("cid", "term", "tf", "length").collect()}
    assert {tuple(r) for r in kept.frequencies.collect()} == {tuple(r) for r in built.frequencies.collect()} and tuple(kept.stats.first()) == tuple(built.stats.first())


def test_stream(spark, tmp_path):
    from larkspur.streaming.ingest import watch

    root, store = tmp_path / "docs", Store(spark, str(tmp_path / "store"), "baseline")
    write(root, "IT/Guide.docx", docx(("Title", "Guide"), ("", "text " * 300)))
    settings = Settings(profile="baseline")
    watch(spark, str(root), store, str(tmp_path / "cp"), settings).awaitTermination()
    assert store.current()[0] == 1
    watch(spark, str(root), store, str(tmp_path / "cp"), settings).awaitTermination()
    assert store.current()[0] == 1  # nothing arrived
    chunks = store.read("chunks", "doc_id string, section_path string, department string")
    assert {r.department for r in chunks.collect()} == {"IT"} and chunks.filter("section_path like 'chars %'").count() == chunks.count()


def test_pdf_is_optional(spark, tmp_path):
    got = files.parse(spark.createDataFrame([("a.pdf", bytearray(b"%PDF")), ("b.txt", bytearray(b"x"))], "doc_id string, content binary")).collect()
    assert all(r.error for r in got) and "unsupported" in got[1].error


def test_pdf_page_layout():
    from larkspur.sources.pdf import Item, page_blocks, running_lines

    items = [Item(0, 0, 10, "line", "1. Scope"), Item(12, 0, 22, "line", "first"), Item(23, 0, 33, "line", "second"), Item(50, 0, 60, "line", "apart"), Item(61, 0, 62, "line", "•"), Item(61, 5, 71, "line", "point"), Item(80, 0, 90, "table", "| a |")]
    assert [(k, t) for k, t, _, _ in page_blocks(items, 1)] == [("heading", "1. Scope"), ("text", "first second"), ("text", "apart"), ("text", "- point"), ("table", "| a |")]
    assert running_lines([["Head line", "x", "Page 1 of 2"], ["Head line", "y", "Page 2 of 2"]]) == {"Head line", "Page 1 of 2", "Page 2 of 2"}
    assert running_lines([["Head line"]]) == set()


def test_scope_is_not_vacuous(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("department", F.col("lang"))
    assert docs.filter(search.scope(departments=[])).count() == 0
    inside = docs.filter(search.scope(departments=["en"])).count()
    assert 0 < inside < docs.filter(search.scope(exclude_doc_ids=[])).count()


def test_calibration_is_monotone_and_keeps_the_floor(spark):
    for method in ("llm", "lexical", "remote-semantic"):
        got = [r.c for r in spark.range(0, 41).orderBy("id").select(rank.calibrate(F.lit(method), F.col("id") / 4).alias("c")).collect()]
        assert got == sorted(got) and got[16] == 4.0


def test_width_guard(spark):
    vectors = spark.createDataFrame([([1.0, 2.0],)], "vector array<double>")
    ingest.check_width(vectors, 2)
    with pytest.raises(ValueError):
        ingest.check_width(vectors, 3)


def test_listing_and_report(spark):
    from larkspur.operators import ingest
    from pyspark.sql import functions as F

    manifest = spark.createDataFrame([("a", "HR"), ("b", "IT"), ("c", "HR")], "doc_id string, department string")
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "doc_id string, ordinal int")
    assert [(r.doc_id, r.chunks) for r in ingest.list_documents(manifest, chunks, F.col("department") == "HR").collect()] == [("a", 2), ("c", 0)]
    changes = spark.createDataFrame([("a", "new"), ("c", "new"), ("b", "deleted")], "doc_id string, change string")
    assert {tuple(r) for r in ingest.sync_report(changes).collect()} == {("new", 2, "a", "c"), ("deleted", 1, "b", "b")}


def test_remote_sink_retries_and_reports(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise remote.RemoteFailure(429)
        return "ok"

    waits = []
    assert remote.with_retry(flaky, waits.append) == "ok" and waits == [0.5, 1.0]
    with pytest.raises(remote.RemoteFailure):
        remote.with_retry(lambda: (_ for _ in ()).throw(remote.RemoteFailure(404)), waits.append)

    class Client:
        def push(self, actions):
            return [a["chunk_id"] for a in actions if a["chunk_id"].endswith("7")]

    rows = spark.range(250).select(F.col("id").cast("string").alias("chunk_id")).coalesce(1)
    result = remote.send(rows, "delete", Client).collect()
    assert sum(r.sent for r in result) == 250 and max(r.sent for r in result) <= 100 and sum(len(r.rejected) for r in result) == 25


def test_trace(spark):
    trace = tracing.Trace(spark)
    with pytest.raises(ValueError), trace.stage("search", k=5):
        raise ValueError
    with trace.stage("rerank") as noted:
        noted["n"] = 3
    rows = trace.table().orderBy("seq").collect()
    assert [(r.name, r.attrs) for r in rows] == [("search", {"k": "5"}), ("rerank", {"n": "3"})]
    health = tracing.Health(lambda: {"chunks": 1}, clock=iter([0, 1, 20, 20]).__next__)
    assert health.check()["reachable"] and health.check()["chunks"] == 1


def test_windows_cover_the_text(spark, tmp_path):
    shutil.rmtree(tmp_path, ignore_errors=True)
    from larkspur.operators.chunking import fixed_windows

    docs = spark.createDataFrame([(1, "a" * 512 + " " * 512 + "b"), (2, None), (3, " \n")], "doc_id long, text string")
    got = [(r.ordinal, r.section_path, len(r.text)) for r in fixed_windows(docs).orderBy("ordinal").collect()]
    assert got == [(0, "chars 0-512", 512), (2, "chars 1024-1025", 1)]
