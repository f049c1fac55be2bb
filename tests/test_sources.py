"""Document files, ontologies, providers, stages and reports on small inputs."""

import io
import zipfile
import zlib

import pytest

import __spark_entry__ as entry
from tessella.operators.ontology import TYPE, check_turtle, merged, parse_turtle, stats
from tessella.operators.providers import Providers, call_with_retry, extractive_answer, remote, with_provider
from tessella.plans.pipeline import Settings, combined, report, run_datasets, run_stages
from tessella.sources.documents import ascii_only, docx_text, first_folder, pdf_pages, read_documents
from tessella.sources.files import read_csv, read_json, write_csv


def pdf(*pages: bytes, compress=True) -> bytes:
    out = [b"%PDF-1.4"]
    for i, p in enumerate(pages):
        body = zlib.compress(p) if compress else p
        out.append(b"%d 0 obj <</Type /Page /Contents %d 0 R>> endobj" % (2 * i + 1, 2 * i + 2))
        out.append(b"%d 0 obj <<%s /Length %d>>\nstream\n%s\nendstream endobj" % (2 * i + 2, b"/Filter /FlateDecode" if compress else b"", len(body), body))
    return b"\n".join(out)


def docx(*paragraphs: str) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", "<w:document>" + "".join(f'<w:p w:x="1"><w:r><w:t xml:space="preserve">{p}</w:t></w:r></w:p>' for p in paragraphs) + "</w:document>")
    return buffer.getvalue()


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_pages(compress):
    content = pdf(rb"BT (Rated \(max\) ) Tj [(pow) -20 (er)] TJ 0 -12 Td <32342056> Tj ET", b"BT ET", rb"BT (P\141ge   two) Tj ET", compress=compress)
    assert pdf_pages(content) == ["Rated (max) power 24 V", "Page two"]
    assert pdf_pages(b"no pdf") == []


def test_folder_of_documents(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.pdf").write_bytes(pdf(b"BT (First) Tj ET", b"BT (Second) Tj ET"))
    (tmp_path / "a" / "b" / "two.DOCX".lower()).write_bytes(docx("One &amp; two", "", "three"))
    (tmp_path / "page.html").write_text("<p>Hi <b>there</b></p><script>x()</script>")
    (tmp_path / "bad.docx").write_bytes(b"broken")
    (tmp_path / "note.txt").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "skip.exe").write_bytes(b"x")
    got = {(r.path.rsplit("/", 1)[-1], r.page): r.text for r in read_documents(spark, str(tmp_path)).collect()}
    assert got == {("one.pdf", 1): "First", ("one.pdf", 2): "Second", ("two.docx", 1): "One & two\nthree", ("page.html", 1): "Hi there", ("note.txt", 1): "café �"}
    assert first_folder(spark, str(tmp_path / "none"), str(tmp_path / "a")) == str(tmp_path / "a")
    assert first_folder(spark, str(tmp_path / "a" / "b")) is None
    assert [r.text for r in ascii_only(spark.createDataFrame([("café",), ("é",)], "text string")).collect()] == ["caf"]
    assert docx_text(docx("x")) == "x"


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b", c\nd', None), (None, " x ", "")], "id string, t string, u string")
    write_csv(df, f"{tmp_path}/c", ["id", "t", "missing"])
    assert {tuple(r) for r in read_csv(spark, f"{tmp_path}/c", "id string, t string, missing string").na.fill("").collect()} == {("1", 'a "b", c\nd', ""), ("", " x ", "")}
    (tmp_path / "l.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in read_json(spark, f"{tmp_path}/l.json", "a int").collect()) == [1, 2]


def test_turtle(spark):
    text = '@prefix : <http://x#> .\n# note\n:A a :Class ; :label "an \\"A\\""@en , "b" .\n:p a :Property ; :of :A .'
    assert parse_turtle(text) == [("http://x#A", TYPE, "http://x#Class"), ("http://x#A", "http://x#label", 'an \\"A\\"'), ("http://x#A", "http://x#label", "b"), ("http://x#p", TYPE, "http://x#Property"), ("http://x#p", "http://x#of", "http://x#A")]
    assert check_turtle(text) == (True, "") and not check_turtle(":A a")[0] and not check_turtle("x:a a x:b .")[0] and check_turtle("")[0]
    assert {(r.type, r.n) for r in stats(merged(spark, [text, text, "?"])).collect()} == {("Class", 1), ("Property", 1)}


def test_retries():
    calls, pauses = [], []

    def limited():
        calls.append(1)
        if len(calls) < 4:
            raise RuntimeError("Error code: 429 rate limit")
        return "done"

    assert call_with_retry(limited, sleep=pauses.append) == "done" and pauses == [1, 2, 4]
    with pytest.raises(ValueError):
        call_with_retry(lambda: (_ for _ in ()).throw(ValueError("bad input")), sleep=pauses.append)
    calls.clear()
    with pytest.raises(RuntimeError):
        call_with_retry(lambda: (calls.append(1), (_ for _ in ()).throw(RuntimeError("timeout")))[1], sleep=lambda s: None)
    assert len(calls) == 6


def test_providers(spark):
    df = spark.createDataFrame([("What is the rated input voltage?", "Rated input voltage 24 V\nother"), ("What of it?", "Nothing here. It is of use."), (None, None)], "q string, t string")
    assert [r.a for r in df.select(extractive_answer(df.q, df.t).alias("a")).collect()] == ["Rated input voltage 24 V.", "Nothing here", ""]
    loud = with_provider(df, "t", "out", remote(lambda t: t.upper()))
    assert {r.out for r in loud.collect()} == {"RATED INPUT VOLTAGE 24 V\nOTHER", "NOTHING HERE. IT IS OF USE.", None}
    assert Providers().paraphrase is None


def test_stages_and_reports(spark, tmp_path):
    data, out = "/root/testdata/sf0.001", str(tmp_path)
    queries = entry.queries() | {"broken": lambda s, d: s.read.parquet(f"{d}/nothing")}
    stages = ["g2_global", "broken", "q6_audit", "q2_quality"]
    first = run_stages(spark, data, out, queries, stages, skip=["q2_quality"])
    assert first["g2_global"] == first["q6_audit"] == "done" and first["broken"].startswith("failed") and first["q2_quality"] == "skipped"
    assert run_stages(spark, data, out, queries, stages[:1])["g2_global"] == "reused"
    text = report(spark, out, "Run | one")
    assert "## g2_global" in text and "unavailable" in text and "| graph_walk |" in text
    assert "<table>" in report(spark, out, html=True)
    both = run_datasets(spark, {"x": data, "y": data}, f"{out}/many", queries, stages=["q6_audit"])
    assert both == {"x": {"q6_audit": "done"}, "y": {"q6_audit": "done"}}
    assert {r.dataset_name for r in combined(spark, f"{out}/many", ["x", "y", "z"], "q6_audit").collect()} == {"x", "y"}
    assert combined(spark, f"{out}/many", ["z"], "q6_audit").count() == 0


def test_settings():
    assert Settings.from_environment({"TESSELLA_TOP_K": "9", "TESSELLA_TIE": "0.1", "OTHER": "1"}) == Settings(top_k=9, tie=0.1)
