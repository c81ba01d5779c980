import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.operators import canonical, passages
from lodestone.sources import blocks, feeds, modality, office, parsers


def kinds(text, kind, language=""):
    return [(b["type"], b["content"]) for b in parsers.parse("s", kind, text, language)]


def test_markdown():
    text = "# Guide\n\nFirst\nline\n\n## Part\n\n- a\n- b\n\n> said\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n```python\nx = 1\n```\n\n$$\ne\n$$\n\n# Next\nend"
    got = parsers.parse("s", "markdown", text)
    assert [b["type"] for b in got] == ["heading", "paragraph", "heading", "list", "quote", "table", "code", "equation", "heading", "paragraph"]
    assert got[5]["section_path"] == ["Guide", "Part"] and got[9]["section_path"] == ["Next"]
    assert json.loads(got[5]["structured"]) == {"headers": ["h", "i"], "rows": [["1", "2"]]}


def test_html():
    text = "<html><head><title>t</title></head><body><nav>skip</nav><h1>Top</h1><p>One <b>two</b></p><ul><li>x</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><pre>a\n b</pre><script>no</script><img src='i.png' alt='pic'>tail</body></html>"
    assert [k for k, _ in kinds(text, "html")] == ["heading", "paragraph", "list", "table", "code", "figure", "paragraph"]
    assert ("paragraph", "One two") in kinds(text, "html") and not any("skip" in c or "no" == c for _, c in kinds(text, "html"))


def test_json_keeps_exact_numbers_and_refuses_repeats():
    assert kinds('{"a": {"b": 1}, "c/d": [1]}', "json") == [("code", '{"a": {"b": 1}}'), ("code", '{"c/d": [1]}')]
    for text in ('{"n": 1e10000}', '{"n": 0.1234567890123456789012345678901234}', '{"n": ' + "9" * 10_000 + "}"):
        got = parsers.parse("s", "json", text)
        assert len(got) == 1 and got[0]["content"] == text and "source_lexical" in got[0]["structured"]
    for bad in ('{"a": 1, "a": 2}', "{", '{"a": NaN}'):
        with pytest.raises(ValueError):
            parsers.parse("s", "json", bad)


def test_deep_json_gives_its_leaves():
    value = "leaf"
    for i in range(60):
        value = {f"k/{i}": value}
    got = parsers.parse("s", "json", json.dumps(value))
    assert len(got) == 1 and json.loads(got[0]["content"]) == "leaf" and got[0]["structured"].count("dict") == 60


def test_yaml_xml_csv():
    got = parsers.parse("s", "yaml", "# note\na:\n  b: 1\nc: [1, 2]\n")
    assert [b["type"] for b in got] == ["quote", "code", "code"] and json.loads(got[1]["location"])["line_start"] == 2
    for bad in ("a: 1\na: 2\n", "a: &x 1\nb: *x\n"):
        with pytest.raises(ValueError):
            parsers.parse("s", "yaml", bad)
    assert kinds("<c><t>3</t></c>", "xml")[0][0] == "code"
    with pytest.raises(ValueError):
        parsers.parse("s", "xml", '<!DOCTYPE c [<!ENTITY e "x">]><c>&e;</c>')
    assert kinds("name,value\na,1\n", "csv") == [("table", "| name | value |\n| --- | --- |\n| a | 1 |")]
    with pytest.raises(ValueError):
        parsers.parse("s", "csv", 'a,b\n"1,2\n')


def test_code_mail_transcript_log_text():
    assert [k for k, _ in kinds("import os\n\n\n@d\ndef f():\n    pass\n\n\nclass C:\n    def g(self): pass\n", "code", "python")] == ["code", "heading", "code", "heading", "code"]
    assert "fn" not in kinds("fn main() {}", "code", "rust")[0][0] and json.loads(parsers.parse("s", "code", "fn main() {}", "rust")[0]["structured"])["symbols"][0]["name"] == "main"
    assert kinds("From: a@b.c\nSubject: Hi\n\nBody text\n", "email") == [("heading", "Hi"), ("paragraph", "Body text")]
    cues = parsers.parse("s", "transcript", "WEBVTT\n\n00:01.000 --> 00:05.000\n<v Ann>Hi\n\n1\n00:00:06,000 --> 00:00:10,000\nBye\n")
    assert [json.loads(b["location"]) for b in cues] == [{"time_start": 1.0, "time_end": 5.0}, {"time_start": 6.0, "time_end": 10.0}]
    assert len(kinds("2024-01-01T00:00:00Z a request_id=x\n  more\n2024-01-01 00:00:01 b\n", "log")) == 2
    assert kinds("one\n\ntwo\nthree\n", "text") == [("paragraph", "one"), ("paragraph", "two\nthree")]


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
DOCX = archive({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = archive({"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>', "xl/sharedStrings.xml": f"<sst {S}><si><t>head</t></si></sst>", "xl/worksheets/s.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>2</v></c></row><row><c r="A3"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>'})


def test_office():
    assert [e[0] for e in office.docx(DOCX)] == ["heading", "paragraph", "table"]
    sheet = list(office.xlsx(XLSX))[1]
    assert sheet[2]["headers"][0] == "head" and len(sheet[2]["headers"]) == 28 and sheet[3]["row_numbers"] == [3]


def test_inspection_refuses():
    for name, data in (("a.txt", b""), ("a.zip", b"x"), ("a.txt", b"\xff\xfe"), ("a.csv", b"one\n1\n"), ("a.docx", b"PK"), ("a.pdf", b"no"), ("a.eml", b"no header"), ("a.txt", b" \n")):
        with pytest.raises(modality.Unreadable):
            modality.inspect(name, data)
    assert modality.inspect("a.txt", b"\xef\xbb\xbf# Head\n\ntext")[0] == "markdown" and modality.inspect("a.txt", b"<html><p>x")[0] == "html" and modality.inspect("a.txt", b'{"a": 1}')[0] == "json"


def test_files_to_passages(spark, tmp_path):
    for name, data in (("a.md", b"# H\n\nSome text. More text."), ("b.docx", DOCX), ("c.csv", b"a,b\n" + b"".join(b"%d,%d\n" % (i, i) for i in range(400))), ("d.json", b"{bad"), ("e.txt", ("word " * 3000 + "end.").encode())):
        (tmp_path / name).write_bytes(data)
    found = blocks.read_files(spark, f"file://{tmp_path}")
    assert found.filter("error IS NOT NULL").count() == 1
    made = passages.packed(found)
    rows = made.collect()
    assert all(r["tokens"] <= passages.MOST for r in rows if not r["error"]) and len({r["passage_id"] for r in rows}) == len(rows)
    assert passages.unreconstructed(made, found).count() == 0
    table = sorted((s["start"], s["end"]) for r in rows if r["kind"] == "table" and r["id"].endswith("c.csv") for s in r["spans"])
    assert table[0][0] == 0 and table[-1][1] == 400 and all(a[1] == b[0] for a, b in zip(table, table[1:], strict=False))
    assert sorted(map(str, made.collect())) == sorted(map(str, rows))
    broken = made.withColumn("content", F.concat("content", F.lit("!")))
    assert passages.unreconstructed(broken, found).count() == len(rows)
    assert canonical.violations(found, canonical.relations(found)).count() == 0
    failed = {tuple(r["failures"]) for r in canonical.quality(found).filter("NOT passed").collect()}
    assert ("no_extractable_text", "parse_error") in {tuple(f for f in x if f != "excessive_repeated_content") for x in failed} and len(failed) == 1
    assert canonical.sections(found).filter("depth = 1").count() == 2


def test_too_large_files_give_an_error_row(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_bytes(b"short text")
    (tmp_path / "b.txt").write_bytes(b"long text " * 20)
    monkeypatch.setattr(modality, "MOST_BYTES", 50)
    got = {r["id"].rpartition("/")[2]: r["error"] for r in blocks.read_files(spark, f"file://{tmp_path}").collect()}
    assert got["a.txt"] is None and "more than 50 bytes" in got["b.txt"]


def test_parts_fit_and_cover():
    text = " ".join(f"Word{i} " * (i % 23) + f"end{i}." for i in range(400)) + "x" * 9000
    for overlap in (0, 40):
        got = passages.cut(text, "prose", 120, overlap)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        for (a, b, n, _), (c, d, *_) in zip(got, got[1:]):
            assert a < c <= b < d and n <= 121 and len(passages.approximate(text[a:b])) <= n and len(passages.approximate(text[c:b])) <= overlap
        assert all(text[b - 1].isspace() for _, b, _, whole in got[:-1] if whole) and not got[-2][3]
    code = "".join(f"def f{i}():\n    x = {i}\n    return x\n\n" for i in range(200))
    assert all(code[a:].startswith("def") for a, *_ in passages.cut(code, "code", 200, 0))


def test_long_blocks_take_linear_time():
    counted = []

    def count(text):
        counted.append(len(text))
        return passages.approximate(text)

    text = "One two three. " * 20_000
    block = {"block_id": "b", "content": text, "type": "paragraph", "section_path": [], "structured": None}
    assert len(passages.pack("s", [block], count)) > 100
    assert sum(counted) < 5 * len(text)


def test_runs_are_filled_in_order():
    assert passages.fill([3, 3, 3, 9, 1], 6) == [(0, 2), (2, 3), (3, 4), (4, 5)] and passages.fill([], 5) == []


def test_violations_are_found(spark):
    rows = blocks.parsed(spark.createDataFrame([("x", "markdown", "# A\n\none\n\ntwo")], "id string, modality string, text string"))
    bad = rows.withColumn("content", F.when(F.col("ordinal") == 1, "changed").otherwise(F.col("content"))).filter("ordinal <> 0")
    found = {r["rule"] for r in canonical.violations(bad, canonical.relations(rows)).collect()}
    assert {"content_hash", "ordinals_without_gaps"} <= found


def test_table_function(spark):
    blocks.register(spark)
    assert spark.sql("SELECT type FROM parse_blocks('s', 'text', 'a\n\nb')").count() == 2


def test_change_feed(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n:06}.json").write_text(json.dumps({"items": [{"id": f"{n}-{i}", "at": "2024-01-01T00:00:00+00:00", "removed": i == 1} for i in range(2)]}))
    feeds.register(spark)
    assert spark.read.format("change_feed").option("path", str(tmp_path)).load().filter("removed").count() == 3
    out, state = f"file://{tmp_path}/out", f"file://{tmp_path}/state"

    def run():
        spark.readStream.format("change_feed").option("path", str(tmp_path)).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 6
    (tmp_path / "000003.json").write_text(json.dumps({"items": [{"id": "new", "at": "2024-01-02T00:00:00+00:00"}]}))
    assert run() == 7


def test_pages_through_sparks_readers(spark, tmp_path):
    from lodestone.operators.manifest import KeyedTable

    (tmp_path / "feed").mkdir()
    for n in range(3):
        items = [{"id": f"r{i}", "version": str(n), "at": f"2024-01-0{n + 1}T00:00:00+00:00", "removed": n == 2 and i == 1} for i in range(3)]
        (tmp_path / "feed" / f"{n:06}.json").write_text(json.dumps({"items": items, "cursor": n}))
        os.utime(tmp_path / "feed" / f"{n:06}.json", (1_700_000_000 + 9 * n,) * 2)  # a file stream reads the oldest first
    (tmp_path / "feed" / "other.txt").write_text("no page")
    feeds.register(spark)
    folder = f"file://{tmp_path}/feed"
    plain = spark.read.format("change_feed").option("path", str(tmp_path / "feed")).load()
    assert sorted(map(str, feeds.read_pages(spark, folder).collect())) == sorted(map(str, plain.collect()))
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", "id string, version string, at timestamp", ["id"], buckets=2)

    def each(rows, batch):  # rows, tombstones and the place in the feed are published together
        table.upsert(rows.select("id", "version", "at", "removed"), ["at"], gone=F.col("removed"), newer=True, stream="feed", batch=batch, offset={"page": rows.agg(F.max("page")).first()[0]})

    feeds.stream_pages(spark, folder, 1).writeStream.foreachBatch(each).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["id"], r["version"]) for r in table.read().collect()) == [("r0", "2"), ("r2", "2")] and table.offset("feed") == {"page": 2}
    (tmp_path / "feed" / "000009.json").write_text(json.dumps({"items": [{"id": "x", "at": "2024-01-01T00:00:00"}]}))
    with pytest.raises(Exception, match="offset"):
        feeds.read_pages(spark, folder).collect()
