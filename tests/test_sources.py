import http.server
import json
import tarfile
import threading
import urllib.parse
import zipfile

import pytest

from millrace.sources import files, sinks
from millrace.sources.excel import read_excel, sheet_metadata
from millrace.sources.rest import RestReader, auth_headers, read_rest, records_of


@pytest.mark.parametrize("sep", [",", ";", "\t", "|", ":"])
def test_csv_tells_its_delimiter(spark, tmp_path, sep):
    (tmp_path / "f.csv").write_text(f"id{sep} name {sep}note\n1{sep} ann {sep}\n2{sep}bob{sep}  x\n")
    got = files.read_csv(spark, str(tmp_path / "f.csv"))
    assert got.columns == ["id", "name", "note"]
    assert [tuple(r) for r in got.collect()] == [("1", "ann", None), ("2", "bob", "x")]


def test_encodings(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("id,name\n1,José\n".encode("latin-1"))
    assert files.read_csv(spark, str(tmp_path / "l.csv")).first().name == "José"
    assert files.detect_encoding([b"abc", "é".encode()]) == "UTF-8"
    assert files.detect_encoding([b"\xff\xfea\0"]) == "UTF-16"


def test_csv_checks(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text("a,b\n1,2\n1,2,3,4,5,6,7,8,9\n")
    got = files.check_csv(spark, str(path), path.stat().st_size).first()
    assert (got.named, got.sized, got.lines, got.even) == (True, True, 3, False)
    assert not files.check_csv(spark, str(path), 0).first().sized


def test_json_structures(spark, tmp_path):
    assert [files.json_structure(x) for x in (["[{}]"], ['{"a":1}', '{"a":2}'], ['{"a":', "1}"], ["x"], [])] == ["array", "jsonl", "object", "invalid", "invalid"]
    (tmp_path / "o.json").write_text('{"meta": 1,\n "tags": ["x", "y"]}')
    assert {tuple(r) for r in files.read_json(spark, str(tmp_path / "o.json")).select("_index", "value").collect()} == {(0, "x"), (1, "y")}
    (tmp_path / "p.json").write_text('{"a": {"b": [{"k": 1},\n {"k": 2}]}}')
    assert sorted(r.k for r in files.read_json(spark, str(tmp_path / "p.json"), json_path="a.b").collect()) == [1, 2]
    assert files.read_json(spark, str(tmp_path / "p.json"), json_path="a.c").count() == 0
    (tmp_path / "l.json").write_text('{"k": 1}\n{"k": 2}\n\n{"k": \n')
    assert sorted(r.k for r in files.read_json(spark, str(tmp_path / "l.json")).collect()) == [1, 2]
    with pytest.raises(ValueError, match="no JSON"):
        (tmp_path / "x.json").write_text("hello")
        files.read_json(spark, str(tmp_path / "x.json"))


def test_xml_tells_its_records(spark, tmp_path):
    assert files.row_tag(["<r><a/><b/><b/></r>"]) == "b"
    assert files.row_tag(["<r><list><x/><x/></list></r>"]) == "x"
    assert files.row_tag(["<r><a/></r>"]) == "r"
    (tmp_path / "f.xml").write_text('<n:shop xmlns:n="u"><n:item id="1"><name lang="en">ring</name><tag>a</tag><tag>b</tag></n:item><n:item id="2"><name>bolt</name></n:item></n:shop>')
    got = files.read_xml(spark, str(tmp_path / "f.xml")).orderBy("@id").collect()
    assert [r["@id"] for r in got] == [1, 2]
    assert got[0]["name"]["_text"] == "ring" and got[0]["name"]["@lang"] == "en" and got[0]["tag"] == ["a", "b"]


def workbook(path):
    sheet = lambda rows: '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + rows + "</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="People" sheetId="1" r:id="rId1"/><sheet name="Secret" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><r><t>An</t></r><r><t>na</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t> age </t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>41</v></c></row><row r="4"><c r="B4" t="b"><v>1</v></c></row>'))
        z.writestr("xl/worksheets/sheet2.xml", sheet('<row r="1"><c r="A1" t="str"><v>code</v></c></row><row r="2"><c r="A2" t="e"><v>#DIV/0!</v></c></row>'))


def test_dates_of_workbooks(spark, tmp_path):
    cells = "".join(f'<row r="{k + 1}"><c r="A{k + 1}" s="{style}"><v>{value}</v></c></row>' for k, (style, value) in enumerate([(0, 7), (1, 45292), (2, 45292.75), (3, 0.5), (0, 45292), (4, 12)]))
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="21"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>")
    got = [r["7"] for r in read_excel(spark, str(tmp_path / "d.xlsx")).orderBy("_row_number").collect()]
    assert got == ["2024-01-01 00:00:00", "2024-01-01 18:00:00", "12:00:00", "45292", "12"]


def test_json_lines_that_do_not_parse_are_told(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": {"c": "x"}}\n\n{"a": 2\n{"a": 3}\nnonsense\n')
    good, bad = files.read_json_lines(spark, str(tmp_path / "x.jsonl"))
    assert sorted((r.a, r.b and r.b.c) for r in good.collect()) == [(1, "x"), (3, None)]
    assert sorted(r.line for r in bad.collect()) == ["nonsense", '{"a": 2'] and all(r.file.endswith("x.jsonl") for r in bad.collect())


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    path = str(tmp_path / "w.xlsx")
    got = [tuple(r) for r in read_excel(spark, path).orderBy("_row_number").collect()]
    assert got == [("Anna", "41", "People", 2), (None, "true", "People", 4)]
    assert read_excel(spark, path, ["Secret"], hidden=True).first().code == "#DIV/0!"
    assert read_excel(spark, path, ["Nobody"]).count() == 0
    assert {(r.sheet_name, r.hidden, r.rows, r.columns) for r in sheet_metadata(spark, path).collect()} == {("People", False, 4, 2), ("Secret", True, 2, 1)}
    assert files.read(spark, "spreadsheet.xlsx", path).count() == 2


class Service(http.server.BaseHTTPRequestHandler):
    busy = 1

    def do_GET(self):  # noqa: N802
        q = {k: int(v[0]) for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        if Service.busy and q.get("page") == 2:
            Service.busy -= 1
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        rows = [{"id": i, "who": self.headers.get("Authorization", "")} for i in range(7)]
        at = (q["page"] - 1) * q["per_page"] if "page" in q else q.get("offset", q.get("cursor", 0))
        size = q.get("per_page", q.get("limit", 100))
        body = {"items": rows[at : at + size], "next_cursor": at + size if at + size < 7 else None}
        raw = json.dumps(body).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/rows"
    server.shutdown()


@pytest.mark.parametrize("options", [{}, {"pagination": "offset", "pages": 3, "pageSize": 3}, {"pagination": "page", "pages": 4, "pageSize": 2}, {"pagination": "cursor", "pageSize": 2}])
def test_services(spark, service, options):
    got = read_rest(spark, service, "id long, who string", auth="bearer", token="t", **options).collect()
    assert sorted(r.id for r in got) == list(range(7))
    assert {r.who for r in got} == {"Bearer t"} and got[0]._api_source == service


def test_service_helpers():
    assert auth_headers({"auth": "basic", "user": "a", "password": "b"}) == {"Authorization": "Basic YTpi"}
    assert auth_headers({"auth": "api_key", "key": "k"}) == {"X-API-Key": "k"} and auth_headers({}) == {}
    assert records_of({"data": {"rows": [1, 2]}}, "data.rows") == [1, 2]
    assert records_of({"x": 1}, None) == [{"x": 1}] and records_of([1], None) == [1] and records_of({"x": 1}, "y.z") == []


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.txt", "hello")
    (tmp_path / "y.txt").write_text("tar member")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        t.add(tmp_path / "y.txt", "y.txt")
    got = {r.member: bytes(r.content) for p in ("a.zip", "b.tar.gz") for r in files.read_archives(spark, str(tmp_path / p)).collect()}
    assert got == {"d/x.txt": b"hello", "y.txt": b"tar member"}


def test_kinds():
    assert [files.source_kind(x) for x in ("CSV", "text/csv; charset=utf-8", ".xlsx", "application/json", "text/xml", "parquet")] == ["csv", "csv", "excel", "json", "xml", "parquet"]
    with pytest.raises(ValueError, match="no source"):
        files.source_kind("papyrus")


def test_report(spark):
    page = sinks.report_html(spark.sql("SELECT '<b>' AS name, cast(NULL AS int) AS n"), "A & B")
    assert "&lt;b&gt;" in page and "A &amp; B" in page and "<td></td>" in page


class Paged(http.server.BaseHTTPRequestHandler):
    """23 records; the path tells how the service behaves."""

    def do_GET(self):  # noqa: N802
        at = urllib.parse.urlparse(self.path)
        q = {k: int(v[0]) for k, v in urllib.parse.parse_qs(at.query).items()}
        size = min(q.get("per_page", q.get("limit", 100)), 3 if at.path == "/capped" else 100)
        start = (q["page"] - 1) * size if "page" in q else q["offset"]
        start = min(start, 20) if at.path == "/clamped" else start
        body = {"items": [{"id": i} for i in range(23)][start : start + size]}
        body |= {"/flag": {"has_more": start + size < 23}, "/total": {"total_count": 23}, "/next": {"next_page": 1 if start + size < 23 else None}}.get(at.path, {})
        if not body["items"]:
            body = {"message": "no more"} if at.path == "/words" else body
        self.send_response(404 if at.path in ("/missing", "/flag", "/next") and not body.get("items") else 200)
        self.end_headers()
        self.wfile.write(json.dumps(body["items"] if at.path == "/list" else body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def paged():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Paged)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


@pytest.mark.parametrize("pagination", ["offset", "page"])
@pytest.mark.parametrize("path", ["plain", "list", "flag", "next", "total", "capped", "missing", "words", "clamped"])
@pytest.mark.parametrize("pages", [None, 2])
def test_services_are_read_to_their_end(paged, path, pagination, pages):
    reader = RestReader({"path": paged + path, "pagination": pagination, "pagesize": "5"} | ({"pages": str(pages)} if pages else {}))
    got = [json.loads(r)["id"] for p in reader.partitions() for _, r in reader.read(p)]
    assert sorted(got) == list(range(23))
    assert len(reader.partitions()) == (pages or (5 if path == "total" else 1))


def test_services_without_pages_given(spark, paged):
    assert sorted(r.id for r in read_rest(spark, paged + "total", "id long", pagination="offset", pageSize=5).collect()) == list(range(23))
    with pytest.raises(ValueError, match="alike"):
        reader = RestReader({"path": paged + "plain", "pagination": "page", "pagename": "p", "pagesize": "23"})
        reader._place = lambda at: {"offset": 0, "limit": 23}
        list(reader.read(reader.partitions()[0]))


def test_csv_keeps_values_with_line_breaks(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('id,note,n\n1,"first\nsecond, ""x""\n\nlast",5\n2,plain,6\n')
    assert [tuple(r) for r in files.read_csv(spark, str(path)).collect()] == [("1", 'first\nsecond, "x"\n\nlast', "5"), ("2", "plain", "6")]
    assert files.read_csv(spark, str(path), multi_line=True).count() == 2 and files.read_csv(spark, str(path), ",", "UTF-8", True).count() == 2
    (tmp_path / "e.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path / "e.csv"), ",").count() == 0


def test_csv_encoding_is_told_from_the_whole_file(spark, tmp_path):
    lines = ["id,name", *(f"{i},ann" for i in range(50)), "50,José"]
    for name, encoding in (("l.csv", "latin-1"), ("u.csv", "utf-8"), ("w.csv", "utf-16")):
        (tmp_path / name).write_bytes("\n".join(lines).encode(encoding))
        got = {r.id: r.name for r in files.read_csv(spark, str(tmp_path / name)).collect()}
        assert len(got) == 51 and got["50"] == "José"


def test_csv_folder_of_several_kinds(spark, tmp_path):
    folder = tmp_path / "of all%20 kinds"
    for k, (text, encoding) in enumerate([("1,José", "latin-1"), ("2,José", "utf-8"), ('3,"a\nb"', "utf-8"), ('4,"é\nb"', "latin-1"), ("5,plain", "utf-8")]):
        (folder / f"day={k % 2}").mkdir(parents=True, exist_ok=True)
        (folder / f"day={k % 2}" / f"[{k}] x%41.csv").write_bytes(f"id,name\n{text}\n".encode(encoding))
    got = sorted((r.id, r.name, r.day) for r in files.read_csv(spark, str(folder), ",").collect())
    assert got == [("1", "José", "0"), ("2", "José", "1"), ("3", "a\nb", "0"), ("4", "é\nb", "1"), ("5", "plain", "0")]
