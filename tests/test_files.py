"""File readers on files made here."""

from __future__ import annotations

import io
import zipfile
import zlib
from email.message import EmailMessage

import pytest

from corpusmill.sources import files


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val={s!r}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('h1')}</w:tc><w:tc>{p('h2')}</w:tc></w:tr><w:tr><w:tc>{p('a|b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr></w:tbl>"
    return zipped({"word/document.xml": f"<w:document {w}><w:body>{p('Title', 'Heading1')}{p('Text')}{table}</w:body></w:document>"})


def xlsx() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return zipped(
        {
            "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {ns}><si><t>name</t></si></sst>",
            "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
        }
    )


def zipped(members: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def mail() -> bytes:
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "a@x.org", "b@x.org", "Hello"
    m.set_content("First\n\nSecond")
    m.add_attachment(docx(), maintype="application", subtype="octet-stream", filename="d.docx")
    return m.as_bytes()


def test_read_files(spark, tmp_path):
    for name, raw in {"m.eml": mail(), "d.docx": docx(), "s.xlsx": xlsx(), "z.zip": zipped({"in/d.docx": docx(), "t.txt": "hi"}), "bad.docx": b"no", "x.bin": b"?"}.items():
        (tmp_path / name).write_bytes(raw)
    got: dict[str, list] = {}
    for r in files.read_files(spark, str(tmp_path)).orderBy("path", "ordinal").collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.source, r.kind, r.level, r.text))
    body = [("heading", 1, "Title"), ("paragraph", 0, "Text"), ("table", 0, "| h1 | h2 |\n|---|---|\n| a\\|b | c |")]
    assert [b[1:] for b in got["d.docx"]] == body
    assert [b[1:] for b in got["m.eml"] if b[1] != "header"] == [("paragraph", 0, "First"), ("paragraph", 0, "Second"), ("attachment", 0, "d.docx"), *body]
    assert got["s.xlsx"][1][3].startswith("| name | 2 |")
    assert [b[3] for b in got["z.zip"] if b[1] == "attachment"] == ["in/d.docx", "t.txt"] and ("root/1", "paragraph", 0, "hi") in got["z.zip"]
    assert got["bad.docx"][0][1] == "warning" and "x.bin" not in got
    cells = files.read_cells(spark, str(tmp_path)).collect()
    assert [(c.sheet, c.row, c.letters, c.value, c.formula) for c in cells] == [("S", 1, "A", "name", None), ("S", 1, "B", "2", "1+1")]


def test_archives_keep_their_limits():
    with pytest.raises(ValueError):
        files.safe_members(zipped({"../x": "a"}))
    with pytest.raises(ValueError):
        files.safe_members(zipped({f"m{i}": "" for i in range(files.MOST_MEMBERS + 1)}))
    assert len(files.safe_members(zipped({"a": "b"}))) == 1


def test_absent_cells_keep_their_columns(monkeypatch):
    monkeypatch.setattr(files, "xlsx_cells", lambda raw: [("s", 1, "A", "a", None), ("s", 1, "B", "b", None), ("s", 1, "C", "c", None), ("s", 2, "A", "4", None), ("s", 2, "C", "6", None)])
    assert files.xlsx_blocks(b"")[1][3].splitlines() == ["| a | b | c |", "|---|---|---|", "| 4 |  | 6 |"]


def test_nested_archives_share_one_limit(monkeypatch):
    raw = b"hi"
    for k in range(files.MOST_LEVELS + 1):
        raw = zipped({f"{k}.zip" if k else "a.txt": raw})
    assert [b[1] for b in files.parse("x.zip", raw)].count("warning") == 1
    two = zipped({"a.zip": zipped({"a.txt": "x" * 600}), "b.zip": zipped({"b.txt": "y" * 600})})
    assert not [b for b in files.parse("x.zip", two) if b[1] == "warning"]
    monkeypatch.setattr(files, "MOST_TOTAL", 1000)
    assert [b for b in files.parse("x.zip", two) if b[1] == "warning"] and files._left.get() is None


def test_html():
    html = "<head><title>t</title></head><h2>Head</h2><p>a <b>b</b><a href='javascript:x'>c</a> <a href='https://e.org'>d</a></p><script>no</script><ul><li>one</ul>"
    blocks = files.html_blocks(html + "<table><tr><th>x</th><th>y</th></tr><tr><td>1</td></tr></table>")
    assert blocks == ["## Head", "a bc d (https://e.org)", "- one", "| x | y |\n|---|---|\n| 1 |  |"]
    assert files.html_blocks(None) == []


def test_bundles_and_events(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: A b\ntype: note\n---\n\n# A\n\nbody\n")
    (tmp_path / "e.jsonl").write_text('{"a": 1}\nbroken\n')
    r = files.read_bundle(spark, str(tmp_path)).first()
    assert (r.title, r.type, r.body) == ("A b", "note", "# A\n\nbody\n")
    got = files.read_events(spark, str(tmp_path / "e.jsonl"), "a int").cache().collect()
    assert [(x.a, x._corrupt_record) for x in got] == [(1, None), (None, "broken")]


def test_comment_threads():
    ns = 'xmlns:w="urn:w" xmlns:x="urn:x"'
    comment = lambda n, para, t: f'<w:comment w:id="{n}" w:author="A{n}"><w:p x:paraId="{para}"><w:r><w:t>{t}</w:t></w:r></w:p></w:comment>'
    state = lambda para, done, up="": f'<x:commentEx x:paraId="{para}" x:done="{done}" {f"x:paraIdParent={up!r}" if up else ""}/>'
    raw = zipped(
        {
            "word/comments.xml": f"<w:comments {ns}>{comment(2, 'b', 'answer')}{comment(1, 'a', 'ask')}{comment(10, 'c', 'other')}{comment(11, 'd', 'loop')}</w:comments>",
            "word/commentsExtended.xml": f"<x:ex {ns}>{state('a', 1)}{state('b', 1, 'a')}{state('c', 0, 'd')}{state('d', 1, 'c')}</x:ex>",
        }
    )
    assert files.docx_comments(raw) == [(1, 1, "A1", "ask", True), (1, 2, "A2", "answer", True), (10, 10, "A10", "other", False), (10, 11, "A11", "loop", False)]


def test_pdf_text():
    content = b"BT /F1 12 Tf (Hello \\(x\\)) Tj T* [(wor) -20 (ld)] TJ ET BT (Next) Tj ET"
    body = zlib.compress(content)
    raw = b"%PDF-1.4\n1 0 obj <</Filter/FlateDecode/Length " + str(len(body)).encode() + b">>\nstream\n" + body + b"\nendstream\nendobj"
    assert [b[3] for b in files.pdf_blocks(raw)] == ["Hello (x)\nworld", "Next"]
