"""Files as rows: HTML, mail, spreadsheets, documents, archives, bundles. Spark lists and deals the files."""

from __future__ import annotations

import contextvars
import email
import email.policy
import io
import re
import zipfile
import zlib
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of archives.
MOST_MEMBERS, MOST_MEMBER, MOST_TOTAL, MOST_RATIO = 10_000, 128 << 20, 512 << 20, 1000
MOST_LEVELS = 10
_DROPPED = {"head", "script", "style", "template", "iframe", "form"}
_BLOCKS = {"p", "div", "li", "ul", "ol", "tr", "table", "section", "article", "nav", "header", "footer", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "br", "body"}


class _Text(HTMLParser):
    """Visible text by blocks: headings and list items marked, table rows as pipe lines, safe links kept."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.held: list[str] = []
        self.skip = 0
        self.links: list[str | None] = []
        self.rows: list[list[str]] | None = None

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.held)).strip()
        self.held = []
        if text and text not in ("-", "#", "##", "###", "####", "#####", "######"):
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in _DROPPED:
            self.skip += 1
        if self.skip:
            return
        if tag == "table" and self.rows is None:
            self.flush()
            self.rows = []
        elif self.rows is not None and tag == "tr":
            self.rows.append([])
        elif self.rows is not None and tag in ("td", "th"):
            self.held = []
        elif tag in _BLOCKS and self.rows is None:
            self.flush()
            if re.fullmatch("h[1-6]", tag):
                self.held.append("#" * int(tag[1]) + " ")
            elif tag == "li":
                self.held.append("- ")
        elif tag == "a":
            href = dict(attrs).get("href") or ""
            self.links.append(href if re.match(r"(?i)(https?|mailto):", href) else None)

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if self.rows is not None and tag in ("td", "th"):
            cell = re.sub(r"\s+", " ", "".join(self.held)).strip().replace("|", r"\|")
            self.held = []
            if self.rows:
                self.rows[-1].append(cell)
        elif tag == "table" and self.rows is not None:
            rows = [r for r in self.rows if r]
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                self.blocks.append("\n".join([lines[0], "|" + "---|" * width, *lines[1:]]))
            self.rows, self.held = None, []
        elif tag in _BLOCKS and self.rows is None:
            self.flush()
        elif tag == "a" and self.links and (href := self.links.pop()):
            self.held.append(f" ({href})")

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)


def html_blocks(html: str | None) -> list[str]:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def html_to_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, blocks) of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            blocks = [html_blocks(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.list_(pa.string()))], names=[key, "blocks"])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, blocks array<string>")


Block = tuple[str, str, int, str]


def mail_blocks(raw: bytes) -> list[Block]:
    """(source, kind, level, text): headers, the plain or else the HTML body, and attachments with what they hold."""
    out: list[Block] = []

    def walk(message, source: str) -> None:
        for name in ("from", "to", "cc", "date", "subject"):
            if message[name]:
                out.append((source, "header", 0, f"{name}: {message[name]}"))
        body = message.get_body(("plain", "html"))
        if body is not None:
            text = body.get_content()
            out.extend((source, "paragraph", 0, b) for b in (html_blocks(text) if body.get_content_subtype() == "html" else [x.strip() for x in re.split(r"\n\s*\n", text) if x.strip()]))
        for n, part in enumerate(message.iter_attachments()):
            name = part.get_filename() or f"part{n}"
            out.append((source, "attachment", 0, name))
            if part.get_content_type() == "message/rfc822":
                walk(part.get_content(), f"{source}/{n}")
            elif isinstance(content := part.get_content(), bytes):
                out.extend((f"{source}/{n}{s[4:]}", k, lv, t) for s, k, lv, t in parse(name, content))

    walk(email.message_from_bytes(raw, policy=email.policy.default), "root")
    return out


def safe_members(raw: bytes) -> list[zipfile.ZipInfo]:
    """Members of a ZIP archive that keeps the limits; ValueError if it does not."""
    members = zipfile.ZipFile(io.BytesIO(raw)).infolist()
    names = [m.filename for m in members]
    if len(members) > MOST_MEMBERS or len(set(names)) < len(names):
        raise ValueError("too many or repeated members")
    if any(n.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", n) or ":" in n for n in names):
        raise ValueError("a member leaves the archive")
    if any(m.file_size > MOST_MEMBER or m.file_size > MOST_RATIO * max(1, m.compress_size) for m in members) or sum(m.file_size for m in members) > MOST_TOTAL:
        raise ValueError("members are too large")
    return members


def _xml(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _tag(node) -> str:
    return node.tag.rpartition("}")[2]


def docx_blocks(raw: bytes) -> list[Block]:
    """Headings, paragraphs and tables in the order of the document."""
    safe_members(raw)
    root = _xml(zipfile.ZipFile(io.BytesIO(raw)), "word/document.xml")
    said = lambda node: "".join(x.text or "" for x in node.iter() if _tag(x) == "t")
    out: list[Block] = []
    for node in next((x for x in root if _tag(x) == "body"), []) if root is not None else []:
        if _tag(node) == "p" and said(node).strip():
            style = next((v for x in node.iter() if _tag(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            level = int(m[1]) if (m := re.match(r"(?i)heading\s*([1-9])", style)) else 0
            out.append(("root", "heading" if level else "paragraph", level, said(node)))
        elif _tag(node) == "tbl":
            rows = [[said(c) for c in r if _tag(c) == "tc"] for r in node if _tag(r) == "tr"]
            if rows:
                lines = ["| " + " | ".join(c.replace("|", r"\|") for c in r) + " |" for r in rows]
                out.append(("root", "table", 0, "\n".join([lines[0], "|" + "---|" * len(rows[0]), *lines[1:]])))
    return out


def _ends(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


def docx_comments(raw: bytes) -> list[tuple[int, int, str, str, bool]]:
    """(thread, comment, author, text, resolved): threads by the comment that others answer, members by number.

    A thread is resolved if all of its comments with a known state are. Parents on a circle end at its least number.
    """
    safe_members(raw)
    archive = zipfile.ZipFile(io.BytesIO(raw))
    root, more = _xml(archive, "word/comments.xml"), _xml(archive, "word/commentsExtended.xml")
    found, by_para = {}, {}
    for c in root if root is not None else ():
        number = int(_ends(c, "id") or 0)
        found[number] = (_ends(c, "author") or "", "\n".join("".join(t.text or "" for t in p.iter() if _tag(t) == "t") for p in c.iter() if _tag(p) == "p"))
        by_para |= {para: number for p in c.iter() if _tag(p) == "p" and (para := _ends(p, "paraId"))}
    parent, done = {}, {}
    for x in more if more is not None else ():
        if (number := by_para.get(_ends(x, "paraId"))) is not None:
            done[number] = _ends(x, "done") in ("1", "true")
            if (up := by_para.get(_ends(x, "paraIdParent"))) is not None:
                parent[number] = up

    def top(number: int) -> int:
        seen = [number]
        while (up := parent.get(seen[-1])) is not None:
            if up in seen:
                return min(seen[seen.index(up) :])
            seen.append(up)
        return seen[-1]

    threads: dict[int, list[int]] = {}
    for number in sorted(found):
        threads.setdefault(top(number), []).append(number)
    closed = {t: bool(known := [done[n] for n in members if n in done]) and all(known) for t, members in threads.items()}
    return [(t, n, *found[n], closed[t]) for t, members in sorted(threads.items()) for n in members]


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(\((?:\\.|[^\\()])*\))\s*(?:Tj|'|\")|(T\*|Td|TD|ET)", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"(": b"(", b")": b")", b"\\": b"\\"}


def pdf_blocks(raw: bytes) -> list[Block]:
    """Text that content streams show in simple fonts: a line for each text line, a paragraph between blank lines."""
    out: list[Block] = []
    for m in _STREAM.finditer(raw):
        try:
            data = zlib.decompress(m[1])
        except zlib.error:
            data = m[1]
        if b"BT" not in data:
            continue
        text = b""
        for shown in _SHOWN.finditer(data):
            if shown[3]:
                text += b"\n" if shown[3] != b"ET" else b"\n\n"
            else:
                parts = _STRING.findall(shown[1] if shown[1] is not None else shown[2])
                text += b"".join(re.sub(rb"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), x) for x in parts)
        out += [("root", "paragraph", 0, x.strip()) for x in re.split(r"\n\s*\n", text.decode("cp1252", "replace")) if x.strip()]
    return out


def xlsx_cells(raw: bytes) -> list[tuple[str, int, str, str | None, str | None]]:
    """(sheet, row, column letters, value, formula) of all cells."""
    safe_members(raw)
    archive = zipfile.ZipFile(io.BytesIO(raw))
    shared_root = _xml(archive, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in shared_root] if shared_root is not None else []
    book, links = _xml(archive, "xl/workbook.xml"), _xml(archive, "xl/_rels/workbook.xml.rels")
    target = {x.attrib["Id"]: x.attrib["Target"].removeprefix("/xl/") for x in links} if links is not None else {}
    out = []
    for sheet in (x for x in book.iter() if _tag(x) == "sheet") if book is not None else ():
        rel = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), "")
        root = _xml(archive, "xl/" + target.get(rel, ""))
        for cell in (x for x in root.iter() if _tag(x) == "c") if root is not None else ():
            m = re.match(r"([A-Z]+)([0-9]+)", cell.attrib.get("r", ""))
            parts = {_tag(x): x for x in cell}
            value = parts["v"].text if "v" in parts else "".join(t.text or "" for t in cell.iter() if _tag(t) == "t") or None
            if cell.attrib.get("t") == "s" and value is not None:
                value = shared[int(value)]
            if m:
                out.append((sheet.attrib.get("name", ""), int(m[2]), m[1], value, parts["f"].text if "f" in parts else None))
    return out


def column_index(letters: str) -> int:
    """Column letters as a number from 0."""
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_blocks(raw: bytes) -> list[Block]:
    """A heading and a Markdown table for each sheet; absent cells are empty ones."""
    sheets: dict[str, dict[int, dict[int, str]]] = {}
    for name, row, letters, value, _ in xlsx_cells(raw):
        sheets.setdefault(name, {}).setdefault(row, {})[column_index(letters)] = (value or "").replace("|", r"\|")
    out: list[Block] = []
    for name, rows in sheets.items():
        width = 1 + max(c for r in rows.values() for c in r)
        lines = ["| " + " | ".join(r.get(c, "") for c in range(width)) + " |" for _, r in sorted(rows.items())]
        out += [("root", "heading", 1, name), ("root", "table", 0, "\n".join([lines[0], "|" + "---|" * width, *lines[1:]]))]
    return out


def zip_blocks(raw: bytes) -> list[Block]:
    """Members of an archive, each with the blocks of what it holds."""
    archive = zipfile.ZipFile(io.BytesIO(raw))
    out: list[Block] = []
    for n, member in enumerate(m for m in safe_members(raw) if not m.is_dir()):
        out.append(("root", "attachment", 0, member.filename))
        out.extend((f"root/{n}{s[4:]}", k, lv, t) for s, k, lv, t in parse(member.filename, archive.read(member)))
    return out


def text_blocks(raw: bytes) -> list[Block]:
    return [("root", "paragraph", 0, x.strip()) for x in re.split(r"\n\s*\n", raw.decode("utf-8", "replace")) if x.strip()]


PARSERS = {
    "eml": mail_blocks, "docx": docx_blocks, "pdf": pdf_blocks, "xlsx": xlsx_blocks, "zip": zip_blocks, "txt": text_blocks, "md": text_blocks,
    "html": lambda raw: [("root", "paragraph", 0, b) for b in html_blocks(raw.decode("utf-8", "replace"))],
}


#: What is left of the limits for everything inside one file: levels of nesting, and bytes in all members.
_left: contextvars.ContextVar[list[int] | None] = contextvars.ContextVar("left", default=None)


def parse(name: str, raw: bytes) -> list[Block]:
    """Blocks of a file by its extension; an unknown kind has none, a damaged file one warning.

    A file inside a file takes from the limits of the outermost one; beyond them it is a warning.
    """
    parser = PARSERS.get(name.rpartition(".")[2].lower())
    left = _left.get()
    token = _left.set(left := [MOST_LEVELS, MOST_TOTAL]) if left is None else None
    left[0], left[1] = left[0] - 1, left[1] - (0 if token else len(raw))
    try:
        if left[0] < 0 or left[1] < 0:
            raise ValueError("files are nested too deep or too large together")
        return parser(raw) if parser else []
    except Exception as e:  # noqa: BLE001  files come from anywhere
        return [("root", "warning", 0, f"{type(e).__name__}: {e}")]
    finally:
        left[0] += 1
        if token:
            _left.reset(token)


SCHEMA = "path string, ordinal int, source string, kind string, level int, text string"


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Block rows of all files under a folder."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows += [(path, i, *b) for i, b in enumerate(parse(path, raw))]
            kinds = pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["path", "ordinal", "source", "kind", "level", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sheet, row, letters, value, formula) of all spreadsheets under a folder."""

    def run(batches):
        for batch in batches:
            rows = [(p, *c) for p, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for c in xlsx_cells(raw)]
            kinds = pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["path", "sheet", "row", "letters", "value", "formula"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, "path string, sheet string, row int, letters string, value string, formula string")


def _front(name: str, text: Column) -> Column:
    found = F.regexp_extract(text, rf"(?ms)\A---\n.*?^{name}:[ ]*([^\n]*)$", 1)
    return F.when(found != "", F.trim(found))


def read_bundle(spark: SparkSession, folder: str, names: tuple[str, ...] = ("title", "type")) -> DataFrame:
    """(path, the named front-matter values, body) of Markdown files."""
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n+", "")
    return files.select(F.input_file_name().alias("path"), *[_front(n, F.col("value")).alias(n) for n in names], body.alias("body"))


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines; a damaged line is kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)
