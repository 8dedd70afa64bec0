"""Secret scan: keywords by Aho-Corasick, regular expressions anchored at the hits, then checksums inside the token.

Kinds: ``assign`` (a name such as password or token with a value of 8 characters or more), ``access`` (AKIA keys of 16 or
more), ``hex`` (runs of 32 or more), ``github`` and ``npm`` (tokens whose last six characters are the base-62 CRC-32 of
the thirty before), ``jwt`` (three base64url parts whose first is a JSON header with an algorithm) and ``pem`` (private key
blocks). Spans count code points, end exclusive; spans of one kind never overlap, those of different kinds may.

Null and empty texts have no spans. Long texts are scanned whole, in time that grows with their length: what a failed hit
has read is not read again. Repeated rows get equal results, an empty table an empty one. ``scan`` ignores further columns,
so names may clash; ``redact`` keeps every column and every row.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = KINDS[:3]
#: Keywords in lower case and the kind that each may begin.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "eyj": "jwt", "-----begin": "pem",
}
PATTERNS = {
    "assign": re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
}
#: A block is a head, characters of its body, and a tail.
PEM_HEAD = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=:,\x20\r\n-]*")
PEM_TAIL = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY-----")
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
MASK = "[secret]"
_HEX_CHAR, _HEX_RUN = re.compile("[0-9a-f]"), re.compile("[0-9a-f]+")
_HEX = frozenset("0123456789abcdef")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


_AUTOMATON = _automaton()


def crc_digits(body: str) -> str:
    """CRC-32 of a token's body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out


def _jwt_header(part: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except ValueError:
        return False
    return isinstance(head, dict) and "alg" in head


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= LEAST_VALUE
    if kind == "access":
        return m.end() - m.start() >= LEAST_ACCESS
    if kind in ("github", "npm"):
        return crc_digits(m[1][:30]) == m[1][30:]
    return kind != "jwt" or _jwt_header(m[1])


def _hex_runs(text: str) -> list[tuple[int, int]]:
    """Runs of LEAST_HEX or more hexadecimal digits: each covers a place that is one less than a multiple of LEAST_HEX."""
    out, done = [], 0
    for m in _HEX_CHAR.finditer(text[LEAST_HEX - 1 :: LEAST_HEX]):
        at = (m.start() + 1) * LEAST_HEX - 1
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in _HEX:
            start -= 1
        done = _HEX_RUN.match(text, at).end()
        if done - start >= LEAST_HEX:
            out.append((start, done))
    return out


def _pem(text: str, at: int) -> tuple[bool, int]:
    """(whether a block begins at ``at``, place up to which no other can begin)."""
    head = PEM_HEAD.match(text, at)
    if not head:
        return False, at + 1
    stop = PEM_BODY.match(text, head.end()).end()
    tail = PEM_TAIL.search(text, head.end(), stop)
    return (True, tail.end()) if tail else (False, stop)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start and kind."""
    if not text:
        return []
    hits: dict[str, list[int]] = {}
    for last, (size, kind) in _AUTOMATON.iter(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
        hits.setdefault(kind, []).append(last + 1 - size)
    spans = [("hex", a, b) for a, b in _hex_runs(text)]
    for kind, starts in hits.items():
        done = 0
        for at in sorted(starts):
            if at < done:
                continue
            if kind == "pem":
                real, done = _pem(text, at)
                if real:
                    spans.append((kind, at, done))
            elif m := PATTERNS[kind].match(text, at):
                done = m.end()
                if _valid(kind, m):
                    spans.append((kind, at, done))
            elif kind == "jwt":  # what follows the run fails for every hit in it
                done = _JWT_RUN.match(text, at).end()
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row."""

    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, _SPAN)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def mask(text: str | None) -> str | None:
    """The text with each run of overlapping spans replaced by MASK."""
    spans = find(text)
    if not spans:
        return text
    out, at, end = [], 0, -1
    for _, a, b in spans:
        if a >= end:
            out += [text[at:a], MASK] if end < 0 else [text[end:a], MASK]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with secrets masked in ``text`` and ``n_chars`` counted anew where it is there."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [mask(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
