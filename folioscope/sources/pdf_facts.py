"""Facts of PDF files, read from their object structure without a PDF library.

A reader for what the verdicts need: catalog entries, metadata, pages, encryption, outline, fonts
and text operators. It finds objects by scanning, opens Flate streams and object streams, and does
not decrypt; an encrypted file keeps its permission facts.
"""

from __future__ import annotations

import html
import re
import signal
import threading
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+(\d+)\s+R\b")
#: A stream that inflates to more than this is an error of its file; a hostile file cannot fill the worker.
MAX_INFLATED = 64 * 1024 * 1024

FACTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in "open_error error_kind pdf_version creator producer title lang doc_mod doc_creation xmp_modify dc_modified xmp_create".split()]
    + [T.StructField(n, T.IntegerType()) for n in "n_pages n_images n_words p revision n_fields n_outline_roots".split()]
    + [T.StructField(n, T.BooleanType()) for n in "has_xmp has_viewer_prefs display_doc_title has_struct_tree has_mark_info marked encrypted allow_accessibility xfa_required".split()]
    + [T.StructField("font_names", T.ArrayType(T.StringType())), T.StructField("num_tf", T.LongType())]
)
_EMPTY = {f.name: None for f in FACTS.fields}


#: Operators and operands that matter for text: names, strings, gaps of shown lines, and operators.
_SHOWN = re.compile(rb"""/(?P<name>[^\s/<>\[\]()]+)|(?P<text>\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)|(?P<number>-?\d+(?:\.\d+)?)(?=\s*[(<\]])|(?P<op>\b(?:Tf|Td|TD|Tm|BT|Do)\b|T\*|['"])""", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(value: bytes) -> bytes:
    """Bytes of a literal or hexadecimal string."""
    if value.startswith(b"<"):
        digits = re.sub(rb"\s", b"", value[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        if m[1][:1].isdigit():
            return bytes([int(m[1], 8) & 255])
        return b"" if m[1] in (b"\n", b"\r\n") else _ESCAPES.get(m[1], m[1])

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, value[1:-1], flags=re.S)


class TooLarge(ValueError):
    """A stream inflates to more than ``MAX_INFLATED``."""


def _head(body: bytes) -> bytes:
    """The dictionary before a stream."""
    raw = _STREAM.search(body)
    return body if raw is None else body[: raw.start()]


def _inflated(body: bytes) -> bytes:
    raw = _STREAM.search(body)
    if raw is None:
        return b""
    if b"FlateDecode" not in body[: raw.start()]:
        return raw[1]
    try:
        content = zlib.decompressobj().decompress(raw[1], MAX_INFLATED + 1)
    except zlib.error:
        return b""
    if len(content) > MAX_INFLATED:
        raise TooLarge
    return content


def _text(value: bytes | None) -> str | None:
    if value is None:
        return None
    if value.startswith(b"<") and not value.startswith(b"<<"):
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", value)
        value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        value = re.sub(rb"\\([()\\])", rb"\1", value[1:-1])
    if value.startswith(b"\xfe\xff"):
        return value[2:].decode("utf-16-be", "replace")
    return value.decode("latin-1")


class _File:
    def __init__(self, data: bytes) -> None:
        self.data = data
        self.objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in _head(body):
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        count, first = re.search(rb"/N\s+(\d+)", body), re.search(rb"/First\s+(\d+)", body)
        content = _inflated(body)
        if count and first and content:
            numbers = [int(n) for n in content[: int(first[1])].split()[: 2 * int(count[1])]]
            starts = [*numbers[1::2], len(content) - int(first[1])]
            for i, number in enumerate(numbers[::2]):
                self.objects.setdefault(number, content[int(first[1]) + starts[i] : int(first[1]) + starts[i + 1]])

    def follow(self, value: bytes | None) -> bytes | None:
        seen = 0
        while value is not None and (m := _REFERENCE.fullmatch(value.strip())) and seen < 20:
            value, seen = self.objects.get(int(m[1])), seen + 1
        return value

    def get(self, body: bytes | None, key: bytes) -> bytes | None:
        """Value of ``key`` in a dictionary: a reference, name, text, nested dictionary or plain token."""
        found = re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*", body or b"")
        if not found:
            return None
        rest = body[found.end() :]
        if rest.startswith((b"<<", b"[")):
            opening, closing = (b"<<", b">>") if rest.startswith(b"<<") else (b"[", b"]")
            depth = 0
            for m in re.finditer(re.escape(opening) + b"|" + re.escape(closing), rest):
                depth += 1 if m[0] == opening else -1
                if not depth:
                    return rest[: m.end()]
            return rest
        m = re.match(rb"\d+\s+\d+\s+R\b|\((?:\\.|[^\\()]|\([^()]*\))*\)|<[^>]*>|/[^\s/<>\[\]()]+|[^\s/<>\[\]()]+", rest, re.S)
        return self.follow(m[0]) if m else None

    def page_bodies(self) -> list[bytes]:
        return [b for b in self.objects.values() if re.search(rb"/Type\s*/Page(?![a-zA-Z])", b)]

    def entries(self, value: bytes | None) -> dict[str, bytes]:
        """References of a dictionary by their names."""
        return {m[1].decode("latin-1"): m[2] for m in re.finditer(rb"/([^\s/<>\[\]()]+)\s*(\d+\s+\d+\s+R\b)", value or b"")}

    def codes(self, font: bytes | None) -> tuple[dict[int, str], int]:
        """Characters by code of a font with a ToUnicode map, and the bytes of a code; empty without one."""
        head = _head(font or b"")
        m = re.search(rb"/ToUnicode\s*(\d+\s+\d+\s+R\b)", head)
        if m is None:
            return {}, 1
        cmap, out, width = _inflated(self.follow(m[1]) or b""), {}, 1
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<((?:[0-9A-Fa-f]{2})+)>", block):
                width, out[int(code, 16)] = max(1, len(code) // 2), text(to)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]{4})>", block):
                width = max(1, len(low) // 2)
                for i in range(min(int(high, 16) - int(low, 16), 0xFFFF) + 1):
                    out[int(low, 16) + i] = chr(min(int(to, 16) + i, 0x10FFFF))
        return out, width

    def text(self, page: bytes, above: tuple[bytes, ...] = ()) -> str:
        """Text that the content of a page or form shows, in order of drawing; a move to another place parts words."""
        head = _head(page)
        resources = self.get(head, b"Resources")
        for _ in range(50):  # a page inherits them
            if resources is not None or above:
                break
            head = self.get(head, b"Parent") or b""
            resources = self.get(head, b"Resources")
        fonts = {n: self.codes(self.follow(r)) for n, r in self.entries(self.get(resources, b"Font")).items()}
        forms = self.entries(self.get(resources, b"XObject"))
        content = page if above else b"\n".join(_inflated(self.follow(r) or b"") for r in re.findall(rb"\d+\s+\d+\s+R\b", self.raw(_head(page), b"Contents") or b""))
        content = _inflated(page) if above else content
        out, (codes, width), before = [], ({}, 1), b""
        for m in _SHOWN.finditer(content):
            if m["name"] is not None:
                before = m["name"]
            elif m["text"] is not None:
                raw = _string(m["text"])
                out.append("".join(codes.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width)) if codes else raw.decode("cp1252", "replace"))
            elif m["number"] is not None:
                if float(m["number"]) < -200:  # a gap inside a shown line, as wide as a blank
                    out.append(" ")
            elif m["op"] == b"Tf":
                codes, width = fonts.get(before.decode("latin-1"), ({}, 1))
            elif m["op"] == b"Do":
                form = self.follow(forms.get(before.decode("latin-1"))) or b""
                if self.get(_head(form), b"Subtype") == b"/Form" and form not in above:
                    out.append(" " + self.text(form, (*above, form)) + " ")
            elif m["op"] in (b"Td", b"TD", b"Tm", b"T*", b"'", b'"', b"BT"):
                out.append("\n")
        return "".join(out)

    def raw(self, body: bytes, key: bytes) -> bytes | None:
        """Value of ``key`` as written: a reference stays one."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*(\[[^\]]*\]|\d+\s+\d+\s+R\b)", body)
        return m[1] if m else None

    def images(self, body: bytes | None, above: tuple[bytes, ...] = ()) -> int:
        """Images that the resources of a page or form name, those of nested forms included; a form inside itself counts once."""
        head = _head(body or b"")
        resources, page = self.get(head, b"Resources"), head
        for _ in range(50):  # a page inherits them
            if resources is not None or above or page is None:
                break
            page = self.get(page, b"Parent")
            resources = self.get(page, b"Resources")
        count = 0
        for reference in re.findall(rb"\d+\s+\d+\s+R\b", self.get(resources, b"XObject") or b""):
            item = self.follow(reference) or b""
            kind = self.get(_head(item), b"Subtype")
            if kind == b"/Image":
                count += 1
            elif kind == b"/Form" and item not in above and self.get(_head(item), b"Ref") is None:
                count += self.images(item, (*above, item))
        return count


def _words(f: _File, pages: list[bytes]) -> int | None:
    """Words of all pages; null where the text cannot be read."""
    try:
        return sum(len(re.findall(r"\S+", f.text(p))) for p in pages)
    except (ValueError, IndexError, KeyError, RecursionError):
        return None


class OutOfTime(BaseException):
    """A file takes longer than it may; no reader below catches it."""


@contextmanager
def _at_most(seconds: float | None) -> Iterator[None]:
    """Ends the work inside after ``seconds``, by an alarm to the worker's own process."""
    if seconds is None or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_: object) -> None:
        raise OutOfTime

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def read_facts(data: bytes) -> dict:
    """Facts of one file. A damaged or foreign file has ``open_error`` and ``error_kind``, and what was found before."""
    facts = dict(_EMPTY)
    head = re.match(rb"\s*%PDF-(\d\.\d)", data[:1024])
    if head is None:
        return facts | {"open_error": "not a PDF", "error_kind": "pdf"}
    facts["pdf_version"] = head[1].decode()
    try:
        f = _File(data)
        trailer = b" ".join(re.findall(rb"trailer(.*?)(?:startxref|\Z)", data, re.S)) + b" ".join(h for h in map(_head, f.objects.values()) if re.search(rb"/Type\s*/XRef\b", h))
        root = f.get(trailer, b"Root") or next((b for b in f.objects.values() if re.search(rb"/Type\s*/Catalog", b)), None)
        if root is None:
            return facts | {"open_error": "no catalog", "error_kind": "pdf"}
        info = f.get(trailer, b"Info")
        for name, key in (("title", b"Title"), ("doc_mod", b"ModDate"), ("doc_creation", b"CreationDate")):
            value = f.get(info, key)
            facts[name] = _text(value) if value and value[:1] in b"(<" else None
        bodies = list(f.objects.values())
        pages = f.page_bodies()
        facts["n_pages"] = len(pages)
        facts["n_images"] = sum(map(f.images, pages))
        metadata = f.get(root, b"Metadata")
        facts["has_xmp"] = metadata is not None
        xmp = _inflated(metadata or b"")
        for name, tag in (("xmp_modify", rb"xmp:ModifyDate"), ("dc_modified", rb"dc:[Mm]odified"), ("xmp_create", rb"xmp:CreateDate"), ("creator", rb"xmp:CreatorTool"), ("producer", rb"pdf:Producer")):
            m = re.search(tag + rb"(?:>|=\")([^<\"]+)", xmp)
            facts[name] = html.unescape(m[1].decode("utf-8", "replace").strip()) if m else None
        if m := re.search(rb"<dc:title>.*?<rdf:li[^>]*>([^<]*)<", xmp, re.S):
            facts["title"] = html.unescape(m[1].decode("utf-8", "replace")) or facts["title"]
        lang = f.get(root, b"Lang")
        facts["lang"] = _text(lang) if lang and lang[:1] in b"(<" else None
        preferences = f.get(root, b"ViewerPreferences")
        shown = f.get(preferences, b"DisplayDocTitle")
        marks = f.get(root, b"MarkInfo")
        marked = f.get(marks, b"Marked")
        facts |= {"has_viewer_prefs": preferences is not None, "display_doc_title": None if shown is None else shown.strip() != b"false", "has_struct_tree": f.get(root, b"StructTreeRoot") is not None, "has_mark_info": marks is not None, "marked": None if marked is None else marked.strip() != b"false"}
        encryption = f.get(trailer, b"Encrypt")
        facts["encrypted"] = encryption is not None
        if encryption is not None:
            p, r = f.get(encryption, b"P"), f.get(encryption, b"R")
            facts["p"], facts["revision"] = (int(x) if x and re.fullmatch(rb"-?\d+", x.strip()) else None for x in (p, r))
            facts["allow_accessibility"] = None if facts["p"] is None else bool(facts["p"] & 512)
        form = f.get(root, b"AcroForm")
        facts["n_fields"] = len(_REFERENCE.findall(f.get(form, b"Fields") or b""))
        facts["xfa_required"] = b"dynamicRender>required" in b"".join(_inflated(b) for b in bodies) if f.get(form, b"XFA") else False
        facts["n_outline_roots"] = int(f.get(f.get(root, b"Outlines"), b"First") is not None)
        fonts = [b for b in bodies if re.search(rb"/BaseFont(?![A-Za-z])|/Type\s*/Font(?![A-Za-z])", _head(b))]
        described = [(f.get(f.get(b, b"FontDescriptor"), b"FontName") or b"/") if f.get(b, b"FontDescriptor") else f.get(b, b"BaseFont") or b"/" for b in fonts]
        facts["font_names"] = sorted({n[1:].decode("latin-1") for n in described})
        facts["num_tf"] = sum(len(re.findall(rb"\bTf\b", _inflated(b))) for b in bodies if b"stream" in b and b"/Image" not in b)
        facts["n_words"] = None if facts["encrypted"] else _words(f, pages)
    except (ValueError, IndexError, KeyError) as error:
        facts |= {"open_error": f"{type(error).__name__}", "error_kind": "value"}
    return facts


def pdf_facts(files: DataFrame, max_mb: float = 200, seconds: float | None = 120) -> DataFrame:
    """``path`` and facts of each file of a ``binaryFile`` table up to ``max_mb``; larger files are not opened.

    A file that takes longer than ``seconds`` has the error kind ``timeout`` and no facts.
    """
    def one(content: bytes) -> dict:
        try:
            with _at_most(seconds):
                return read_facts(content)
        except OutOfTime:
            return _EMPTY | {"open_error": f"Analysis timed out after {seconds:g} seconds", "error_kind": "timeout"}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"path": p, **one(c)} for p, c in zip(b["path"], b["content"], strict=True)]).astype(object)

    layout = T.StructType([T.StructField("path", T.StringType()), *FACTS.fields])
    return files.where(F.col("length") <= max_mb * 1048576).select("path", "content").mapInPandas(read, layout)
