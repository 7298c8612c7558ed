"""Pages of PDF files: their text and how many images they show.

A small reader for files whose text is in simple fonts: objects and object streams, deflated
or plain content streams, the text operators, images drawn on the page.  Where a project has
a better one, it is registered as the extractor.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siftwood.operators.workers import map_arrow

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"^(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+.\d]+|[A-Za-z'\"*]+", re.DOTALL)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.DOTALL)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class _File:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF-") or b"/Encrypt" in data:
            raise ValueError("not a readable PDF")
        self.objects = {int(n): body for n, body in _OBJECT.findall(data)}
        for body in [b for b in self.objects.values() if b"/ObjStm" in b]:
            head, inner = self.stream(body)
            count, first = (int(re.search(rb"/%s\s+(\d+)" % key, head)[1]) for key in (b"N", b"First"))
            numbers = [int(x) for x in inner[:first].split()[: 2 * count]]
            ends = [*numbers[3::2], len(inner) - first]
            self.objects.update({n: inner[first + at : first + end] for n, at, end in zip(numbers[::2], numbers[1::2], ends, strict=True)})

    def stream(self, body: bytes) -> tuple[bytes, bytes]:
        m = _STREAM.match(body)
        if not m:
            return body, b""
        return m[1], zlib.decompressobj().decompress(m[2]) if b"FlateDecode" in m[1] else m[2]

    def value(self, body: bytes, key: bytes) -> bytes:
        """What stands after a key, a reference followed once."""
        m = re.search(rb"/%s\b\s*(\[.*?\]|<<.*?>>(?!>)|\d+\s+\d+\s+R|\S+)" % key, body, re.DOTALL)
        found = m[1] if m else b""
        r = _REFERENCE.fullmatch(found)
        return self.objects.get(int(r[1]), b"") if r else found

    def pages(self) -> list[bytes]:
        """Page objects in the order of the page tree."""
        is_page = re.compile(rb"/Type\s*/Page(?!s)\b")
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out, todo, seen = [], [self.value(root, b"Pages")], set()
        while todo:
            body = todo.pop(0)
            if is_page.search(body):
                out.append(body)
                continue
            kids = [int(n) for n in _REFERENCE.findall(self.value(body, b"Kids")) if int(n) not in seen]
            seen.update(kids)
            todo = [self.objects.get(n, b"") for n in kids] + todo
        return out or [b for b in self.objects.values() if is_page.search(b)]

    def content(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        return b"\n".join(self.stream(self.objects.get(int(n), b""))[1] for n in _REFERENCE.findall(m[1])) if m else b""

    def images(self, page: bytes) -> set[bytes]:
        """Names of the images among the page's resources."""
        named = re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.value(self.value(page, b"Resources") or page, b"XObject"))
        return {name for name, n in named if re.search(rb"/Subtype\s*/Image\b", self.objects.get(int(n), b""))}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode().ljust(len(token) % 2, "0"))
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else _NAMED.get(m[1], m[1]), token[1:-1])
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _text_and_names(content: bytes) -> tuple[str, list[bytes]]:
    """The text that a content stream shows, and the names of what it draws."""
    out, drawn, strings, last = [], [], [], b""
    for token in _TOKEN.findall(content):
        if token[:1] in (b"(", b"<"):
            strings.append(_string(token))
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            out += ["\n"] * (token in (b"'", b'"')) + strings
            strings = []
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
        elif token == b"Do":
            drawn.append(last[1:])
        elif token.isalpha():
            strings = []
        last = token
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n"), drawn


def read_pages(data: bytes) -> list[tuple[int, str, int]]:
    """(page, text, images) of a PDF."""
    file, out = _File(data), []
    for n, page in enumerate(file.pages(), 1):
        text, drawn = _text_and_names(file.content(page))
        images = file.images(page)
        out.append((n, text, sum(name in images for name in drawn)))
    return out


def pages_of(files: DataFrame, extractor: Callable[[bytes], list[tuple[int, str, int]]] = read_pages) -> DataFrame:
    """(path, page, text, n_images) of PDF files (path, content); one that can't be read has no pages."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, *page) for page in extractor(data)]
                except Exception:  # noqa: BLE001  one unreadable file must not end the job
                    continue
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int32()), strict=True)], ["path", "page", "text", "n_images"])

    return map_arrow(files.select("path", "content"), run, "path string, page int, text string, n_images int")
