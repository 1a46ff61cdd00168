"""Text and metadata of PDF files with the standard library: Flate streams, text operators, ToUnicode maps.

Two readers: one takes a page's strings in the order of its content stream, one
goes by the text position and starts a line where it moves. Encrypted files,
scans and fonts without a map to Unicode give what their bytes say, or ''.
"""

from __future__ import annotations

import re
import zlib

#: Bytes that a stream may grow to when it is unpacked; a stream that is larger is left out.
MOST_BYTES = 64 << 20

_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<(?!<)|>(?!>)|<<(?:[^<>]|<(?!<)|>(?!>))*>>)*)>>\s*stream\r?\n")
_TOKEN = re.compile(
    rb"\((?P<text>(?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<open>\[)|(?P<close>\])|/(?P<name>[^\s/\[\]()<>]+)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<word>[A-Za-z'\"*]+\d*\*?)",
    re.S,
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _unescaped(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        c = m[1]
        if c[:1].isdigit():
            return bytes([int(c, 8) & 255])
        return b"" if c in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.S)


def _unpacked(data: bytes) -> bytes:
    try:
        packed = zlib.decompressobj()
        out = packed.decompress(data, MOST_BYTES)
        return b"" if packed.unconsumed_tail else out
    except zlib.error:
        return b""


def streams(content: bytes) -> list[tuple[bytes, bytes]]:
    """(dictionary, bytes) of every stream that is plain or Flate, in the file's order."""
    out = []
    for m in _STREAM.finditer(content):
        end = content.find(b"endstream", m.end())
        data, head = content[m.end() : end if end >= 0 else len(content)], m["head"]
        if b"/FlateDecode" in head:
            data = _unpacked(data)
        elif b"/Filter" in head:
            continue
        out.append((head, data))
    return out


def _hex(raw: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", raw)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def unicode_map(data: bytes) -> dict[int, str]:
    """Code to text of a ToUnicode map's single entries and ranges."""
    out: dict[int, str] = {}
    said = lambda x: _hex(x).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]*)>", block):
            out[int(_hex(code).hex() or "0", 16)] = said(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, to in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>", block):
            first, last, begin = int(_hex(a).hex() or "0", 16), int(_hex(b).hex() or "0", 16), said(to)
            for k in range(min(last - first + 1, 65536) if begin else 0):
                out[first + k] = begin[:-1] + chr(min(ord(begin[-1]) + k, 0x10FFFF))
    return out


def _shown(raw: bytes, is_hex: bool, codes: dict[int, str]) -> str:
    data = _hex(raw) if is_hex else _unescaped(raw)
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    if is_hex and codes:
        wide = max(codes) > 255
        parts = [int.from_bytes(data[k : k + 1 + wide], "big") for k in range(0, len(data), 1 + wide)]
        return "".join(codes.get(c, "") for c in parts)
    return data.decode("cp1252", "replace")


def _operations(data: bytes, codes: dict[int, str]):
    """(operator, operands) of a content stream's text objects; an array of strings and gaps is one operand."""
    for block in re.findall(rb"\bBT\b(.*?)\bET\b", data, re.S):
        held: list = []
        inside = None
        for m in _TOKEN.finditer(block):
            kind = m.lastgroup
            if kind == "open":
                inside = []
            elif kind == "close":
                held.append(inside or [])
                inside = None
            elif kind == "word":
                yield m["word"].decode(), held
                held, inside = [], None
            else:
                value = float(m["number"]) if kind == "number" else m["name"].decode("latin-1") if kind == "name" else _shown(m[kind], kind == "hex", codes)
                (held if inside is None else inside).append(value)
        yield "ET", []


def _strings(operands: list, gap: float = -200) -> str:
    """The strings of an operand; in an array a wide gap is a blank."""
    out = ""
    for x in operands[-1] if operands and isinstance(operands[-1], list) else operands[-1:]:
        out += x if isinstance(x, str) else " " if x <= gap else ""
    return out


def _texts(content: bytes):
    found = streams(content)
    codes: dict[int, str] = {}
    for _, data in found:
        if b"beginbfchar" in data or b"beginbfrange" in data:
            codes.update(unicode_map(data))
    pages = [data for _, data in found if re.search(rb"\bBT\b", data)]
    if not found and re.search(rb"\bBT\b", content):
        pages = [content]  # operators outside any stream
    return pages, codes


def text_in_order(content: bytes) -> str:
    """Strings in the order of the content streams, one a line."""
    pages, codes = _texts(content)
    lines = [_strings(held) for page in pages for op, held in _operations(page, codes) if op in ("Tj", "TJ", "'", '"')]
    return "\n".join(x for x in lines if x)


def text_by_lines(content: bytes) -> str:
    """Strings joined into lines: a new one where the text position moves down or a line operator stands."""
    pages, codes = _texts(content)
    out = []
    for page in pages:
        lines, at, last = [""], None, ""
        for op, held in _operations(page, codes):
            if op in ("T*", "'", '"', "ET") or (op in ("Td", "TD") and len(held) > 1 and isinstance(held[1], float) and held[1]):
                lines.append("")
            elif op == "Tm" and len(held) > 5:
                if at is not None and held[5] != at:
                    lines.append("")
                at = held[5]
            if op in ("Tj", "TJ", "'", '"') and (shown := _strings(held)):
                # Strings of a line are words, unless a letter stands alone: then they are shown letter by letter.
                apart = lines[-1] and len(shown) > 1 and len(last) > 1 and not lines[-1].endswith(" ") and not shown.startswith(" ")
                lines[-1] += " " * bool(apart) + shown
                last = shown
        out.append("\n".join(x.strip() for x in lines if x.strip()))
    return "\n".join(x for x in out if x)


def metadata(content: bytes) -> dict[str, str]:
    """title and author(s) of the file's information dictionary, '' where it has none."""
    texts = [content, *(data for head, data in streams(content) if b"/ObjStm" in head)]
    out = {}
    for name, field in (("title", rb"/Title"), ("authors", rb"/Author")):
        found = (re.search(field + rb"\s*(?:\((?P<text>(?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>)", t, re.S) for t in texts)
        m = next((m for m in found if m), None)
        out[name] = "" if m is None else _shown(m["text"] if m["text"] is not None else m["hex"], m["text"] is None, {}).strip()
    return out
