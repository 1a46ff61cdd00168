"""Secret scans: keyword automaton, anchored patterns near hits, checksums.

One Aho-Corasick automaton finds every keyword of every rule in one walk over
a text. A rule's pattern is then tried only at its keywords' places, anchored
there, and a match must pass the rule's checks (length, embedded checksum).
Hex runs have no keyword; their character class is its own anchor.

Base kinds, leftmost and non-overlapping per kind, failing matches dropped
after they have consumed their characters: ``assign``, ``access``, ``hex``.
Added kinds: ``forge`` (forge tokens, CRC-32 in base 62), ``registry``
(package registry tokens, same checksum), ``card`` (card numbers after a card
keyword, Luhn digit), ``iban`` (after an IBAN keyword, mod 97), ``pem``
(private key blocks), ``jwt`` (three parts, JSON header).

The scan is one map over the documents: nothing is shuffled, so no key can be
hot. Offsets are code points, ends exclusive.

Defined results: a null text counts as empty and has no spans; null ids stay
null; repeated rows give repeated rows; an empty table gives an empty table;
further columns are ignored. Whole texts are read whatever their length, and no
text makes a rule raise: what a check cannot parse (a token header that is no
JSON, or is nested too deeply) fails the check.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
_FOLD = {k: k + 32 for k in range(65, 91)}


def crc62(body: str, check: str) -> bool:
    """Whether ``check`` is the CRC-32 of ``body`` in base 62, padded with zeros."""
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, at = divmod(value, 62)
        digits = BASE62[at] + digits
    return digits.rjust(len(check), "0") == check


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _jwt(value: str) -> bool:
    head = value.split(".", 1)[0]
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
    except (binascii.Error, ValueError, RecursionError):  # a header nested too deeply for the parser is none
        return False


#: kind, keywords (lower case), pattern anchored at the keyword, check of the match, span group.
Rule = tuple[str, tuple[str, ...], re.Pattern, Callable[[re.Match], bool], int]

RULES: tuple[Rule, ...] = (
    ("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8, 0),
    ("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16, 0),
    ("forge", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), lambda m: crc62(m[1], m[2]), 0),
    ("registry", ("npm_",), re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), lambda m: crc62(m[1], m[2]), 0),
    ("card", ("card", "visa", "mastercard"), re.compile(r"(?:card|visa|mastercard)[A-Za-z ]{0,12}[:=#]?\x20{0,3}([0-9](?:[\x20-]?[0-9]){12,18})(?![0-9])", re.I | re.A), lambda m: luhn(re.sub("[^0-9]", "", m[1])), 1),
    ("iban", ("iban",), re.compile(r"iban\x20{0,3}[:=]?\x20{0,3}([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Za-z0-9])", re.I | re.A), lambda m: iban(m[1].upper()), 1),
    ("pem", ("-----begin",), re.compile(r"-----BEGIN ([A-Z ]{0,24})PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END \1PRIVATE KEY-----", re.A), lambda m: True, 0),
    ("jwt", ("eyj",), re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), lambda m: _jwt(m[0]), 0),
)
BASE_KINDS = ("assign", "access", "hex")
KINDS = BASE_KINDS + tuple(r[0] for r in RULES[2:])
_ORDER = {k: n for n, k in enumerate(KINDS)}


def automaton():
    """The keywords of all rules; a keyword carries its length and its rules."""
    of: dict[str, list[int]] = {}
    for k, (_, words, *_rest) in enumerate(RULES):
        for w in words:
            of.setdefault(w, []).append(k)
    found = ahocorasick.Automaton()
    for w, rules in of.items():
        found.add_word(w, (len(w), tuple(rules)))
    found.make_automaton()
    return found


def scan(text: str, keywords) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of one text, by start, then kind as listed."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer moves what follows
        low = text.translate(_FOLD)
    out: list[tuple[int, int, int]] = []
    places: dict[int, list[int]] = {}
    for last, (size, rules) in keywords.iter(low):
        for k in rules:
            places.setdefault(k, []).append(last - size + 1)
    for k, starts in places.items():
        kind, _, pattern, good, group = RULES[k]
        free = 0
        for start in sorted(starts):
            if start >= free and (m := pattern.match(text, start)):
                free = m.end()
                if good(m):
                    out.append((m.start(group), _ORDER[kind], m.end(group)))
    out += [(m.start(), _ORDER["hex"], m.end()) for m in HEX_RUN.finditer(text)]
    return [(KINDS[k], start, end) for start, k, end in sorted(out)]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_spans", pa.string()), ("spans", pa.string())])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = automaton()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part, rows = batch.slice(at, 512), []
            for text in part.column(1):
                found = scan(text.as_py() or "", keywords)
                base = [x for x in found if x[0] in BASE_KINDS]
                rows.append((*(sum(x[0] == k for x in base) for k in BASE_KINDS), _joined(base), _joined(found)))
            cols = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(_OUT)[1:]))], schema=_OUT)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_spans and spans of every document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans merge."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
