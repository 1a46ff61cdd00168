"""Secret scans against plain regular expressions on whole texts."""

import base64
import re
import time
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return [(secrets.BASE_KINDS[k], a, b) for a, k, b in sorted(out)]


PIECES = ["password", "PassWD", "secret", "token", "api_key", "apiKey", "toKen", "İ", "é", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA", "ABCDEFGH12345", "abcdefgh", "x", "0123456789abcdef", "deadbeefdeadbeef", "\U0001f642", "\n", "visa", "iban"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_equals_plain_regex(text):
    found = secrets.scan(text, secrets.automaton())
    assert [x for x in found if x[0] in secrets.BASE_KINDS] == brute(text)


def test_checksums():
    body = "a1B2" * 7 + "zz"
    value, check = zlib.crc32(body.encode()), ""
    while value:
        value, k = divmod(value, 62)
        check = secrets.BASE62[k] + check
    good = f"x ghp_{body}{check.rjust(6, '0')} y"
    kinds = lambda t: [x[0] for x in secrets.scan(t, secrets.automaton())]
    assert kinds(good) == ["forge"]
    assert kinds(good[:-4] + ("a" if good[-4] != "a" else "b") + good[-3:]) == []
    assert kinds("visa: 4111 1111 1111 1111.") == ["card"] and kinds("visa: 4111 1111 1111 1112.") == []
    assert kinds("IBAN GB82WEST12345698765432") == ["iban"] and kinds("IBAN GB83WEST12345698765432") == []
    assert kinds("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abc") == ["jwt"]
    assert secrets.redact("a visa: 4111111111111111 b", secrets.scan("a visa: 4111111111111111 b", secrets.automaton())) == "a visa: [card] b"


HOSTILE = ["token", "secret:", "AKIA", "ghp_", "npm_", "card ", "visa", "4111", " ", "-", "iban ", "GB82WEST", "-----BEGIN ", "PRIVATE KEY-----", "-----END ", "eyJ", "eyJhIjoxfQ", ".", "=", "[", "{", "\x00", "\u212a", "\u0130", "\U0001f642", "9" * 40, "a" * 40, "Z" * 40]


def test_a_deeply_nested_header_is_no_token():
    deep = base64.urlsafe_b64encode(b'{"a":' + b"[" * 20000).decode().rstrip("=")
    assert secrets.scan(f"x {deep}.eyJhIjoxfQ.abc", secrets.automaton()) == []
    assert not secrets._jwt("eyJ" + "9" * 9000 + ".x.y")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(HOSTILE), max_size=60).map("".join))
def test_no_text_makes_a_rule_raise(text):
    for kind, a, b in secrets.scan(text, secrets.automaton()):
        assert kind in secrets.KINDS and 0 <= a < b <= len(text)


def test_very_long_texts_are_scanned_in_proportion():
    words = secrets.automaton()
    for piece in HOSTILE:
        text = piece * (3_000_000 // len(piece))
        began = time.process_time()
        secrets.scan(text, words)
        assert time.process_time() - began < 30, piece


def test_frame_matches_brute_force_and_edge_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(None, None, "x"), (-1, "", "x"), (-2, "secret: token: abcdefghijk", "x"), (-2, "secret: token: abcdefghijk", "x")], "doc_id long, text string, spans string")
    docs = docs.select("doc_id", "text").unionByName(extra, allowMissingColumns=True)
    want = sorted((str(r.doc_id), secrets._joined(brute(r.text))) for r in docs.collect())
    got = secrets.find(docs).collect()
    assert sorted((str(r.doc_id), r.base_spans) for r in got) == want
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got) == sum(len(w.split(",")) for _, w in want if w)
    assert secrets.find(docs.limit(0)).count() == 0
