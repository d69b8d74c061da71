"""Secret scan with structural confirmation.

Plain patterns (assignments, access keys, hex runs) are reported as they match. Beyond these, base64 and hex candidates
are decoded and reported only if what they hold parses: a DER private key whose nested lengths add up, an OpenSSH private key
whose length-prefixed fields do, or a signed token whose header is a JSON object that names an algorithm. Keys may be
wrapped, with line ends as such or escaped as in JSON and environment files, and indented; armour marks are no part of a
span. Public keys are no secrets and are not reported.

A null text is empty. Spans are code points, end exclusive, sorted by start and then kind. Texts are scanned whole, rows are
independent, so ties, repeated rows and extra columns need no rule. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KEYWORDS = (b"passw", b"secret", b"token", b"api")
#: Order of kinds at the same start.
KINDS = ("assign", "access", "hex", "signed_token", "der_key", "ssh_key", "hex_key")

TOKEN = re.compile(rb"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{16,}")
#: A base64 run may go on over line ends, as armoured keys do; `_keys` looks for where keys in it start and end.
LINE_END = rb"[\\ \t\r]*\n[ \t]*"
BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{40,}(?:" + LINE_END + rb"[A-Za-z0-9+/_-]{4,})*(?:" + LINE_END + rb"[A-Za-z0-9+/_-]{2,3}(?==))?={0,2}")
HEX_ANY = re.compile(rb"(?:[0-9a-fA-F]{2}){32,}")
LEAST_RUN = 40

_ALNUM = np.full(256, 32, np.uint8)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 47, 45, 95]] = 120
_ALNUM = _ALNUM.tobytes()
_HEXMAP = np.full(256, 32, np.uint8)
_HEXMAP[[*range(48, 58), *range(97, 103)]] = 120
_HEXMAP = _HEXMAP.tobytes()


def _der(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value of the DER element at `at`, if it lies before `end`."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= end else None


def _children(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        x = _der(b, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


def is_der_key(b: bytes) -> bool:
    """A SEQUENCE that fills b (but for padding) and has the shape of a PKCS#1, PKCS#8 or SEC1 private key."""
    top = _der(b, 0, len(b)) if b[:1] == b"\x30" else None
    if top is None or len(b) - top[2] > 2:
        return False
    kids = _children(b, top[1], top[2])
    if not kids or len(kids) < 2:
        return False
    tags = [k[0] for k in kids]
    if tags[0] == 2 and len(tags) >= 9 and set(tags[:9]) == {2}:
        return True  # RSA private key: version and eight integers
    if tags[0] == 2 and len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 4:
        return _children(b, kids[1][1], kids[1][2]) is not None  # PKCS#8
    # SEC1 EC private key
    return tags[0] == 2 and tags[1] == 4 and kids[1][2] - kids[1][1] in (20, 24, 28, 32, 48, 66)


def is_ssh_key(b: bytes) -> bool:
    """OpenSSH private key file: fields with four-byte lengths, as many as its headers state, within b."""
    n = _stated(b) if b.startswith(b"openssh-key-v1\0") else None
    return n is not None and n <= len(b)


def _b64(b: bytes) -> bytes | None:
    b = re.sub(rb"[\r\n=]", b"", b).translate(bytes.maketrans(b"-_", b"+/"))
    try:
        return base64.b64decode(b[: len(b) - (len(b) % 4 == 1)] + b"=" * (-(len(b) - (len(b) % 4 == 1)) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _stated(b: bytes) -> int | None:
    """Length that the first header of a DER or OpenSSH private key states, None if it is neither or incomplete."""
    if b[:1] == b"\x30" and len(b) >= 2:
        k = b[1] & 0x7F if b[1] & 0x80 else 0
        return 2 + k + (int.from_bytes(b[2 : 2 + k], "big") if k else b[1])
    if b.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):
            at += 4 + int.from_bytes(b[at : at + 4], "big")
        keys = int.from_bytes(b[at : at + 4], "big")
        at += 4
        for _ in range(keys + 1):
            if at + 4 > len(b):
                return None
            at += 4 + int.from_bytes(b[at : at + 4], "big")
        return at
    return None


def _keys(run: bytes) -> list[tuple[int, int, str]]:
    """Keys in a base64 run without armour marks: they start with a line and end with one, as far as their headers say."""
    lines = [m.span() for m in re.finditer(rb"[A-Za-z0-9+/_-]+", run)]
    flat = b"".join(run[s:e] for s, e in lines)
    upto = np.cumsum([0] + [e - s for s, e in lines])
    out, k = [], 0
    while k < len(lines):
        s, e = lines[k]
        last, kind = None, None
        if e - s >= LEAST_RUN and run[s : s + 1] == b"M":
            head = _b64(run[s : s + 8])
            n = _stated(head) if head else None
            last, kind = _line_end(upto, k, n), "der_key"
            if last is not None and not ((b := _b64(flat[upto[k] : upto[last + 1]])) and is_der_key(b)):
                last = None
        elif e - s >= LEAST_RUN and run[s : s + 4] == b"b3Bl":
            b, kind = _b64(flat[upto[k] :]), "ssh_key"
            if b and is_ssh_key(b):
                last = _line_end(upto, k, _stated(b))
        if last is None:
            k += 1
            continue
        e = lines[last][1]
        out.append((s, e + re.match(rb"=*", run[e : e + 2]).end(), kind))
        k = last + 1
    return out


def _line_end(upto: np.ndarray, k: int, n: int | None) -> int | None:
    """The line with which n bytes that start with line k end, give or take two bytes of padding."""
    if n is None:
        return None
    chars = -(-4 * n // 3)
    j = int(np.searchsorted(upto, upto[k] + chars))
    return j - 1 if j < len(upto) and upto[j] - upto[k] <= chars + 3 else None


def is_signed_token(b: bytes) -> bool:
    head = _b64(b.split(b".", 1)[0])
    try:
        x = json.loads(head.decode("utf-8")) if head else None
    except ValueError:
        return False
    return isinstance(x, dict) and isinstance(x.get("alg"), str)


def find(text: bytes) -> list[tuple[int, int, str]]:
    """Byte spans (start, end, kind) in one text."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if b"x" * 24 in text.translate(_HEXMAP):
        out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if b"x" * LEAST_RUN in text.translate(_ALNUM):
        # escaped line ends as such, in the same places
        for m in BASE64.finditer(text.replace(b"\\r\\n", b"  \r\n").replace(b"\\n", b"\r\n")):
            # armour marks consist of letters of the run
            at = m.start()
            for piece in m[0].split(b"-----"):
                if len(piece) >= LEAST_RUN:
                    out += [(at + s, at + e, kind) for s, e, kind in _keys(piece)]
                at += len(piece) + 5
        for m in HEX_ANY.finditer(text):
            if is_der_key(b := bytes.fromhex(m[0].decode())) or is_ssh_key(b):
                out.append((*m.span(), "hex_key"))
    if b"eyJ" in text:
        out += [(*m.span(), "signed_token") for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if not spans or text.isascii():
        return spans
    at = tc.code_points(np.frombuffer(text, np.uint8))
    return [(int(at[s]), int(at[e]), k) for s, e, k in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) per row: spans is an array of (kind, start, end), empty if nothing was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in tc.slices(batches, "text"):
            data, off = tc.raw(tc.text_column(b, "text"))
            data = data.tobytes()
            texts = [data[off[i] : off[i + 1]] for i in range(b.num_rows)]
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in _points(t, find(t))] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["id", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = src.mapInArrow(run, "id long, spans array<struct<kind:string,start:long,end:long>>")
    return found.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every reported span replaced by `mask` (overlapping spans by one); other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text_col)
            out = []
            for t in b.column(k).to_pylist():
                if t:
                    raw = t.encode()
                    spans = find(raw)
                    if spans:
                        parts, at = [], 0
                        for s, e, _ in spans:
                            if s >= at:
                                parts += [raw[at:s], mask.encode()]
                            at = max(at, e)
                        t = (b"".join(parts) + raw[at:]).decode()
                out.append(t)
            cols = list(b.columns)
            cols[k] = pa.array(out, b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
