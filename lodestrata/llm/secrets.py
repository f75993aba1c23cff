"""Secret scans with structural confirmation.

Candidates are runs of base64, base64url or hex digits (a run may go on over
line breaks inside a PEM frame; written escapes of line breaks count as such, and
a base64 run that holds a PEM frame may be wrapped). Each is decoded, and reported
only if the bytes have the structure of a secret:

- ``jwt``: three dotted base64url parts whose header is a JSON object with a
  known "alg", whose payload is a JSON object, and whose signature is as long as
  the algorithm makes it;
- ``pkcs1``, ``pkcs8``, ``encrypted_pkcs8``, ``sec1``, ``dsa``: DER whose nested
  lengths add up exactly and whose fields are those of a private key, in a PEM
  frame or bare, in base64 or hex; or a PEM frame that is itself in base64;
- ``openssh``: the OpenSSH magic followed by length-prefixed strings;
- ``checked_token``: a prefixed token whose last six base-62 digits are the CRC-32
  of what stands before them;
- ``access_key_id``: a cloud key's prefix and 16 base-32 digits, whose bytes hold
  an account number of at most twelve digits that isn't 0.

Besides these, whose basis is ``structure``, values without any structure are reported
with the basis ``assignment``, so that they can be told apart:

- ``raw_key``: the value of an assignment to a key (not a public one), token,
  secret or password, quoted or not, in hex or base64, that decodes to a usual
  number of key bytes which are neither text nor repetitive. In base64 it must
  also not look like a name, whose neighbours are mostly of one class (small
  letters, capitals, digits);
- ``password``: the hex value of an assignment to a password, of eight bytes or
  more, that is neither text nor repetitive.

Public keys, certificates, digests without such an assignment, identifiers and
base64 of anything else are not reported.

Defined results: null and empty texts have no findings. Offsets count characters
of the text. A secret that appears twice is reported at both places; overlapping
candidates are reported once, the first and longest. Rows are scanned one by one,
whole, whatever repeats; null ids are reported as null. Ids that aren't whole numbers are
returned as strings; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_kind, id_of, text_slices
from .vec import runs

#: Kinds that rest on an assignment, not on structure.
ASSIGNED = ("raw_key", "password")
#: Every secret has so many of these signs in a row (a token's shortest header has 19, a password 16), or one of these
#: frames, plain or in base64; other texts aren't searched.
RUN, FRAMES = 16, ("-----BEGIN ", "LS0tLS1CRUdJTi")
_SIGNS, _DIGITS = np.zeros(256, bool), np.zeros(256, bool)
_DIGITS[list(b"0123456789abcdefABCDEF")] = True
_SIGNS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")] = True
_ESCAPE = re.compile(r"\\+(?:r\\+n|[nr])")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:[^-]|-(?!----))*)-----END \1PRIVATE KEY-----")
#: Where a run begins: not inside another, but right after a written escape.
_FROM = r"(?:(?<=\\[nrt])|(?<![0-9A-Za-z{}])(?!(?<=\\)[nrt]))"
_JWT = re.compile(_FROM.format("_-") + r"(eyJ[\w-]+)\.(eyJ[\w-]+)\.([\w-]*)(?![\w-])", re.A)
_HEX = re.compile(_FROM.format("+/_-") + r"[0-9A-Fa-f]{32,}(?![0-9A-Za-z+/=_-])")
_BLOB = re.compile(_FROM.format("+/_-") + r"[A-Za-z0-9+/_-]{40,}={0,2}(?![A-Za-z0-9+/_=-])")
#: base64 of "-----BEGIN ", over lines.
_WRAPPED = re.compile(_FROM.format("+/_-") + r"LS0tLS1CRUdJTi[A-Za-z0-9+/]+(?:(?:\s|\\+[rn])+(?!LS0tLS1CRUdJTi)[A-Za-z0-9+/]+)*={0,2}")
_CHECKED = re.compile(_FROM.format("") + r"([a-z]{2,5}_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_CLOUD = re.compile(_FROM.format("+/_-") + r"A[KS]IA([A-Z2-7]{16})(?![0-9A-Za-z+=_-]|/(?!\d{8}/))")  # signed requests have a date after it
#: What small letters of every text with a name in _NAME hold.
_NAMES = ("key", "token", "secret", "passw", "pwd", "credential")
_NAME = r"(?:(?<!pub)(?<!public)(?<!pub[ _-])(?<!public[ _-])key|token|secret|passw(?:or)?d|pwd|credential)s?[\\\"']*\s*(?::=|=>?|:)\s*[\\\"']*"
_NAMED = re.compile(rf"(?i:{_NAME})(?=[0-9A-Fa-f]{{32}})")
_ASSIGNED = re.compile(rf"(?i:{_NAME})([A-Za-z0-9+/_-]{{22,}}={{0,2}})(?![A-Za-z0-9+/=_-])")
_PASSWORD = re.compile(r"(?:passw(?:or)?d|passphrase|pwd)[\"']?\s*[:=]\s*[\"']?([0-9a-f]{16,}|[0-9A-F]{16,})(?![0-9A-Za-z])", re.I)
_BASE62 = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")}
_SIGNATURE = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EDDSA": (64, 114), "NONE": (0,), **{a: (128, 256, 384, 512, 1024) for a in ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")}}
KEY_BYTES = (16, 20, 24, 32, 48, 64)
BASE64_KEY_BYTES = (*KEY_BYTES, 30)  # cloud secret access keys have 40 digits
_LEAST = 16  # bytes of a DER key at least

Node = tuple[int, int, int]  # tag, start and end of the contents


def unbase64(text: str) -> bytes | None:
    """Bytes of base64 or base64url, with or without padding; None if it isn't."""
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    text = text.replace("-", "+").replace("_", "/") + "=" * (-len(text) % 4)
    try:
        return base64.b64decode(text, validate=True)
    except binascii.Error:
        return None


def der(data: bytes, start: int = 0, end: int | None = None) -> list[Node] | None:
    """The elements of data[start:end], which they must fill exactly; None if they don't."""
    end = len(data) if end is None else end
    out: list[Node] = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if tag & 31 == 31 or size == 128:
            return None
        if size > 128:
            n = size - 128
            if n > 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n])
            if size < 128 or data[at] == 0:
                return None  # DER's lengths are the shortest
            at += n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        start = at + size
    return out


def der_kind(data: bytes) -> str | None:
    """Kind of private key that *data* encodes."""
    top = der(data)
    if not top or len(top) != 1 or top[0][0] != 0x30 or len(data) < _LEAST:
        return None
    parts = der(data, *top[0][1:])
    if not parts:
        return None
    tags = [p[0] for p in parts]
    number = lambda i: int.from_bytes(data[parts[i][1] : parts[i][2]])
    if tags[0] == 2 and len(tags) >= 9 and all(t == 2 for t in tags[:9]) and number(0) in (0, 1):
        n, p, q = number(1), number(4), number(5)
        return "pkcs1" if n == p * q else None
    if tags == [2] * 6 and number(0) == 0:
        p, g, y, x = (number(i) for i in (1, 3, 4, 5))
        return "dsa" if p and pow(g, x, p) == y else None
    if tags[:3] == [2, 0x30, 4] and number(0) in (0, 1):
        algorithm = der(data, *parts[1][1:])
        return "pkcs8" if algorithm and algorithm[0][0] == 6 and parts[2][1] < parts[2][2] else None
    if tags[:2] == [2, 4] and number(0) == 1 and 16 <= parts[1][2] - parts[1][1] <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "sec1"
    if tags == [0x30, 4]:
        algorithm = der(data, *parts[0][1:])
        oid = data[algorithm[0][1] : algorithm[0][2]] if algorithm and algorithm[0][0] == 6 else b""
        # Password-based encryption: PKCS 5 and PKCS 12 schemes.
        return "encrypted_pkcs8" if oid.startswith((bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))) else None
    return None


def openssh(data: bytes) -> bool:
    """Whether *data* is the magic, three strings, a number of keys, and as many public parts and one private part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, strings, keys = len(magic), 0, None
    while at < len(data):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4])
        at += 4
        if strings == 3 and keys is None:
            keys = size
            continue
        if at + size > len(data):
            return False
        at, strings = at + size, strings + 1
    return keys is not None and 0 < keys and strings == 3 + keys + 1


def bytes_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return der_kind(data) if data[0] == 0x30 else "openssh" if openssh(data) else None


def _object(part: str) -> dict | None:
    raw = unbase64(part)
    try:
        got = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _jwt(m: re.Match) -> bool:
    head, body, signature = _object(m[1]), _object(m[2]), unbase64(m[3])
    if head is None or body is None or signature is None:
        return False
    sizes = _SIGNATURE.get(str(head.get("alg")).upper())
    return sizes is not None and len(signature) in sizes


def _account(digits: str) -> int:
    """The account number in a cloud key id: 40 bits after the first."""
    return int.from_bytes(base64.b32decode(digits)[:6]) >> 7 & (1 << 40) - 1


def _random(data: bytes) -> bool:
    """Neither text nor repetitive."""
    return len(set(data)) > len(data) // 3 and not all(9 <= b < 127 for b in data)


def _raw(data: bytes) -> bool:
    return len(data) in KEY_BYTES and _random(data)


def _raw_base64(text: str) -> bool:
    """Whether *text* is base64 of a key's bytes, and neither hex nor a name or path."""
    digits = text.rstrip("=")
    classes = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in digits]
    alike = sum(a == b for a, b in zip(classes, classes[1:]))
    data = unbase64(text)
    return data is not None and len(data) in BASE64_KEY_BYTES and _random(data) and alike < 0.6 * len(digits) and {"a", "A"} <= set(classes)


def _pems(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the private keys in PEM frames."""
    for m in _PEM.finditer(text):
        inner = _ESCAPE.sub("\n", m[2]).replace("\\", "")
        body = "".join(line for line in inner.split("\n") if ":" not in line)  # without an encryption header
        data = unbase64("".join(body.split()))
        kind = bytes_kind(data)
        if kind is None and data and "Proc-Type: 4,ENCRYPTED" in inner and len(data) >= 64 and len(data) % 8 == 0:
            kind = "encrypted_pem"
        if kind:
            yield m.start(), m.end(), kind


def _base64_kind(text: str) -> str | None:
    """Kind of the private key that *text* holds in base64: its bytes, or a PEM frame."""
    data = unbase64(text)
    kind = bytes_kind(data)
    if kind is None and data and b"PRIVATE KEY-----" in data:
        kind = next((k for *_, k in _pems(data.decode("latin-1"))), None)
    return kind


def _wrapped(m: re.Match) -> tuple[int, int, str] | None:
    """The private key in base64 of a PEM frame over lines, as far as the line or word that holds its end."""
    parts = [*re.finditer(r"\S+", _ESCAPE.sub(lambda e: " " * len(e[0]), m[0]))]
    digits = "".join(p[0] for p in parts).rstrip("=")
    data = unbase64(digits[: len(digits) - (len(digits) % 4 == 1)])
    for _, end, kind in _pems((data or b"").decode("latin-1")):
        left = -(-end * 4 // 3)
        for p in parts:
            left -= len(p[0].rstrip("="))
            if left <= 0:
                return m.start(), m.start() + p.end(), kind
    return None


def find(text: str | None, longest: int = 1 << 31, digits: int = 1 << 31) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets, in order, without overlaps.

    Searches that can't succeed, since the text has no more than *longest* signs or *digits* hex digits in a row, are left out.
    """
    if not text:
        return []
    found = list(_pems(text))
    if "eyJ" in text:
        found += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if _jwt(m)]
    for m in _CHECKED.finditer(text) if longest >= 39 else ():
        value = 0
        for c in m[3]:
            value = value * 62 + _BASE62[c]
        if value == zlib.crc32(m[2].encode()):
            found.append((m.start(), m.end(), "checked_token"))
    if "AKIA" in text or "ASIA" in text:
        found += [(m.start(), m.end(), "access_key_id") for m in _CLOUD.finditer(text) if 0 < _account(m[1]) < 10**12]
    lower = text.lower().replace("\u017f", "s")  # as re.I has it; the Kelvin sign becomes k
    if "passw" in lower or "passphrase" in lower or "pwd" in lower:
        for m in _PASSWORD.finditer(text):
            if len(m[1]) % 2 == 0 and _random(bytes.fromhex(m[1])):
                found.append((m.start(1), m.end(1), "password"))
    any_name = longest >= 22 and any(n in lower for n in _NAMES)
    if digits >= 32:
        named = {m.end() for m in _NAMED.finditer(text)} if any_name else ()
        for m in _HEX.finditer(text):
            if len(m[0]) % 2 == 0:
                data = bytes.fromhex(m[0])
                kind = bytes_kind(data)
                if kind is None and m.start() in named and _raw(data):
                    kind = "raw_key"
                if kind:
                    found.append((m.start(), m.end(), kind))
    for m in _BLOB.finditer(text) if longest >= 40 else ():
        if kind := _base64_kind(m[0]):
            found.append((m.start(), m.end(), kind))
    if FRAMES[1] in text:
        found += [f for m in _WRAPPED.finditer(text) if (f := _wrapped(m))]
    if any_name:
        found += [(m.start(1), m.end(1), "raw_key") for m in _ASSIGNED.finditer(text) if _raw_base64(m[1])]
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[tuple[int, int, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def longest(text: pa.Array, member: np.ndarray) -> np.ndarray:
    """The longest run of bytes in *member* of each text."""
    out = np.zeros(len(text), np.int64)
    for data, offsets, at in text_slices(text):
        starts, ends = runs(data, offsets, member)
        some = np.flatnonzero(ends - starts >= RUN)
        np.maximum.at(out, at + np.searchsorted(offsets, starts[some], side="right") - 1, (ends - starts)[some])
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(1)
        signs, digits = longest(text, _SIGNS), longest(text, _DIGITS)
        some = signs >= RUN
        for frame in FRAMES:
            some |= pc.match_substring(text, frame).fill_null(False).to_numpy(zero_copy_only=False)
        found = [(i, *f) for i in np.flatnonzero(some).tolist() for f in find(text[i].as_py(), signs[i], digits[i])]
        rows, at, end, kind = zip(*found) if found else ((), (), (), ())
        ids = batch.column(0).take(pa.array(rows, pa.int64()))
        basis = ["assignment" if k in ASSIGNED else "structure" for k in kind]
        yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int64()), pa.array(end, pa.int64()), pa.array(kind, pa.string()), pa.array(basis, pa.string())], names=["doc_id", "start", "end", "kind", "basis"])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, kind, basis): a row for each secret, never its value."""
    bounded(docs)
    slim = docs.select(id_of(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text <> ''")
    return slim.mapInArrow(_scan, f"doc_id {id_kind(docs, id_col)}, start long, end long, kind string, basis string")
