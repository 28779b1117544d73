"""Secret scan with structural confirmation.

Patterns alone flag many harmless strings.  Besides the spans of the base
patterns, this scan reports candidates only after decoding them: base64 or hex
that parses as a private key (PKCS#1, PKCS#8, SEC1 or DSA, every nested length
accounted for) or as an SSH key, PEM blocks whose body does, and signed tokens
whose header and payload are the JSON they should be.

A candidate is decoded only as far as its own lengths reach, and where a run of
base64 has separators in it, each part behind one is a candidate, so keys are
found behind a path or a name.  The time is linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base contract.
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: Order of kinds at one start.
KINDS = ("assign", "access", "hex", "pem", "token", "der", "ssh")

#: A maximal run of ``[0-9a-f]+`` that is long enough.
_HEX_RUN = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
_MARKER = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)")
#: Base64 over one or more lines, the line ends as they are or escaped.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}+(?:(?:\r?\n|(?:\\r)?\\n)[A-Za-z0-9+/_-]++)*+={0,2}")
_LINE_END = re.compile(r"\r?\n|(?:\\r)?\\n")
_HEX_ANY = re.compile(r"(?<![0-9A-Za-z])(?:0x)?([0-9A-Fa-f]{32,})(?![0-9A-Za-z])")
#: A sequence of 32 bytes or more, a length of three zero bytes or the name of the SSH container, at a line's start or behind a separator.
_CANDIDATE = re.compile(r"(?:^|(?<![A-Za-z0-9]))(?=M[C-I]|AAAA|b3BlbnNzaC1rZXktdjEA)")
LEAST = 32

#: Parts of a public key by algorithm, and the beginning of the private container.
_SSH_PARTS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3}
_SSH_PRIVATE = b"openssh-key-v1\x00"
#: Object ids (PKCS#5 and PKCS#12) of the schemes that encrypt keys.
_ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))

_VALUE = {c: k for k, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}


def decode_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64 with or without padding; null when it is neither."""
    body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class Encoded:
    """The bytes that base64 characters from ``start`` on stand for, decoded where they are read."""

    def __init__(self, chars: str, start: int):
        self._chars, self._start = chars, start
        self.size = (len(chars) - start) * 6 // 8

    def byte(self, i: int) -> int:
        k, shift = divmod(8 * i, 6)
        k += self._start
        return (_VALUE[self._chars[k]] << (2 + shift) | _VALUE[self._chars[k + 1]] >> (4 - shift)) & 0xFF

    def read(self, a: int, b: int) -> bytes:
        return bytes(self.byte(i) for i in range(a, b))


class Plain:
    """The same interface over bytes."""

    def __init__(self, data: bytes):
        self._data, self.size = data, len(data)

    def byte(self, i: int) -> int:
        return self._data[i]

    def read(self, a: int, b: int) -> bytes:
        return self._data[a:b]


def _element(data: Encoded | Plain, start: int, end: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the content of the DER element at ``start``; null when its length is not minimal or exceeds ``end``."""
    if end - start < 2:
        return None
    tag, size = data.byte(start), data.byte(start + 1)
    start += 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or end - start < width:
            return None
        size = int.from_bytes(data.read(start, start + width), "big")
        if size < 0x80 or width > 1 and not data.byte(start):
            return None
        start += width
    return (tag, start, start + size) if size <= end - start else None


def _elements(data: Encoded | Plain, start: int, end: int, limit: int = 12) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``start`` to ``end`` exactly, at most ``limit``."""
    found = []
    while start < end:
        x = _element(data, start, end)
        if x is None or len(found) == limit:
            return None
        found.append(x)
        start = x[2]
    return found


def private_key_end(data: Encoded | Plain) -> int | None:
    """Where the private key ends that begins the data: one sequence, all of whose nested lengths agree and whose parts are those of a key."""
    if data.size < 24:
        return None
    whole = _element(data, 0, data.size)
    if whole is None or whole[0] != 0x30:
        return None
    parts = _elements(data, whole[1], whole[2])
    if not parts:
        return None
    tags = [t for t, _, _ in parts]
    if tags[0] == 0x02:
        version = data.read(parts[0][1], min(parts[0][2], parts[0][1] + 2))
        if version not in (b"\x00", b"\x01") or any(a == b for t, a, b in parts if t in (0x02, 0x04)):
            return None
        numbers = set(tags) == {0x02} and len(tags) in (6, 9) or len(tags) == 10 and set(tags[:9]) == {0x02} and tags[9] == 0x30
        if numbers or tags[1] == 0x04 and all(t in (0xA0, 0xA1) for t in tags[2:]) and _filled(data, parts[2:]):
            return whole[2]
        if tags[1:3] == [0x30, 0x04] and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
            algorithm, inner = _elements(data, *parts[1][1:]), _element(data, *parts[2][1:])
            if algorithm and algorithm[0][0] == 0x06 and inner and inner[2] == parts[2][2] and inner[0] in (0x02, 0x04, 0x30):
                return whole[2]
    elif tags == [0x30, 0x04]:
        algorithm = _elements(data, *parts[0][1:])
        if algorithm and algorithm[0][0] == 0x06 and data.read(algorithm[0][1], min(algorithm[0][2], algorithm[0][1] + 8)) in _ENCRYPTED:
            return whole[2]
    return None


def _filled(data: Encoded | Plain, parts: list[tuple[int, int, int]]) -> bool:
    return all((x := _element(data, a, b)) is not None and x[2] == b for _, a, b in parts)


def _strings(data: Encoded | Plain, at: int, count: int) -> int | None:
    """Where ``count`` length-prefixed strings from ``at`` on end."""
    for _ in range(count):
        if data.size - at < 4:
            return None
        at += 4 + int.from_bytes(data.read(at, at + 4), "big")
        if at > data.size:
            return None
    return at


def ssh_key_end(data: Encoded | Plain) -> int | None:
    """Where the SSH key ends that begins the data: the strings of a known algorithm, or the container of private keys."""
    if data.read(0, min(data.size, len(_SSH_PRIVATE))) == _SSH_PRIVATE:
        at = _strings(data, len(_SSH_PRIVATE), 3)
        if at is None or data.size - at < 4:
            return None
        keys = int.from_bytes(data.read(at, at + 4), "big")
        return _strings(data, at + 4, keys + 1) if 1 <= keys <= 64 else None
    if data.size < 16:
        return None
    size = int.from_bytes(data.read(0, 4), "big")
    parts = _SSH_PARTS.get(data.read(4, 4 + size)) if size <= min(32, data.size - 4) else None
    return _strings(data, 0, parts) if parts else None


def _json_object(text: str) -> dict | None:
    raw = decode_base64(text)
    if raw is None:
        return None
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(header: str, payload: str) -> bool:
    """JSON objects both, the first naming an algorithm."""
    found = _json_object(header)
    return found is not None and isinstance(found.get("alg"), str) and _json_object(payload) is not None


Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= MIN_VALUE] if _may_assign(text) else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found + [(m.start(), m.end(), "hex") for m in _HEX_RUN.finditer(text)]


def _may_assign(text: str) -> bool:
    return ":" in text or "=" in text


_KINDS_OF_KEYS = (("der", private_key_end), ("ssh", ssh_key_end))


def pem_spans(text: str) -> list[Span]:
    """Blocks between a header and the footer that follows it, whose body is a key; line ends may be escaped."""
    found: list[Span] = []
    begun = None
    for m in _MARKER.finditer(text):
        if m.group(1) == "BEGIN":
            begun = m
            continue
        if begun is not None and begun.group(2) == m.group(2):
            body = _LINE_END.sub("\n", text[begun.end() : m.start()])
            raw = decode_base64(re.sub(r"(?m)^[A-Za-z-]++:.*$", "", body))
            if raw is not None and any(end(Plain(raw)) == len(raw) for _, end in _KINDS_OF_KEYS):
                found.append((begun.start(), m.end(), "pem"))
        begun = None
    return found


def base64_spans(text: str) -> list[Span]:
    found: list[Span] = []
    for area in _BASE64.finditer(text):
        if area.end() - area.start() < LEAST:
            continue
        raw = area.group().rstrip("=").replace("-", "+").replace("_", "/")
        # Where each line begins in the text and in the joined lines.
        places = [0, *(m.end() for m in _LINE_END.finditer(raw))]
        ends = [*(m.start() for m in _LINE_END.finditer(raw)), len(raw)]
        joined = "".join(raw[a:b] for a, b in zip(places, ends, strict=True)) if len(places) > 1 else raw
        starts = [0, *accumulate(b - a for a, b in zip(places, ends, strict=True))]
        done = 0
        for k, line in enumerate(zip(places, ends, strict=True)):
            for m in _CANDIDATE.finditer(raw, *line):
                p = starts[k] + m.start() - line[0]
                if p < done or len(joined) - p < LEAST:
                    continue
                data = Encoded(joined, p)
                kind, end = next(((kind, end) for kind, test in _KINDS_OF_KEYS if (end := test(data)) is not None), (None, 0))
                if kind:
                    done = p + -(-end * 8 // 6)
                    last = bisect_right(starts, done - 1) - 1
                    stop = area.end() if done == len(joined) else area.start() + places[last] + done - starts[last]
                    found.append((area.start() + m.start(), stop, kind))
    return found


def confirmed_spans(text: str) -> list[Span]:
    found = pem_spans(text) if "PRIVATE KEY-----" in text else []
    if "." in text:
        found += [(m.start(), m.end(), "token") for m in _TOKEN.finditer(text) if is_signed_token(m.group(1), m.group(2))]
    found += base64_spans(text)
    for m in _HEX_ANY.finditer(text):
        if len(m.group(1)) % 2 == 0:
            data = Plain(bytes.fromhex(m.group(1)))
            found += [(m.start(), m.end(), kind) for kind, end in _KINDS_OF_KEYS if end(data) == data.size]
    return found


def _joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(set(found), key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    """``n_assign, n_access, n_hex``, digest of the base spans, all spans; positions are code points, ends exclusive."""
    text = text or ""
    base = base_spans(text)
    counts = [sum(kind == k for _, _, kind in base) for k in KINDS[:3]]
    return *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + confirmed_spans(text))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    The whole text is scanned.  Null and empty texts have no spans (the digest
    is that of the empty string); a null id is passed through; repeated rows
    give repeated results; an empty table an empty one.  Texts of any length
    take linear time.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(x.as_py()) for x in batch.column(1)]
            n1, n2, n3, digest, spans = zip(*rows, strict=True) if rows else ((),) * 5
            longs = [pa.array(n, pa.int64()) for n in (n1, n2, n3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, schema)
