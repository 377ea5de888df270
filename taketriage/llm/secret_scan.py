"""Secret scans: patterns propose, decoded structure confirms.

Base kinds (assign, access, hex) are plain patterns.  The method decodes
base64 and hex candidates and reports those whose bytes are a private key
encoding with consistent nested lengths (``der``: PKCS #8, plain or encrypted,
PKCS #1, SEC 1, DSA, PKCS #12), an OpenSSH private key (``ssh``), an armoured
private key (``pem``, with or without headers), or a signed token whose header
parses (``token``).  Public keys and certificates are no secrets.

Base64 may be of either alphabet, follow a name and ``=`` or ``/``, and go on
over lines, the breaks real or written as ``\\n``: an encoding tells its own
length, and what is reported ends where a run of base64 ends.

A null text counts as empty; an empty text has no spans and the digest of the
empty string.  Repeated rows are scanned alike, one result each; an empty
table gives no rows; other columns of any name are ignored.  Texts of any
length are scanned whole; a batch is made into Python strings a few megabytes
at a time.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import id_text, map_batches

BASE = ("assign", "access", "hex")
CONFIRMED = ("token", "pem", "der", "ssh")
KINDS = {k: i for i, k in enumerate(BASE + CONFIRMED)}

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a maximal run of 24 or more is what a maximal run filtered by length gives
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# '{' and any second character, in base64
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[w-z][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:(?!-----).)*)-----END \1-----", re.S)
_BREAK = r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*"
_RUN = r"[A-Za-z0-9+/_-]"
_LINES64 = re.compile(rf"(?:(?<=\\)[nr])?({_RUN}{{16,}}(?:{_BREAK}{_RUN}+)*)")
_LINE64 = re.compile(rf"(?:\\r|\\n)|({_RUN}+)")
# in base64: a SEQUENCE and its length, "openssh-key-v1"
_MAGIC = b"openssh-key-v1\0"
_SSH64 = base64.b64encode(_MAGIC).decode()
_START = re.compile(rf"(?<![A-Za-z0-9])(?:M[A-I]|{_SSH64})")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}")
#: In hex: a SEQUENCE, "openssh-key-v1".
_HEX_STARTS = ("30", _MAGIC.hex())
_SSH_NAMES = (b"ssh-", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")
_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def decoded64(s: str, urlsafe: bool = False) -> bytes | None:
    s = s.rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        raw = (s + "=" * (-len(s) % 4)).encode("ascii")
        return base64.b64decode(raw, altchars=b"-_" if urlsafe else None, validate=True)
    except (binascii.Error, ValueError, UnicodeEncodeError):
        return None


def _urlsafe(s: str) -> bool:
    return "-" in s or "_" in s


def der_length(b: bytes, at: int, end: int | None = None) -> tuple[int, int] | None:
    """Content start and end of the tag-length-value at ``at``, if it fits."""
    end = len(b) if end is None else end
    if at + 2 > end:
        return None
    n, at = b[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        n, at = int.from_bytes(b[at : at + size], "big"), at + size
        if n < 0x80:
            return None  # not the shortest form
    return (at, at + n) if at + n <= end else None


def der_parts(b: bytes) -> list[tuple[int, int, int]] | None:
    """(tag, content start, end) of the elements of a SEQUENCE that fills ``b``,
    if all lengths nested in it fit; every element is looked at once."""
    if not b or b[0] != _SEQUENCE or (top := der_length(b, 0)) is None or top[1] != len(b):
        return None
    todo, first = [top], None
    while todo:
        at, end = todo.pop()
        parts = []
        while at < end:
            if (part := der_length(b, at, end)) is None:
                return None
            parts.append((b[at], *part))
            if b[at] & 0x20:
                todo.append(part)
            at = part[1]
        first = parts if first is None else first
    return first


def is_private_der(b: bytes) -> bool:
    """A private key encoding: one of the known shapes over consistent lengths."""
    parts = der_parts(b) if len(b) >= 24 else None
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _, _ in parts]
    names = lambda p: b[p[1] : p[1] + 1] == bytes([_OID])
    if tags == [_SEQUENCE, _OCTETS]:  # encrypted PKCS #8
        return names(parts[0]) and parts[1][2] > parts[1][1]
    if tags[0] != _INTEGER or not 1 <= parts[0][2] - parts[0][1] <= 1:
        return False
    version = b[parts[0][1]]
    if tags[1:3] == [_SEQUENCE, _OCTETS]:  # PKCS #8
        return version <= 1 and names(parts[1]) and parts[2][2] > parts[2][1]
    if tags[1] == _OCTETS:  # SEC 1
        return version == 1 and parts[1][2] > parts[1][1] and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[1] == _SEQUENCE:  # PKCS #12
        return version == 3 and names(parts[1]) and all(t == _SEQUENCE for t in tags[2:])
    # PKCS #1: nine numbers, and more primes where the version says so; DSA: six
    return (version == 0 and tags in ([_INTEGER] * 9, [_INTEGER] * 6)) or (version == 1 and tags == [_INTEGER] * 9 + [_SEQUENCE])


def ssh_key_end(read, size: int) -> int | None:
    """Where an OpenSSH private key ends: the magic, cipher, key derivation and
    its options, the number of keys, that many public keys, the private part.

    ``read(at, n)`` gives n bytes; there are ``size``.
    """

    def field(at: int) -> tuple[int, int] | None:
        if at + 4 > size:
            return None
        n = int.from_bytes(read(at, 4), "big")
        return (at + 4, at + 4 + n) if at + 4 + n <= size else None

    if size < len(_MAGIC) or read(0, len(_MAGIC)) != _MAGIC:
        return None
    at, names = len(_MAGIC), []
    for _ in range(3):
        if (f := field(at)) is None:
            return None
        names.append(f)
        at = f[1]
    cipher = read(names[0][0], min(64, names[0][1] - names[0][0]))
    if not cipher or at + 4 > size or not 1 <= (keys := int.from_bytes(read(at, 4), "big")) <= (size - at) // 8:
        return None
    at += 4
    for _ in range(keys):
        if (f := field(at)) is None or (name := field(f[0])) is None or name[1] > f[1]:
            return None
        if not read(name[0], min(16, name[1] - name[0])).startswith(_SSH_NAMES):
            return None
        at = f[1]
    if (f := field(at)) is None or f[1] - f[0] < 8:
        return None
    if cipher == b"none" and read(f[0], 4) != read(f[0] + 4, 4):  # the check numbers agree
        return None
    return f[1]


def is_ssh_key(b: bytes) -> bool:
    return ssh_key_end(lambda at, n: b[at : at + n], len(b)) == len(b)


def is_token(header: str, payload: str, signature: str) -> bool:
    raw, body = decoded64(header, True), decoded64(payload, True)
    if raw is None or body is None:
        return False
    try:
        head, claims = json.loads(raw), json.loads(body)
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(claims, dict) or not isinstance(head.get("alg"), str):
        return False
    return bool(signature) != (head["alg"].lower() == "none")


def is_armoured_key(body: str) -> bool:
    """What stands between the armour lines: headers, a blank line, base64."""
    lines = [x.strip() for x in re.split(r"\r?\n|(?:\\r)?\\n", body.strip("\r\n"))]
    heads = {}
    while lines and (":" in lines[0] or not lines[0]):
        name, _, value = lines.pop(0).partition(":")
        heads[name.strip()] = value.strip()
    raw = decoded64("".join(lines))
    if not raw:
        return False
    if "ENCRYPTED" in heads.get("Proc-Type", ""):  # enciphered in whole blocks
        cipher, _, iv = heads.get("DEK-Info", "").partition(",")
        return bool(cipher) and re.fullmatch(r"(?:[0-9A-Fa-f]{16}){1,2}", iv.strip()) is not None and len(raw) % 8 == 0
    return is_private_der(raw) or is_ssh_key(raw)


def _in_lines(text: str, m: re.Match) -> Iterator[tuple[int, int, str]]:
    """Keys in base64 lines that belong together."""
    lines = [x.span(1) for x in _LINE64.finditer(text, m.start(1), m.end()) if x[1]]
    starts, ends, total = [], [], 0
    for a, b in lines:
        starts.append(total)
        total += b - a
        ends.append(total)
    joined = "".join(text[a:b] for a, b in lines)
    stops = set(ends)

    def original(i: int) -> int:
        k = bisect_right(starts, i) - 1
        return lines[k][0] + i - starts[k]

    def span(i: int, n: int) -> tuple[int, int]:
        end = original(i + n - 1) + 1
        pad = next((k for k in range(-n % 4) if text[end + k : end + k + 1] != "="), -n % 4)
        return original(i), end + pad

    after = 0
    places = {x.start() for x in _START.finditer(joined)} | {i for i in starts if joined.startswith(("M", _SSH64), i)}
    for i in sorted(places):
        if i < after:
            continue
        rest = len(joined) - i

        def read(at: int, n: int, i: int = i) -> bytes:
            a = at // 3 * 4
            part = joined[i + a : i + (at + n + 2) // 3 * 4]
            part = part[: len(part) - (len(part) % 4 == 1)]
            return (decoded64(part, _urlsafe(part)) or b"")[at % 3 : at % 3 + n]

        if joined[i] == "M":
            head = read(0, 6)
            n = head[1] if len(head) == 6 else 0
            size = n & 0x7F if n & 0x80 else 0
            if len(head) < 6 or head[0] != _SEQUENCE or size > 4:
                continue
            total = 2 + size + (int.from_bytes(head[2 : 2 + size], "big") if size else n)
            chars = (total * 4 + 2) // 3
            if total < 24 or chars > rest or i + chars not in stops:
                continue
            part = joined[i : i + chars]
            body = decoded64(part, _urlsafe(part))
            kind = "der" if body is not None and is_private_der(body) else None
        else:
            total = ssh_key_end(read, rest * 3 // 4)
            chars = (total * 4 + 2) // 3 if total else 0
            kind = "ssh" if total and i + chars in stops else None
        if kind:
            after = i + chars
            yield *span(i, chars), kind


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind as listed."""
    found: list[tuple[int, int, str]] = []
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            found.append((m.start(), m.end(), "assign"))
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    found += [(m.start(), m.end(), "token") for m in _TOKEN.finditer(text) if is_token(*m.groups())]
    armoured: list[tuple[int, int]] = []
    if "PRIVATE KEY-----" in text:
        armoured = [m.span() for m in _PEM.finditer(text) if is_armoured_key(m[2])]
        found += [(a, b, "pem") for a, b in armoured]
    keys = [k for m in _LINES64.finditer(text) for k in _in_lines(text, m)]
    for m in _HEX_ANY.finditer(text):
        if len(m[0]) % 2 or not m[0].lower().startswith(_HEX_STARTS):
            continue
        body = bytes.fromhex(m[0])
        if is_private_der(body) or is_ssh_key(body):
            keys.append((m.start(), m.end(), "der" if body[0] == _SEQUENCE else "ssh"))
    begins = [a for a, _ in armoured]
    for a, b, kind in keys:  # a key within its armour is told once
        k = bisect_right(begins, a) - 1
        if k < 0 or b > armoured[k][1]:
            found.append((a, b, kind))
    return sorted(set(found), key=lambda x: (x[0], KINDS[x[2]], x[1]))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans array<struct<start,end,kind>>."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spans = [
            [{"start": a, "end": b, "kind": k} for a, b, k in scan(t or "")] for t in batch.column("text").to_pylist()
        ]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return map_batches(
        id_text(docs, id_col, text_col), fn, "doc_id long, spans array<struct<start:long,end:long,kind:string>>"
    )


def secret_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of every text, from :func:`secret_spans`."""
    base = F.array(*map(F.lit, BASE))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return secret_spans(docs).select(
        "doc_id",
        *map(count, BASE),
        F.sha2(joined(F.filter("spans", lambda s: F.array_contains(base, s["kind"]))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
