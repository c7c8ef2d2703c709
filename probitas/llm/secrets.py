"""Operator 7: secret scans with structural confirmation.

Candidates are runs of base64, base64url or hex characters and PEM armour.  A candidate is
reported only if its structure holds when decoded:

- ``pem_private_key``: armour whose body decodes to a private key in DER or OpenSSH form;
- ``der_private_key``: base64 or hex of a PKCS#1, PKCS#8 or SEC 1 key; the nested lengths must
  fill their parents exactly and the fields must be those of a private key;
- ``openssh_private_key``: base64 of the ``openssh-key-v1`` container with consistent lengths;
- ``signed_token``: three base64url parts; the first two are JSON objects, the header names a
  signature algorithm, and the signature has that algorithm's length;
- ``vendor_token``: a token with a checksum (``ghp_`` and its kin: CRC-32 in base 62);
- ``access_key_id``: ``AKIA`` or ``ASIA`` and 16 base32 characters that hold a 12-digit account;
- ``hex_key``, ``base64_key``: the value of an assignment to a name such as token or api_key
  that decodes to a usual key length of bytes without the regularity of text or counters.

Signed tokens, vendor tokens, access key ids and keys in DER or OpenSSH form may begin anywhere
in a run, also within a URL or path; base64 of a key that is wrapped over lines without armour is
joined.  A header of a signed token may have any length.  The two assigned kinds are whole runs, or what stands behind the last = of one.

``shortest`` is the least length of a run that is looked at, and an assignment is looked for in
the ``look_back`` bytes before a run.  The scan is linear in the text: marks of armour are paired in one pass, and a position within a run is
decoded only if the length that the key declares there ends with the run.
Secrets themselves aren't part of the result, only a fingerprint of them.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Pieces, pieces, runs

SHORTEST = 16
LOOK_BACK = 48
KEY_BYTES = (16, 20, 24, 28, 30, 32, 40, 48, 64)

_RUN = np.zeros(256, dtype=bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="]] = True
_NOT_LETTER = _RUN.copy()
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = False
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True

_ASSIGNED = re.compile(rb"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|apikey|access[_-]?key|auth|credential|private[_-]?key|client[_-]?key|[_-]key|bearer)[\w-]*[\"']?\s*(?:[:=]|=>|:=|\s)\s*[\"']?$", re.IGNORECASE)
_HEX = re.compile(rb"[0-9a-fA-F]+\Z")
_ARMOUR = re.compile(rb"-----(BEGIN|END) ((?:RSA |DSA |EC |OPENSSH |ENCRYPTED )?PRIVATE KEY)-----")
_VENDOR = re.compile(rb"(?<![0-9A-Za-z])(?:(?:ghp|gho|ghu|ghs|ghr)_|npm_)[0-9A-Za-z]{36}(?![0-9A-Za-z_])")
_ACCESS = re.compile(rb"(?<![0-9A-Za-z])(?:AKIA|ASIA)[A-Z2-7]{16}(?![0-9A-Za-z])")
_TOKEN_HEAD = re.compile(rb"(?<![0-9A-Za-z])eyJ")
_TOKEN_REST = re.compile(rb"\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: What tells where the object that ends a text begins.
_NESTING = re.compile(rb"\\+|[\"{}\[\]]")
#: Where a key may begin within a run: the first byte of DER is 0x30.
_KEY_START = re.compile(rb"(?<![0-9A-Za-z+])(?:M[A-P]|30[0-9A-Fa-f]{8}|b3BlbnNzaC1rZXktdjE)")
_WRAPPED = re.compile(rb"^[ \t>]*((?:M[A-P]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/]{38,}(?:\r?\n[ \t>]*[A-Za-z0-9+/]{40,})*\r?\n[ \t>]*[A-Za-z0-9+/]+={0,2})(?![A-Za-z0-9+/=])", re.MULTILINE)
_SIGNATURE = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EDDSA": (64, 114)} | {
    f"{kind}{n}": (128, 1024) for kind in ("RS", "PS") for n in (256, 384, 512)
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def decoded(run: bytes) -> bytes | None:
    """The bytes that base64 or base64url stands for."""
    run = run.rstrip(b"=")
    if len(run) % 4 == 1 or b"=" in run:
        return None
    try:
        return base64.b64decode(run.replace(b"-", b"+").replace(b"_", b"/") + b"=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None


def der(data: bytes, depth: int = 0) -> list | None:
    """(tag, content) of the elements that fill ``data`` exactly; the content of sequences is a list."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, size = data[i], data[i + 1]
        i += 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or i + more > len(data):
                return None
            size = int.from_bytes(data[i : i + more], "big")
            i += more
        if i + size > len(data):
            return None
        content = data[i : i + size]
        i += size
        if tag & 0x20 and depth < 12:
            inner = der(content, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, content))
    return out


def der_private_key(data: bytes) -> str | None:
    """pkcs1, pkcs8 or sec1, if ``data`` is a private key."""
    if len(data) < 16 or data[0] != 0x30:
        return None
    top = der(data)
    if not top or len(top) != 1 or not isinstance(top[0][1], list):
        return None
    parts = top[0][1]
    tags = [t for t, _ in parts]
    if len(parts) >= 9 and all(t == 0x02 for t in tags[:9]) and parts[0][1] in (b"\0", b"\1"):
        return "pkcs1"
    if len(parts) >= 3 and tags[:3] == [0x02, 0x30, 0x04] and parts[0][1] in (b"\0", b"\1") and parts[1][1] and parts[1][1][0][0] == 0x06:
        return "pkcs8"
    if len(parts) >= 2 and tags[:2] == [0x30, 0x04] and parts[0][1] and parts[0][1][0][0] == 0x06:
        return "pkcs8-encrypted"
    if len(parts) >= 2 and tags[:2] == [0x02, 0x04] and parts[0][1] == b"\1" and len(parts[1][1]) in (28, 32, 48, 66):
        return "sec1"
    return None


class _Lazy:
    """The bytes that the base64 text[start:end] stands for, of which only the slices asked for are decoded."""

    def __init__(self, text: bytes, start: int, end: int) -> None:
        self.text, self.start, self.end = text, start, end

    def __len__(self) -> int:
        return (self.end - self.start) * 3 // 4

    def __getitem__(self, part: slice) -> bytes:
        first = part.start or 0
        from_, to = self.start + first // 3 * 4, self.start + -(-part.stop // 3) * 4
        return (decoded(self.text[from_ : min(to, self.end)]) or b"")[first % 3 :][: part.stop - first]


def openssh_private_key(data: bytes | _Lazy) -> bool:
    """Whether the lengths in an openssh-key-v1 container fill it exactly; only they are looked at."""
    magic = b"openssh-key-v1\0"
    if data[: len(magic)] != magic:
        return False
    i = len(magic)

    def string() -> None:
        nonlocal i
        size = int.from_bytes(data[i : i + 4], "big")
        if i + 4 + size > len(data):
            raise ValueError
        i += 4 + size

    try:
        for _ in range(3):
            string()
        keys = int.from_bytes(data[i : i + 4], "big")
        i += 4
        if not 1 <= keys <= 16:
            return False
        for _ in range(keys):
            string()
        string()
    except ValueError:
        return False
    return i == len(data)


def private_key(data: bytes) -> str | None:
    return "openssh" if openssh_private_key(data) else der_private_key(data)


def signed_token(header: bytes, payload: bytes, signature: bytes) -> str | None:
    """The algorithm, if the parts are those of a signed token."""
    raw = [decoded(x) for x in (header, payload, signature)]
    if any(x is None for x in raw):
        return None
    try:
        head, body = json.loads(raw[0]), json.loads(raw[1])
    except (ValueError, RecursionError):
        return None
    if not isinstance(head, dict) or not isinstance(body, dict):
        return None
    algorithm = str(head.get("alg", "")).upper()
    if algorithm not in _SIGNATURE:
        return None
    low, high = _SIGNATURE[algorithm]
    return algorithm if low <= len(raw[2]) <= high else None


def checksum_holds(token: bytes) -> bool:
    """The last six of a vendor token's characters are the CRC-32 of those before, in base 62."""
    body = token.split(b"_", 1)[1]
    crc, digits = zlib.crc32(body[:-6]), ""
    while crc:
        crc, rest = divmod(crc, 62)
        digits = _BASE62[rest] + digits
    return digits.rjust(6, "0").encode() == body[-6:]


def account(token: bytes) -> int | None:
    """The account number in an access key id, if it is one of 12 digits."""
    number = int.from_bytes(base64.b32decode(token[4:])[:6], "big")
    number = (number & 0x7FFFFFFFFF80) >> 7
    return number if 0 < number < 10**12 else None


def random_looking(data: bytes) -> bool:
    """Neither text nor a counter nor few different bytes."""
    if len(set(data)) < 0.55 * min(len(data), 64):
        return False
    if sum(32 <= b < 127 for b in data) >= 0.9 * len(data):
        return False
    steps = [(b - a) % 256 for a, b in zip(data, data[1:], strict=False)]
    return max(map(steps.count, set(steps))) < 0.5 * len(steps)


Hit = tuple[int, int, str, str]


def _object_start(data: bytes) -> int | None:
    """Where the JSON object begins that ``data`` ends with, if there is one; one pass.

    Read from the end, a quote opens or closes a string unless an odd number of backslashes
    stands before it, and the object begins where its last brace is matched: at one place only.
    """
    depth, inside = 0, False
    marks = [(m.start(), m[0]) for m in _NESTING.finditer(data)]
    for k in range(len(marks) - 1, -1, -1):
        at, mark = marks[k]
        if mark == b'"':
            before, slashes = marks[k - 1] if k else (0, b"")
            if not (slashes[:1] == b"\\" and before + len(slashes) == at and len(slashes) % 2):
                inside = not inside
        elif inside or mark[:1] == b"\\":
            continue
        elif mark in b"}]":
            depth += 1
        else:
            depth -= 1
            if depth <= 0:
                return at if depth == 0 and mark == b"{" else None
    return None


def _signed(text: bytes, start: int, end: int) -> Hit | None:
    """The signed token whose header, of any length, ends with the run text[start:end].

    Headers that begin a multiple of four characters apart are the ends of one decoded text, of
    which one at most is an object; so three texts are decoded, however many may be headers.
    """
    rest = _TOKEN_REST.match(text, end)
    if not rest:
        return None
    start = max(start, *(text.rfind(c, start, end) + 1 for c in (b"/", b"=", b"+")))
    first: dict[int, int] = {}
    heads = {m.start() for m in _TOKEN_HEAD.finditer(text, start, end)}
    for head in sorted(heads):
        first.setdefault((end - head) % 4, head)
    begins = []
    for head in first.values():
        data = decoded(text[head:end])
        at = _object_start(data) if data else None
        if at is not None and at % 3 == 0 and head + at // 3 * 4 in heads:
            begins.append(head + at // 3 * 4)
    for head in sorted(begins):
        if algorithm := signed_token(text[head:end], *rest.groups()):
            return head, rest.end(), "signed_token", algorithm
    return None


def _declared(head: bytes) -> int | None:
    """The length of the DER element that begins like this."""
    if len(head) < 5 or head[0] != 0x30:
        return None
    if not head[1] & 0x80:
        return head[1] + 2
    more = head[1] & 0x7F
    return int.from_bytes(head[2 : 2 + more], "big") + 2 + more if 1 <= more <= 3 else None


def _der_at(text: bytes, start: int, end: int, in_hex: bool) -> str | None:
    """The form of the private key that text[start:end] is in DER; its declared length is looked at first."""
    head = bytes.fromhex(text[start : start + 10].decode()) if in_hex else decoded(text[start : start + 8])
    size = head and _declared(head)
    if not size or (end - start != 2 * size if in_hex else len(text[max(start, end - 2) : end].rstrip(b"=")) + max(start, end - 2) - start != -(-size * 4 // 3)):
        return None
    run = text[start:end]
    if in_hex:
        return der_private_key(bytes.fromhex(run.decode())) if _HEX.match(run) else None
    data = decoded(run)
    return der_private_key(data) if data else None


def confirmed(text: bytes, start: int, end: int, shortest: int = SHORTEST, look_back: int = LOOK_BACK) -> list[Hit]:
    """(start, end, kind, detail) of the secrets that begin in the run text[start:end], in order."""
    hits = [(m.start(), m.end(), "vendor_token", m[0].split(b"_")[0].decode()) for m in _VENDOR.finditer(text, start, end) if checksum_holds(m[0])]
    hits += [(m.start(), m.end(), "access_key_id", m[0][:4].decode()) for m in _ACCESS.finditer(text, start, end) if account(m[0])]
    if hit := _signed(text, start, end):
        hits.append(hit)
    if hits:
        return sorted(hits)
    if hit := _key(text, start, end, look_back):
        return [hit]
    run = text[start:end].rstrip(b"=")
    # an unquoted assignment may be one run: key=value
    value = start + run.rfind(b"=") + 1
    if value > start and end - value >= shortest and (hit := _key(text, value, end, look_back)):
        return [hit]
    for m in _KEY_START.finditer(text, start + 1, end):
        if m[0].startswith(b"b3"):
            stop = start + len(run)
            if m.start() >= value and (stop - m.start()) % 4 != 1 and openssh_private_key(_Lazy(text, m.start(), stop)):
                return [(m.start(), end, "openssh_private_key", "openssh")]
        elif form := _der_at(text, m.start(), end, m[0].startswith(b"30")):
            return [(m.start(), end, "der_private_key", form)]
    return []


def _key(text: bytes, start: int, end: int, look_back: int) -> Hit | None:
    """The key that the whole of text[start:end] is."""
    run = text[start:end]
    bare = run.strip(b"-_")
    if _HEX.match(bare) and len(bare) % 2 == 0:
        a = start + run.index(bare)
        data = bytes.fromhex(bare.decode())
        if form := private_key(data):
            return a, a + len(bare), "der_private_key", form
        if len(data) in KEY_BYTES and _ASSIGNED.search(text[max(0, a - look_back) : a]) and random_looking(data):
            return a, a + len(bare), "hex_key", f"{8 * len(data)} bits"
        return None
    data = decoded(run)
    if data is None:
        return None
    if openssh_private_key(data):
        return start, end, "openssh_private_key", "openssh"
    if form := der_private_key(data):
        return start, end, "der_private_key", form
    if len(data) in KEY_BYTES and re.search(rb"\d", run) and re.search(rb"[A-Z]", run) and re.search(rb"[a-z]", run) and random_looking(data) and _ASSIGNED.search(text[max(0, start - look_back) : start]):
        return start, end, "base64_key", f"{8 * len(data)} bits"
    return None


def armoured(text: bytes) -> list[Hit]:
    """Armour from each BEGIN to the END of its kind, if no other mark lies between; one pass."""
    out, begin = [], None
    for mark in _ARMOUR.finditer(text):
        if mark[1] == b"END" and begin and begin[2] == mark[2]:
            body = b"".join(line for line in re.split(rb"\s+|\\n", text[begin.end() : mark.start()]) if b":" not in line)
            data = decoded(body)
            form = private_key(data) if data else None
            if form:
                out.append((begin.start(), mark.end(), "pem_private_key", form))
        begin = mark if mark[1] == b"BEGIN" else None
    return out


def wrapped(text: bytes) -> list[Hit]:
    """Base64 of keys over several lines without armour."""
    out = []
    for m in _WRAPPED.finditer(text):
        data = decoded(re.sub(rb"[\s>]+", b"", m[1]))
        if data and (form := private_key(data)):
            out.append((m.start(1), m.end(1), "openssh_private_key" if form == "openssh" else "der_private_key", form))
    return out


def secrets_of(text: bytes, spans: list[tuple[int, int]], shortest: int = SHORTEST, look_back: int = LOOK_BACK) -> list[Hit]:
    """The confirmed secrets of one text, given its candidate runs, in order; none lies in another."""
    blocks = armoured(text) if b"-----BEGIN " in text else []
    starts = [a for a, *_ in blocks]
    lies_in = lambda x: (k := bisect.bisect_right(starts, x) - 1) >= 0 and x < blocks[k][1]
    if b"\n" in text:
        blocks = sorted([*blocks, *(hit for hit in wrapped(text) if not lies_in(hit[0]))])
        starts = [a for a, *_ in blocks]
    found, reach = list(blocks), 0
    for start, end in spans:
        if start < reach or lies_in(start):
            continue
        for hit in confirmed(text, start, end, shortest, look_back):
            if hit[0] >= reach:
                found.append(hit)
                reach = hit[1]
    return sorted(found)


def candidates(piece: Pieces, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``shortest`` or more characters that aren't mere letters in one case."""
    start, end = runs(piece, _RUN[piece.data])
    long_ = end - start >= shortest
    start, end = start[long_], end[long_]
    other = np.concatenate([[0], np.cumsum(_NOT_LETTER[piece.data])])
    capital = np.concatenate([[0], np.cumsum(_CAPITAL[piece.data])])
    capitals = capital[end] - capital[start]
    keep = (other[end] > other[start]) | (capitals > 1)
    return start[keep], end[keep]


def _scan(batches: Iterator[pa.RecordBatch], shortest: int, look_back: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, out = [], []
        for i, j, piece in pieces(batch.column(1)):
            start, end = candidates(piece, shortest)
            edges = np.searchsorted(start, piece.offsets)
            whole = piece.data.tobytes()
            armour = set()
            at = whole.find(b"-----BEGIN ")
            while at >= 0:
                armour.add(int(np.searchsorted(piece.offsets, at, side="right")) - 1)
                at = whole.find(b"-----BEGIN ", at + 1)
            for k in sorted(armour | set(np.flatnonzero(np.diff(edges)).tolist())):
                o = int(piece.offsets[k])
                text = whole[o : int(piece.offsets[k + 1])]
                spans = [(int(a) - o, int(b) - o) for a, b in zip(start[edges[k] : edges[k + 1]], end[edges[k] : edges[k + 1]], strict=True)]
                begin = at = 0
                for a, b, kind, detail in secrets_of(text, spans, shortest, look_back):
                    rows.append(i + k)
                    begin, at = begin + len(text[at:a].decode("utf-8", "replace")), a
                    out.append((begin, begin + len(text[a:b].decode("utf-8", "replace")), kind, detail, hashlib.sha256(text[a:b]).hexdigest()[:16]))
        if rows:
            columns = [pa.array(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), columns[0].cast(pa.int32()), columns[1].cast(pa.int32()), *columns[2:]], names=["doc_id", "start", "stop", "kind", "detail", "fingerprint"])


def confirmed_secrets(docs: DataFrame, shortest: int = SHORTEST, look_back: int = LOOK_BACK) -> DataFrame:
    """The secrets in the texts whose structure is confirmed.

    Result: doc_id, start, stop (characters, from 0, stop exclusive), kind, detail, fingerprint
    (the start of the secret's SHA-256).  One row for each occurrence.

    A null or empty text has none; a null doc_id is kept as null.  Repeated rows have their
    secrets reported once each row.  Other columns are ignored, whatever their names.  An empty
    table gives no rows.
    """
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(
        lambda batches: _scan(batches, shortest, look_back), "doc_id bigint, start int, stop int, kind string, detail string, fingerprint string"
    )
