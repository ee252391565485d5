"""Secret scan with structural confirmation.

The base scan is three patterns.  Besides it, every base64 or hex run that is long enough is
decoded and reported only if its structure holds: a DER key whose nested lengths add up, an
OpenSSH key blob whose length-prefixed fields fill it, or a signed token whose header and
payload are JSON and whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame

from .arrow_map import Mapper, columns_of, map_texts

KINDS = ("assign", "access", "hex", "token", "der", "ssh")

#: The base patterns (ASCII only: no other letter counts as one of theirs).
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A text with none of these has no assignment.
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: A base64 run, over lines that may be indented and whose breaks may be escaped; and a url-safe one.
_B64 = re.compile(r"[A-Za-z0-9+/]{24,}(?:[\x20\t]*(?:\r?\n|\\+(?:r\\+)?n)[\x20\t]*[A-Za-z0-9+/]+)*={0,2}")
_URL_SAFE = re.compile(r"[A-Za-z0-9_-]{24,}={0,2}")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{40,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_BREAK = re.compile(r"[\x20\t]*(?:\r?\n|\\+(?:r\\+)?n)[\x20\t]*")
_RUN24 = re.compile(r"[A-Za-z0-9+/_-]{24}")
_ALGORITHMS = re.compile(r"none|(?:HS|RS|ES|PS)(?:256|384|512)|EdDSA|ES256K|RSA-OAEP(?:-256)?|A(?:128|192|256)(?:KW|GCMKW)|dir|ECDH-ES.*")
_SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521", b"sk-ssh-ed25519@openssh.com", b"sk-ecdsa-sha2-nistp256@openssh.com")
_OPENSSH_MAGIC = b"openssh-key-v1\0"
#: What a key can begin with.  DER begins with byte 0x30 and a length; SSH blobs with a key type or the magic.
_HEADS = [base64.b64encode(x).decode()[: len(x) * 8 // 6] for x in (_OPENSSH_MAGIC, *(len(t).to_bytes(4, "big") + t for t in _SSH_TYPES))]
_DER_START, _SSH_START = re.compile("M[A-I]"), re.compile("|".join(map(re.escape, _HEADS)))
_HEX_START = re.compile("(?=30[0-8])")


def _header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, where the content begins, where it ends) of the value at ``at``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 128:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _der(data: bytes, at: int, end: int) -> tuple[list, int] | None:
    """One tag-length-value with all that is nested in it, however deep: ([tag, content or children], next)."""
    top: list = []
    inside = [(top, end)]  # lists being filled, and where each ends
    while True:
        if (found := _header(data, at, inside[-1][1])) is None:
            return None
        tag, at, close = found
        if tag & 0x20:
            inner: list = []
            inside[-1][0].append([tag, inner])
            inside.append((inner, close))
        else:
            inside[-1][0].append([tag, data[at:close]])
            at = close
        while len(inside) > 1 and at == inside[-1][1]:
            inside.pop()
        if len(inside) == 1:
            return top[0], at


def is_der_key(data: bytes) -> bool:
    """A whole PKCS#1, PKCS#8, encrypted PKCS#8, SEC1 or public key structure."""
    if len(data) < 16 or data[0] != 0x30 or (found := _der(data, 0, len(data))) is None or found[1] != len(data):
        return False
    parts, tags = found[0][1], [x[0] for x in found[0][1]]
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True  # version and the eight numbers of an RSA key
    if tags[:3] == [0x02, 0x30, 0x04] and parts[1][1] and parts[1][1][0][0] == 0x06:
        return True  # version, algorithm, wrapped key
    if tags == [0x30, 0x04] and parts[0][1] and parts[0][1][0][0] == 0x06:
        return True  # encrypted
    if tags[:2] == [0x02, 0x04] and parts[0][1] == b"\x01" and len(parts[1][1]) in (28, 32, 48, 66):
        return True  # elliptic curve
    return tags == [0x30, 0x03] and bool(parts[0][1]) and parts[0][1][0][0] == 0x06


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that fill the blob, the first of them a key type."""
    if data.startswith(_OPENSSH_MAGIC):
        data, private = data[len(_OPENSSH_MAGIC) :], True
    else:
        private = False
    fields, at = [], 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if private and len(fields) == 3:  # the number of keys
            fields, at = [*fields, size], at + 4
            continue
        if size > len(data) - at - 4:
            return False
        fields, at = [*fields, data[at + 4 : at + 4 + size]], at + 4 + size
    if at != len(data):
        return False
    return len(fields) >= 6 and 1 <= fields[3] <= 64 and is_ssh_key(fields[4]) if private else len(fields) >= 2 and fields[0] in _SSH_TYPES


def _unbase64(run: str) -> bytes | None:
    run = run.rstrip("=")
    try:
        return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_token(run: str) -> bool:
    """Header and payload are JSON objects and the header names a known algorithm."""
    parts = []
    for part in run.split(".")[:2]:
        raw = _unbase64(part)
        try:
            parts.append(json.loads(raw) if raw else None)
        except (ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str) and bool(_ALGORITHMS.fullmatch(parts[0]["alg"]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, leftmost and non-overlapping for each kind."""
    out, low = [], text.lower()
    if any(w in low for w in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def _der_size(head: bytes) -> int:
    """Bytes of the sequence that begins with ``head``, its header included; 0 if no key can: the
    first value of any is a number or a sequence."""
    if len(head) < 7 or head[0] != 0x30:
        return 0
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80 or head[2 + n] not in (0x02, 0x30):
        return 0
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big") if n else 2 + head[1]


def _ssh_sizes(data: bytes) -> set[int]:
    """Where the length-prefixed fields of a blob end."""
    private = data.startswith(_OPENSSH_MAGIC)
    at, k, out = len(_OPENSSH_MAGIC) if private else 0, 0, set()
    while at + 4 <= len(data):
        size = 0 if private and k == 3 else int.from_bytes(data[at : at + 4], "big")
        at, k = at + 4 + size, k + 1
        out.add(at)
    return out


def _keys(run: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the keys in a run, which may begin and end anywhere in it."""
    breaks = [m.span() for m in _BREAK.finditer(run)]
    edges = zip([0, *(b for _, b in breaks)], [*(a for a, _ in breaks), len(run.rstrip("="))])
    lines = [(a, run[a:b]) for a, b in edges if a < b]
    # The run without its breaks, and where each line of it begins in either.
    packed, starts = "".join(line for _, line in lines), [0, *accumulate(len(line) for _, line in lines)]

    def place(i: int) -> int:
        k = bisect_right(starts, i, 0, len(lines)) - 1
        return lines[k][0] + i - starts[k]

    def close(i: int) -> int:
        """The place after ``i`` characters, with the padding that follows."""
        end = place(i - 1) + 1
        return end + len(run[end : end + 2]) - len(run[end : end + 2].lstrip("="))

    out, done = [], 0
    for at, ssh in sorted([(m.start(), False) for m in _DER_START.finditer(packed)] + [(m.start(), True) for m in _SSH_START.finditer(packed)]):
        if at < done:
            continue
        if not ssh:
            size = _der_size(_unbase64(packed[at : at + 12]) or b"")
            width = -(-size * 8 // 6)
            if size < 16 or width > len(packed) - at:
                continue
            data = (_unbase64(packed[at : at + width]) or b"")[:size]
            if (whole := _der(data, 0, len(data))) is None or whole[1] != size:
                continue
            done = at + width  # what lies in another structure is no key of its own
            if is_der_key(data):
                out.append((place(at), 4, close(done)))
            continue
        sizes = _ssh_sizes(_unbase64(packed[at : len(packed) - ((len(packed) - at) % 4 == 1)]) or b"")
        # Prose may follow on the next line: the most lines whose structure holds count.
        for end in reversed(starts):
            if end > at and (end - at) * 6 // 8 in sizes and is_ssh_key(_unbase64(packed[at:end]) or b""):
                out.append((place(at), 5, close(end)))
                done = end
                break
    return out


def _hex_keys(run: str) -> list[tuple[int, int, int]]:
    out, done = [], 0
    for at in (m.start() for m in _HEX_START.finditer(run)):
        if at < done or at + 14 > len(run):
            continue
        size = _der_size(bytes.fromhex(run[at : at + 14]))
        if size < 16 or at + 2 * size > len(run):
            continue
        data = bytes.fromhex(run[at : at + 2 * size])
        if (whole := _der(data, 0, size)) is None or whole[1] != size:
            continue
        done = at + 2 * size
        if is_der_key(data):
            out.append((at, 4, done))
    return out


def structural_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates whose decoded structure holds."""
    out = []
    if "eyJ" in text:
        out += [(m.start(), 3, m.end()) for m in _JWT.finditer(text) if is_token(m[0])]
    if _RUN24.search(text):
        runs = [*_B64.finditer(text), *(m for m in _URL_SAFE.finditer(text) if "-" in m[0] or "_" in m[0])]
        found = {(m.start() + a, kind, m.start() + b) for m in runs for a, kind, b in _keys(m[0])}
        found |= {(m.start() + a, kind, m.start() + b) for m in _ANY_HEX.finditer(text) for a, kind, b in _hex_keys(m[0])}
        ends = {}
        for a, kind, b in sorted(found, key=lambda x: (x[0], -x[2])):
            if a >= ends.get(kind, 0):  # one key may be met as two runs
                out.append((a, kind, b))
                ends[kind] = b
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(text: str | None) -> tuple[int, int, int, str, str, int]:
    """n_assign, n_access, n_hex, base_sha256, spans, n_structural of one whole text."""
    text = text or ""
    base = base_spans(text)
    more = structural_spans(text)
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    return *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of base kinds, their digest, all confirmed spans.

    A null text counts as empty.  Spans of a kind never overlap, spans of different kinds
    may; ties in start are ordered by kind.  Places are code points, end exclusive.  Repeated
    rows repeat their result; an empty table gives an empty one; other columns aren't read.
    """

    def setup() -> Mapper:
        return lambda texts: (None, columns_of([scan(t) for t in texts], 6))

    return map_texts(df, id_col, text_col, setup, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_structural long")
