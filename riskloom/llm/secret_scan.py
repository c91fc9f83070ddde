"""Secret scans with structural confirmation.

Spans of the base are plain patterns. Longer runs in base64 or hex are decoded and reported only
if what they hold parses: key encodings with nested lengths, SSH key blobs, signed-token headers.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, small_batches, texts

# The base patterns, in the order in which kinds are listed, with the least length of group ``n``.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
BASE = (("assign", _ASSIGN, 2, 12), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16))
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")  # equal to runs of 16 and more, found without listing the short ones
KINDS = ("assign", "access", "hex", "jwt", "key", "ssh")

_RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]{20,}")
# Where a key may begin inside a run: after a separator that is also base64, with the first bytes that keys have.
_INSIDE = re.compile(r"(?<=[/+_-])(?=M|AAAA|b3Blb)")
# Lines of base64, of which the first is long; what belongs together is told by their lengths.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/]+={0,2})+")
_LINE = re.compile(r"[A-Za-z0-9+/]+={0,2}")
# A header in PEM armour makes the body, with its line breaks, one candidate.
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
# In JSON or source, breaks are escaped and strings of lines joined by marks.
_ESCAPED_BREAK = re.compile(r"(?<!\\)\\+[rn]|\r\n?")
_JOINT = re.compile(r"""["'][\s+.,\\]*["']""")
_HEADER = re.compile(
    r"\s*(?:Proc-Type:\s*4\s*,\s*[A-Z-]+(?!\S)|DEK-Info:\s*[A-Z0-9-]+\s*,\s*[0-9A-Fa-f]+(?!\S)|[A-Za-z][A-Za-z0-9-]*:[^\n]*(?:\n[\x20\t][^\n]*)*)"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/]+=*\Z")
# The bytes of an encrypted body parse as nothing: its headers stand for it.
_ENCRYPTED = (re.compile(r"Proc-Type:\s*4\s*,\s*ENCRYPTED(?!\S)"), re.compile(r"DEK-Info:\s*[A-Z0-9-]+\s*,\s*(?:[0-9A-Fa-f]{2}){8,}(?!\S)"))
_DIGITS = re.compile(r"[0-9a-fA-F]+\Z")
_SSH_KINDS = (b"ssh-", b"ecdsa-", b"sk-")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base kinds: leftmost matches per kind that do not overlap; short ones drop out."""
    found = []
    for kind, pattern, group, least in BASE:
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), kind))
    return found


def decoded(run: str) -> list[bytes]:
    """What a run may stand for: base64 in either alphabet, or hex."""
    out = []
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 != 1:
        try:
            out.append(base64.b64decode(body + "=" * (-len(body) % 4), validate=True))
        except (binascii.Error, ValueError):
            pass
    if len(run) % 2 == 0 and _DIGITS.match(run):
        out.append(bytes.fromhex(run))
    return out


def _der_length(data: bytes | memoryview, at: int) -> tuple[int, int] | None:
    """Length and first byte of the value whose length field stands at ``at``."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 128:
        return first, at + 1
    size = first & 127
    if not 1 <= size <= 4 or at + 1 + size > len(data) or data[at + 1] == 0:
        return None
    return int.from_bytes(data[at + 1 : at + 1 + size], "big"), at + 1 + size


def is_der_key(data: bytes | memoryview) -> bool:
    """A SEQUENCE that spans all bytes and whose elements nest to the byte, with an INTEGER or SEQUENCE first."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    outer = _der_length(data, 1)
    if not outer or outer[0] + outer[1] != len(data):
        return False
    at, tags = outer[1], []
    while at < len(data):
        inner = _der_length(data, at + 1)
        if not inner or inner[0] + inner[1] > len(data):
            return False
        tags.append(data[at])
        at = inner[0] + inner[1]
    return len(tags) >= 2 and tags[0] in (0x02, 0x30) and all(t in (2, 3, 4, 5, 6, 0x30, 0xA0, 0xA1) for t in tags)


def is_ssh_key(data: bytes | memoryview) -> bool:
    """An OpenSSH container, or a blob of length-prefixed fields that starts with the key's kind."""
    if bytes(data[:15]) == b"openssh-key-v1\0":
        return True
    if not bytes(data[4:16]).startswith(_SSH_KINDS):
        return False
    at, fields = 0, 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data) or (not fields and size < 4):
            return False
        fields += 1
        at += 4 + size
    return at == len(data) and fields >= 2


def _kind(data: bytes | memoryview) -> str | None:
    return "key" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def _key_inside(run: str) -> tuple[int, str] | None:
    """The first place after a separator from which the rest of a run parses, and as what.

    A run is decoded once for each of the four ways to group its characters, so many separators cost no more.
    """
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    grouped: dict[int, memoryview] = {}
    for m in _INSIDE.finditer(run):
        step, rest = m.start() % 4, len(body) - m.start()
        if rest < 24 or rest % 4 == 1:
            continue
        if step not in grouped:
            grouped[step] = memoryview(base64.b64decode(body[step:] + "=" * (-(len(body) - step) % 4)))
        if kind := _kind(grouped[step][m.start() // 4 * 3 :]):
            return m.start(), kind
    return None


def _wrapped_keys(text: str) -> Iterator[tuple[int, int, str]]:
    """Keys in base64 over several lines without armour: lines of one length, the last one possibly shorter."""
    for m in _WRAPPED.finditer(text):
        lines = list(_LINE.finditer(text, m.start(), m.end()))
        first = 0
        while first < len(lines) - 1:
            width, last = len(lines[first][0]), first + 1
            while last < len(lines) and len(lines[last][0]) == width and "=" not in lines[last - 1][0]:
                last += 1
            ends = [last + 1] if last < len(lines) and len(lines[last][0]) < width and "=" not in lines[last - 1][0] else []
            for end in [*ends, last] if width >= 40 else []:
                part = lines[first:end]
                if len(part) > 1 and (kind := next(filter(None, map(_kind, decoded("".join(x[0] for x in part)))), None)):
                    yield part[0].start(), part[-1].end(), kind
                    last = end
                    break
            first = last


def is_armoured_key(body: str) -> bool:
    """What stands between the marks of PEM armour: a key that parses, or an encrypted one by its headers.

    Lines of headers may come first, and line breaks may be escaped.
    """
    body = _JOINT.sub("", _ESCAPED_BREAK.sub("\n", body)).replace("\\t", " ").replace("\\/", "/")
    at = 0
    while header := _HEADER.match(body, at):
        at = header.end()
    run = "".join(body[at:].split())
    if not _BASE64.match(run):
        return False
    data = decoded(run)
    return any(is_der_key(d) or is_ssh_key(d) for d in data) or bool(data and all(p.search(body, 0, at) for p in _ENCRYPTED))


def is_token_header(part: str) -> bool:
    """A signed token's header: a JSON object that names its algorithm."""
    for data in decoded(part):
        try:
            header = json.loads(data)
        except (ValueError, RecursionError):
            continue
        if isinstance(header, dict) and isinstance(header.get("alg"), str):
            return True
    return False


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans whose decoded bytes parse as a token, a key in DER or an SSH key."""
    found = []
    for m in _DOTTED.finditer(text):
        parts, at, k = m[0].split("."), m.start(), 0
        while k + 2 < len(parts):
            held = 1
            if len(parts[k]) >= 16 and len(parts[k + 1]) >= 2 and is_token_header(parts[k]):
                held = 3
                found.append((at, at + sum(map(len, parts[k : k + 3])) + 2, "jwt"))
            at += sum(len(part) + 1 for part in parts[k : k + held])
            k += held
    begin, armoured = None, []
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        else:
            if begin and begin[2] == m[2] and is_armoured_key(text[begin.end() : m.start()]):
                armoured.append((begin.start(), m.end(), "key"))
            begin = None
    for span in _wrapped_keys(text):
        k = bisect_right(armoured, span[0], key=lambda a: a[0])
        if not k or armoured[k - 1][1] < span[1]:  # the armour already stands for what is inside
            found.append(span)
    for m in _RUN.finditer(text):
        kind = next(filter(None, map(_kind, decoded(m[0]))), None)
        if kind:
            found.append((m.start(), m.end(), kind))
        elif inside := _key_inside(m[0]):
            found.append((m.start() + inside[0], m.end(), inside[1]))
    return armoured + found


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind as listed, then end."""
    text = text or ""
    return sorted({*base_spans(text), *confirmed_spans(text)}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def mask(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with each stretch of overlapping spans replaced by ``mark``."""
    if not text:
        return text
    out, end = [], 0
    for start, stop, _ in spans(text):
        if start >= end:
            out += [text[end:start], mark]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def secret_scan(docs: DataFrame) -> DataFrame:
    """Secrets of each whole text: ``doc_id, spans``, an array of ``(kind, start, end, base)`` in code points.

    A null text counts as empty and has no spans. Rows are scanned one by one, whatever their ids;
    other columns are not read.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    base = {name for name, *_ in BASE}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b, "base": k in base} for a, b, k in spans(text)] for text in batch["text"].to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.list_(kind))], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def mask_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every secret in ``text`` masked; a null text stays null."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([mask(t, mark) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(lean(rewrite), docs.schema)
