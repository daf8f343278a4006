"""Secrets in texts: keywords found by an Aho-Corasick automaton, patterns tried only where one stands, checksums proved.

All texts of a slice pass through one automaton. At each keyword the anchored pattern of its kind is tried; kinds whose
tokens hold a check value of their own count only when it agrees. Long runs of hex digits have no keyword; they are found by
aligned blocks of digits, as any long run covers a whole block.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.words import column, text_slices

AUTOMATON_BYTES = 1_000_000  # of a slice that the automaton takes at a time
HEX_RUN = 24
HEX_BLOCK = HEX_RUN // 2
_HEX = np.zeros(256, dtype=bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_HEX_RUN = re.compile(rb"[0-9a-f]+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: bytes) -> bytes:
    """Six base-62 digits of the CRC-32 of ``body``."""
    rest, digits = zlib.crc32(body), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = BASE62[digit] + digits
    return digits.encode()


def _has_crc(found: re.Match) -> bool:
    return base62_crc(found["body"]) == found["check"]


def _decoded(part: bytes) -> bytes:
    return base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))


def _signed_json(found: re.Match) -> bool:
    """Whether header and claims are JSON objects and the header names an algorithm."""
    try:
        header, claims = json.loads(_decoded(found["header"])), json.loads(_decoded(found["claims"]))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(claims, dict) and "alg" in header


def _whole_key(found: re.Match) -> bool:
    """Whether the body is one DER sequence of the length it states, or begins as OpenSSH's own format does."""
    try:
        body = base64.b64decode(re.sub(rb"\s|^[\w-]+:.*$", b"", found["body"], flags=re.MULTILINE), validate=True)
    except binascii.Error:
        return False
    if body.startswith(b"openssh-key-v1\0"):
        return True
    if len(body) < 2 or body[0] != 0x30:
        return False
    wide = body[1] - 0x80 if body[1] > 0x80 else 0
    return len(body) == 2 + wide + (int.from_bytes(body[2 : 2 + wide], "big") if wide else body[1])


@dataclass(frozen=True)
class Kind:
    name: str
    keywords: tuple[str, ...]  # lower case; a match begins with one of them
    pattern: re.Pattern
    holds: Callable[[re.Match], bool]


_CRC_TOKEN = rb"(?P<body>[0-9A-Za-z]{30})(?P<check>[0-9A-Za-z]{6})(?![0-9A-Za-z])"
#: In the order in which spans that begin together are listed; hex runs come third.
BASE = (
    Kind(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
        lambda found: len(found[2]) >= 6,
    ),
    Kind("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda found: len(found[0]) >= 20),
)
CHECKED = (
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_" + _CRC_TOKEN), _has_crc),
    Kind("npm", ("npm_",), re.compile(rb"npm_" + _CRC_TOKEN), _has_crc),
    Kind(
        "jwt",
        ("eyj",),
        re.compile(rb"(?P<header>eyJ[A-Za-z0-9_-]+)\.(?P<claims>eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"),
        _signed_json,
    ),
    Kind(
        "private_key",
        ("-----begin ",),
        re.compile(rb"-----BEGIN (?P<type>(?:[A-Z]+ )?)PRIVATE KEY-----(?P<body>[^-]*(?:-[^-]+)*)-----END (?P=type)PRIVATE KEY-----"),
        _whole_key,
    ),
)
KINDS = [*(k.name for k in BASE), "hex", *(k.name for k in CHECKED)]
BASE_KINDS = 3


@lru_cache(maxsize=1)
def _automaton() -> tuple[ahocorasick.Automaton, int]:
    automaton = ahocorasick.Automaton()
    for kind in (*BASE, *CHECKED):
        for word in kind.keywords:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton, max(len(w) for k in (*BASE, *CHECKED) for w in k.keywords)


def _keyword_hits(data: np.ndarray) -> Iterator[tuple[int, int, Kind]]:
    """(start, end, kind) of the keywords of a slice, case ignored, by growing end."""
    automaton, longest = _automaton()
    for at in range(0, len(data), AUTOMATON_BYTES):
        back = max(0, at - longest + 1)
        part = data[back : at + AUTOMATON_BYTES].tobytes().lower().decode("latin-1")
        for last, (kind, length) in automaton.iter(part):
            if back + last >= at:
                yield back + last + 1 - length, back + last + 1, kind


def _matches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) by byte position, leftmost and without overlap within a kind; those that do not hold are left out."""
    raw = memoryview(np.ascontiguousarray(data))
    taken = dict.fromkeys(KINDS, 0)
    for start, end, kind in _keyword_hits(data):
        limit = int(offsets[np.searchsorted(offsets, start, side="right")])
        if start < taken[kind.name] or end > limit:
            continue
        found = kind.pattern.match(raw, start, limit)
        if found:
            taken[kind.name] = found.end()
            if kind.holds(found):
                yield start, found.end(), kind.name
    blocks = len(data) // HEX_BLOCK
    full = np.flatnonzero(_HEX[data[: blocks * HEX_BLOCK]].reshape(blocks, HEX_BLOCK).all(axis=1)) * HEX_BLOCK
    for at in full.tolist():
        text = int(np.searchsorted(offsets, at, side="right"))
        begin, limit = int(offsets[text - 1]), int(offsets[text])
        if at < taken["hex"] or at + HEX_BLOCK > limit:
            continue
        while at > begin and _HEX[data[at - 1]]:
            at -= 1
        end = _HEX_RUN.match(raw, at, limit).end()
        taken["hex"] = end
        if end - at >= HEX_RUN:
            yield at, end, "hex"


def spans_of(texts: pa.Array) -> list[list[tuple[int, int, str]]]:
    """For each text its secrets as (start, kind's place in ``KINDS``, end) in code points, sorted."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for first, data, offsets in text_slices(texts):
        by_text: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, kind in _matches(data, offsets):
            by_text.setdefault(int(np.searchsorted(offsets, start, side="right")) - 1, []).append((start, KINDS.index(kind), end))
        for text, spans in by_text.items():
            begin = int(offsets[text])
            ends = sorted({p for start, _, end in spans for p in (start, end)})
            points, at, place = {}, begin, 0
            for p in ends:
                place += int(np.count_nonzero((data[at:p] & 0xC0) != 0x80))
                points[p], at = place, p
            found[first + text] = sorted((points[start], kind, points[end]) for start, kind, end in spans)
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = spans_of(column(batch, "text"))
        counts = [pa.array([sum(s[1] == kind for s in spans) for spans in rows], pa.int64()) for kind in range(BASE_KINDS)]
        base = [_joined([s for s in spans if s[1] < BASE_KINDS]) for spans in rows]
        digests = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string())
        arrays = [column(batch, "doc_id"), *counts, digests, pa.array([_joined(s) for s in rows], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in FOUND.split(", ")])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256 and spans.

    Base spans are assignments to a telling name, access key ids and long hex runs; tokens with a CRC, signed JSON tokens and
    private keys are added when their check holds. ``spans`` lists all as kind:start:end in code points, end exclusive, by
    start; base_sha256 is the SHA-256 of the base ones listed so, of the empty string when there are none.

    Defined cases: a null text is empty and has no secrets; a null doc_id and repeated rows stay as they are; a match never
    reaches into another text; a very long text passes the automaton in parts; other columns are ignored; no rows give no
    rows. One pass over whole texts without a shuffle.
    """
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_scan, FOUND)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by its kind in square brackets; of overlapping spans the first one names
    them all. A null text stays null; other columns and repeated rows stay as they are."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for k, spans in enumerate(spans_of(batch.column(at))):
                if spans:
                    parts, done = [], 0
                    for start, kind, end in spans:
                        if start >= done:
                            parts += [texts[k][done:start], f"[{KINDS[kind]}]"]
                        done = max(done, end)
                    texts[k] = "".join(parts) + texts[k][done:]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(mask, docs.schema)
