"""Secret scanning: Aho-Corasick keyword prefilter, anchored patterns near hits, embedded checksums.

One automaton over all keywords walks each text once. Only where a keyword ends does an anchored pattern
run, at that place alone. Long hexadecimal strings have no keyword; they are found by probing every 24th
character (a run of 24 must cover a probe) and widening from the probes that hold a hexadecimal digit.
Added kinds carry a checksum or structure of their own, and count only if it holds: ``vcs`` and ``registry``
(36 characters whose last six are the base-62 CRC-32 of the first thirty), ``jwt`` (header and payload
decode to JSON objects; it begins where its run of characters begins) and ``pem`` (a private-key block header).

Edge cases: null text counts as empty; null ids are carried; repeated rows are each answered; an empty
table gives an empty result; extra columns are ignored. Every search takes time in proportion to the text, so very long texts
are searched whole; spans of different kinds may overlap, those of one kind never do. Offsets count code points, end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import strings, text_or_empty

BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("vcs", "registry", "jwt", "pem")
KINDS = BASE_KINDS + ADDED_KINDS

_ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_HEX = frozenset("0123456789abcdef")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "vcs", "gho_": "vcs", "ghu_": "vcs", "ghs_": "vcs", "ghr_": "vcs", "npm_": "registry", "eyj": "jwt", "-----begin ": "pem"}
_LOWER = {i: i + 32 for i in range(65, 91)}


def _build():
    a = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


_AUTOMATON = _build()


def checksum36(body: str) -> bool:
    """Thirty characters, then their CRC-32 as six base-62 digits."""
    n, out = zlib.crc32(body[:30].encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out == body[30:]


def _is_json(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def hex_runs(text: str, least: int = 24) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` lower-case hexadecimal digits."""
    out, end = [], 0
    for i, ch in enumerate(text[least - 1 :: least]):
        if ch in _HEX:
            at = i * least + least - 1
            if at < end:
                continue
            lo, hi = at, at + 1
            while lo > end and text[lo - 1] in _HEX:
                lo -= 1
            while hi < len(text) and text[hi] in _HEX:
                hi += 1
            if hi - lo >= least:
                out.append((lo, hi))
            end = hi
    return out


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans); base by start, then kind as listed."""
    base, extra = [], []
    ends = {"assign": 0, "access": 0, "jwt": 0}
    for last, (n, kind) in _AUTOMATON.iter(text.translate(_LOWER) if not text.isascii() else text.lower()):
        at = last - n + 1
        if kind in BASE_KINDS:
            if at >= ends[kind] and (m := (_ASSIGN if kind == "assign" else _ACCESS).match(text, at)):
                ends[kind] = m.end()
                if (m.end() - m.start(1) >= 6) if kind == "assign" else (m.end() - at >= 20):
                    base.append((kind, at, m.end()))
        elif kind in ("vcs", "registry"):
            if (m := _CHECKED.match(text, at)) and checksum36(m.group()[4:]):
                extra.append((kind, at, m.end()))
        elif kind == "jwt":
            if at >= ends[kind] and (m := _JWT.match(text, at)) and _is_json(m[1]) and _is_json(m[2]):
                extra.append((kind, at, m.end()))
                ends[kind] = m.end()
        elif m := _PEM.match(text, at):
            extra.append((kind, at, m.end()))
    base += [("hex", s, e) for s, e in hex_runs(text)]
    return sorted(base, key=_order), extra


def _order(span: tuple[str, int, int]) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=_order))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, spans array<struct<kind, start, end, base>> by start, then kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            out = []
            for text in strings(b.column(1)):
                base, extra = find(text)
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in extra], key=_order)
                out.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["id", "spans"])

    t = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {t}, spans array<struct<kind string, start int, end int, base boolean>>").withColumnRenamed("id", id_col)


def _digest_batches(batches):
    for b in batches:
        rows = []
        for text in strings(b.column(1)):
            base, extra = find(text)
            n = [sum(k == x for k, _, _ in base) for x in BASE_KINDS]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + extra)))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from ``find`` on each whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(_digest_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
