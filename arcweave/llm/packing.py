"""Hierarchical multi-length packing of documents into token windows.

Documents are tokenised once, with an end token each, and dealt by hash into packing groups of about
``GROUP_BYTES`` of text, so a group is bounded and groups are independent. Within a group, a document of 4096 tokens or
more gives full windows; what remains goes to the shortest context tier that holds it. Tiers are packed from the longest: a
window takes its longest document, then the longest ones of shorter tiers that still fit its gap, and the last gap is closed
by cutting a shorter document (the cut with the least loss: its rest stays in the pool). So windows of every
tier are exactly full, and a tier's length is a power of two. What is left at a group's end is less than one window of the shortest
tier with documents; it is cut at powers of two too, so nothing is padded. Windows are dealt to step groups by
longest processing time, which keeps the groups' token counts within one window of each other.

Ids of any size are carried, so the vocabulary may be larger than 65,536.

Edge cases: a null or empty text is the end token alone; very long texts are cut into full windows; null ids are
carried (rows of one id with equal texts meet in one group); repeated rows are packed each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import text_or_empty

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
GROUP_BYTES = 8 << 20
STEP_TOKENS = 1 << 16
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of pieces (document, start, length); every window's length is a power of two."""
    longest, out = tiers[-1], []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), sorted
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= longest:
            out.append([(doc, start, longest)])
            start += longest
        if n > start:
            pool.append((n - start, doc, start))
    pool.sort()
    total = sum(p[0] for p in pool)
    for tier in reversed(tiers):
        floor = tier // 2 if tier > tiers[0] else 0
        while pool and pool[-1][0] > floor and total >= tier:
            room, window = tier, []
            while room:
                k = bisect.bisect_right(pool, (room, len(lengths), 0)) - 1
                if k >= 0:
                    n, doc, start = pool.pop(k)
                    window.append((doc, start, n))
                else:  # nothing fits whole: cut the shortest
                    n, doc, start = pool.pop(0)
                    window.append((doc, start, room))
                    bisect.insort(pool, (n - room, doc, start + room))
                    n = room
                room -= n
                total -= n
            out.append(window)
    size = longest
    while pool:  # the tail, less than a window of its tier: powers of two
        while size > total:
            size //= 2
        room, window = size, []
        while room:
            n, doc, start = pool.pop()
            take = min(n, room)
            window.append((doc, start, take))
            if n > take:
                pool.append((n - take, doc, start + take))
            room -= take
        total -= size
        out.append(window)
    return out


def steps(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Step group of each window: longest first to the group with the fewest tokens."""
    groups = max(1, round(sum(sizes) / step_tokens))
    heap, out = [(0, g) for g in range(groups)], [0] * len(sizes)
    for w in sorted(range(len(sizes)), key=lambda w: -sizes[w]):
        filled, g = heapq.heappop(heap)
        out[w] = g
        heapq.heappush(heap, (filled + sizes[w], g))
    return out


def narrow(ids: np.ndarray) -> bytes:
    """Ids as little-endian numbers of 2 or 4 bytes, as the largest needs, after one byte that says which."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    return (b"\4" if wide else b"\2") + ids.astype("<u4" if wide else "<u2").tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def tokenised(docs: DataFrame, groups: int, path: str | None = None) -> DataFrame:
    """doc_id, part (packing group), ids (binary, with the end token, as ``narrow`` writes them)."""
    path = path or vocabulary_path()

    def run(batches):
        from arcweave.llm.tokens import WordBpe

        encoder, end = WordBpe(path), np.array([END_ID], np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                ids = [narrow(np.concatenate([x, end])) for x in encoder.encode(b.column(2).slice(at, 512).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 512), b.column(1).slice(at, 512), pa.array(ids, pa.binary())], ["doc_id", "part", "ids"])

    text = text_or_empty("text")
    part = F.pmod(F.xxhash64("doc_id", F.crc32(text.cast("binary"))), F.lit(groups))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text.alias("text")).mapInArrow(run, "doc_id long, part long, ids binary")


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "ids"], na_position="first")
    part = int(pdf["part"].iloc[0])
    ids = [widened(x) for x in pdf["ids"]]
    windows = pack([len(x) for x in ids])
    sizes = [sum(n for _, _, n in w) for w in windows]
    rows = []
    for seq, (window, group) in enumerate(zip(windows, steps(sizes), strict=True)):
        offset = 0
        for doc, start, n in window:
            crc = zlib.crc32(ids[doc][start : start + n].astype("<u4").tobytes())
            rows.append((doc, start, n, crc, len(ids[doc]), (part << 24) | seq, offset, sizes[seq], (part << 24) | group))
            offset += n
    out = pd.DataFrame(rows, columns=["doc", *(c.split()[0] for c in _PIECES.split(", ")[1:])])
    out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy()[out.pop("doc").to_numpy()] if len(out) else [])
    return out


def packed(docs: DataFrame, group_bytes: int = GROUP_BYTES, path: str | None = None) -> DataFrame:
    """One row per piece, the contract's columns and also tier (window length) and step_group."""
    total = docs.agg(F.sum(F.octet_length(text_or_empty("text")))).first()[0] or 0
    groups = max(1, round(total / group_bytes))
    return tokenised(docs, groups, path).groupBy("part").applyInPandas(_pack_group, _PIECES)


def digest(docs: DataFrame) -> DataFrame:
    return packed(docs)
