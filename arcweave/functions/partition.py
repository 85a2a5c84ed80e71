"""Vertex partitioners as column expressions: id -> (rank, local id) and back.

Every kind is a bijection between the ids 0..n-1 and (rank, local) pairs; ``ranks`` is their number. The two
explicit kinds take a table of ranges; its size is the number of ranks, so it travels as a literal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("single", "cyclic", "block_cyclic", "trivial_slice", "balanced_slice", "explicit_continuous", "explicit_sorted")


def _div(a: Column, b) -> Column:
    b = F.lit(b) if not isinstance(b, Column) else b
    return F.call_function("div", (a - F.pmod(a, b)).cast("long"), b.cast("long"))


@dataclass(frozen=True)
class Partition:
    """``ranges`` holds (begin, end) per rank for the explicit kinds; ``block`` is the block-cyclic block."""

    kind: str
    n: int
    ranks: int = 1
    block: int = 512
    ranges: tuple[tuple[int, int], ...] = ()

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown partition {self.kind}")
        if self.kind.startswith("explicit") and len(self.ranges) != self.ranks:
            raise ValueError("one range per rank")

    @classmethod
    def sorted_ends(cls, n: int, ends: list[int]) -> Partition:
        return cls("explicit_sorted", n, len(ends), ranges=tuple(zip([0, *ends[:-1]], ends, strict=True)))

    @property
    def continuous(self) -> bool:
        return self.kind not in ("cyclic", "block_cyclic")

    @property
    def ordered(self) -> bool:
        return self.continuous and self.kind != "explicit_continuous"

    def slices(self) -> list[tuple[int, int]]:
        """(begin, end) of each rank, for the continuous kinds."""
        n, p = self.n, self.ranks
        if self.kind == "single":
            return [(0, n)]
        if self.kind == "trivial_slice":
            base = n // p
            return [(r * base, n if r == p - 1 else (r + 1) * base) for r in range(p)]
        if self.kind == "balanced_slice":
            base, rem = divmod(n, p)
            return [(r * base + min(r, rem), (r + 1) * base + min(r + 1, rem)) for r in range(p)]
        if self.continuous:
            return list(self.ranges)
        raise ValueError("ranks of a cyclic partition are not slices")

    def rank(self, id_: Column) -> Column:
        n, p = self.n, self.ranks
        if self.kind == "single":
            out = F.lit(0)
        elif self.kind == "cyclic":
            out = F.pmod(id_, F.lit(p))
        elif self.kind == "block_cyclic":
            out = F.pmod(_div(id_, self.block), F.lit(p))
        elif self.kind == "trivial_slice":
            out = F.least(_div(id_, n // p), F.lit(p - 1)) if n // p else F.lit(p - 1)
        elif self.kind == "balanced_slice":
            base, rem = divmod(n, p)
            split = rem * (base + 1)
            above = F.lit(rem) + _div(id_ - split, base) if base else F.lit(p - 1)
            out = F.when(id_ < split, _div(id_, base + 1)).otherwise(above)
        else:
            out = F.coalesce(*[F.when((id_ >= lo) & (id_ < hi), F.lit(r)) for r, (lo, hi) in enumerate(self.ranges)], F.lit(-1))
        return out.cast("long")

    def local(self, id_: Column) -> Column:
        p, b = self.ranks, self.block
        if self.kind == "single":
            return id_.cast("long")
        if self.kind == "cyclic":
            return _div(id_, p)
        if self.kind == "block_cyclic":
            return _div(id_, b * p) * b + F.pmod(id_, F.lit(b))
        return id_ - self._begin(self.rank(id_))

    def _begin(self, rank: Column) -> Column:
        begins = F.array(*[F.lit(lo).cast("long") for lo, _ in self.slices()])
        return F.get(begins, rank.cast("int"))

    def to_global(self, rank: Column, local: Column) -> Column:
        p, b = self.ranks, self.block
        if self.kind == "single":
            return local.cast("long")
        if self.kind == "cyclic":
            return local * p + rank
        if self.kind == "block_cyclic":
            return (_div(local, b) * p + rank) * b + F.pmod(local, F.lit(b))
        return local + self._begin(rank)

    def local_n(self) -> list[int]:
        """Number of ids of each rank."""
        n, p, b = self.n, self.ranks, self.block
        if self.kind == "cyclic":
            return [(n - r + p - 1) // p if n > r else 0 for r in range(p)]
        if self.kind == "block_cyclic":
            full, rest = divmod(n, b * p)
            return [full * b + min(max(rest - r * b, 0), b) for r in range(p)]
        return [hi - lo for lo, hi in self.slices()]


def local_edges(edges: DataFrame, part: Partition) -> DataFrame:
    """Edges that each rank owns by their source: rank, local_m."""
    return edges.groupBy(part.rank(F.col("src")).alias("rank")).agg(F.count("*").alias("local_m"))


def slice_of(edges: DataFrame, part: Partition, rank: int) -> DataFrame:
    """One rank's edges."""
    return edges.filter(part.rank(F.col("src")) == rank)


def distribute(edges: DataFrame, part: Partition) -> DataFrame:
    """Edges with their rank, one Spark partition per rank at least."""
    return edges.withColumn("rank", part.rank(F.col("src"))).repartition(part.ranks, "rank")
