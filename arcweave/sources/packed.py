"""Packed CSR files: four arrays of fixed-width unsigned integers and a text manifest.

``write_packed_csr`` writes them, ``PackedCsr`` is a data source (``spark.read.format("packed_csr").load(manifest)``)
whose partitions are vertex ranges, each of which reads only its own rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arcweave.functions.idmath import bytes_for
from arcweave.graph import Digraph

# The keys of a manifest, in file order.
KEYS = (
    "schema.version",
    "graph.code",
    "graph.name",
    "graph.endian",
    "graph.node_count",
    "graph.edge_count",
    "graph.contains_self_loops",
    "graph.contains_duplicate_edges",
    "graph.head.bytes",
    "graph.csr.bytes",
    "fw.head.path",
    "fw.csr.path",
    "bw.head.path",
    "bw.csr.path",
)


class ManifestError(ValueError):
    """A manifest that cannot be read."""


def parse_pairs(text: str) -> dict[str, str]:
    """``key value`` lines; blank lines and lines that start with % are skipped."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        if not line.strip() or line.startswith("%"):
            continue
        key, space, value = line.partition(" ")
        if not space:
            raise ManifestError(f"no value in line: {line}")
        if key in out:
            raise ManifestError(f"key given twice: {key}")
        out[key] = value.lstrip(" ")
    return out


def parse_int(text: str) -> int:
    if not re.fullmatch(r"[0-9]+", text):
        raise ManifestError(f"not an integer: {text}")
    return int(text)


def parse_bool(text: str) -> bool:
    if text not in ("true", "false"):
        raise ManifestError(f"not a boolean: {text}")
    return text == "true"


def parse_endian(text: str) -> str:
    if text not in ("little", "big"):
        raise ManifestError(f"not a byte order: {text}")
    return text


@dataclass(frozen=True)
class Manifest:
    version: int
    code: str
    name: str
    endian: str
    node_count: int
    edge_count: int
    contains_self_loops: bool
    contains_duplicate_edges: bool
    head_bytes: int
    csr_bytes: int
    fw_head: str
    fw_csr: str
    bw_head: str
    bw_csr: str

    @classmethod
    def load(cls, path: str) -> Manifest:
        """All keys are needed; data files are relative to the manifest's folder and must exist."""
        with open(path, encoding="utf-8") as f:
            kv = parse_pairs(f.read())
        if missing := [k for k in KEYS if k not in kv]:
            raise ManifestError(f"missing: {', '.join(missing)}")
        files = [os.path.join(os.path.dirname(os.path.abspath(path)), kv[k]) for k in KEYS[10:]]
        for f in files:
            if not os.path.isfile(f):
                raise ManifestError(f"no such file: {f}")
        ints = {k: parse_int(kv[k]) for k in (KEYS[0], *KEYS[4:6], *KEYS[8:10])}
        return cls(ints[KEYS[0]], kv[KEYS[1]], kv[KEYS[2]], parse_endian(kv[KEYS[3]]), ints[KEYS[4]], ints[KEYS[5]], parse_bool(kv[KEYS[6]]), parse_bool(kv[KEYS[7]]), ints[KEYS[8]], ints[KEYS[9]], *files)

    def dump(self) -> str:
        flag = lambda b: "true" if b else "false"
        values = (self.version, self.code, self.name, self.endian, self.node_count, self.edge_count, flag(self.contains_self_loops), flag(self.contains_duplicate_edges), self.head_bytes, self.csr_bytes, *(os.path.basename(p) for p in (self.fw_head, self.fw_csr, self.bw_head, self.bw_csr)))
        return "".join(f"{k} {v}\n" for k, v in zip(KEYS, values, strict=True))


def pack(values: np.ndarray, width: int, endian: str) -> bytes:
    """Unsigned integers of ``width`` bytes each."""
    wide = np.asarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(wide if endian == "little" else wide[:, ::-1]).tobytes()


def unpack(data: bytes, width: int, endian: str) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw if endian == "little" else raw[:, ::-1]
    return wide.view("<u8").ravel().astype(np.int64)


def _read(path: str, first: int, count: int, width: int, endian: str) -> np.ndarray:
    with open(path, "rb") as f:
        f.seek(first * width)
        data = f.read(count * width)
    if len(data) != count * width:
        raise ManifestError(f"{path} is too short")
    return unpack(data, width, endian)


@dataclass
class _Range(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.manifest = Manifest.load(options["path"])
        self.rows = int(options.get("rows", 1 << 20))
        self.direction = options.get("direction", "fw")

    def partitions(self):
        n = self.manifest.node_count
        return [_Range(a, min(a + self.rows, n)) for a in range(0, n, self.rows)] or [_Range(0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        m = self.manifest
        head_file, csr_file = (m.fw_head, m.fw_csr) if self.direction == "fw" else (m.bw_head, m.bw_csr)
        if partition.first == partition.last:
            return
        head = _read(head_file, partition.first, partition.last - partition.first + 1, m.head_bytes, m.endian)
        for at in range(int(head[0]), int(head[-1]), 1 << 20):
            upto = min(at + (1 << 20), int(head[-1]))
            other = _read(csr_file, at, upto - at, m.csr_bytes, m.endian)
            own = partition.first + np.searchsorted(head, np.arange(at, upto), "right") - 1
            ends = (own, other) if self.direction == "fw" else (other, own)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["src", "dst"])


class PackedCsr(DataSource):
    """Options: path (the manifest), rows (vertices per partition), direction (fw or bw arrays)."""

    @classmethod
    def name(cls) -> str:
        return "packed_csr"

    def schema(self) -> str:
        return "src bigint, dst bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_packed_csr(spark: SparkSession, manifest: str, **options) -> Digraph:
    """The graph of a manifest."""
    spark.dataSource.register(PackedCsr)
    reader = spark.read.format("packed_csr")
    for k, v in options.items():
        reader = reader.option(k, v)
    return Digraph(spark.range(Manifest.load(manifest).node_count), reader.load(manifest))


def _writer(path: str, width: int, endian: str):
    """Rows (pos, value) in order into their places in a file that is there already; again if a task runs again."""

    def run(batches):
        written = 0
        with open(path, "r+b") as f:
            for b in batches:
                pos, value = (b.column(i).to_numpy() for i in (0, 1))
                cuts = np.flatnonzero(np.diff(pos) != 1) + 1
                for p, v in zip(np.split(pos, cuts), np.split(value, cuts), strict=True):
                    if len(p):
                        f.seek(int(p[0]) * width)
                        f.write(pack(v, width, endian))
                written += len(pos)
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["written"])

    return run


def _write_array(rows: DataFrame, path: str, count: int, width: int, endian: str) -> None:
    with open(path, "xb") as f:
        f.truncate(count * width)
    if count:
        done = rows.repartitionByRange("pos").sortWithinPartitions("pos").mapInArrow(_writer(path, width, endian), "written long")
        if (written := done.groupBy().sum("written").first()[0]) != count:
            raise ManifestError(f"{path}: {written} of {count} values written")


def write_packed_csr(edges: DataFrame, folder: str, name: str = "graph", endian: str = "little", n: int | None = None) -> str:
    """Write the four arrays and the manifest into ``folder`` (never over existing files); returns the manifest's path.

    The format is one file per array: every task writes its own stretch of positions in place, so nothing passes through the
    driver. The folder must be mounted on the driver and all executors.
    """
    from arcweave.operators.structure import csr_edges, csr_head
    from arcweave.sources.edge_list import convert_stats

    stats = convert_stats(edges)
    if n is not None:
        stats["node_count"] = max(n, stats["node_count"])
    os.makedirs(folder, exist_ok=True)
    n, m = stats["node_count"], stats["edge_count"]
    head_bytes, csr_bytes = bytes_for(m), bytes_for(max(0, n - 1))
    g = Digraph.from_edges(edges, n=n)
    for direction, side in (("fw", g), ("bw", g.transpose())):
        _write_array(csr_edges(side).select("pos", "v"), f"{folder}/{name}.{direction}.csr.bin", m, csr_bytes, endian)
        _write_array(csr_head(side).select("pos", "off"), f"{folder}/{name}.{direction}.head.bin", n + 1, head_bytes, endian)
    files = [f"{folder}/{name}.{d}.{a}.bin" for d in ("fw", "bw") for a in ("head", "csr")]
    manifest = Manifest(1, name, name, endian, n, m, stats["contains_self_loops"], stats["contains_duplicate_edges"], head_bytes, csr_bytes, *files)
    path = f"{folder}/{name}.manifest"
    with open(path, "x", encoding="utf-8") as f:
        f.write(manifest.dump())
    return path
