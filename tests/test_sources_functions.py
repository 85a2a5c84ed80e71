"""Files, partitioners, arithmetic, metrics."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcweave.functions import idmath
from arcweave.functions.partition import KINDS, Partition, distribute, local_edges, slice_of
from arcweave.plans.metrics import Metrics
from arcweave.sources import edge_list, packed


def test_edge_list_text(spark, tmp_path):
    p = tmp_path / "in.txt"
    p.write_text("% c\n# c\n// c\n\n 1 2\n3\t4 5 ignored\n0 0\n1 2\n")
    edges = edge_list.read_edge_list(spark, str(p))
    assert sorted(map(tuple, edges.collect())) == [(0, 0), (1, 2), (1, 2), (3, 4)]
    assert edge_list.convert_stats(edges) == {"node_count": 5, "edge_count": 4, "contains_self_loops": True, "contains_duplicate_edges": True}
    edge_list.write_edge_list(edges, str(tmp_path / "out"))
    assert edge_list.read_edge_list(spark, str(tmp_path / "out")).count() == 4
    p.write_text("1 x\n")
    with pytest.raises(Exception, match="not an edge"):
        edge_list.read_edge_list(spark, str(p)).collect()
    labels = spark.createDataFrame([(1, 7), (0, 3)], "id long, scc long")
    edge_list.write_labels(labels, str(tmp_path / "labels"))
    assert [r.value for r in spark.read.text(str(tmp_path / "labels")).collect()] == ["3", "7"]


@pytest.mark.parametrize("endian", ["little", "big"])
def test_packed_round_trip(spark, tmp_path, endian):
    rows = [(0, 3), (0, 300), (5, 0), (5, 0), (2, 2), (300, 1)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    path = packed.write_packed_csr(edges, str(tmp_path / "d.x"), endian=endian, n=400)
    m = packed.Manifest.load(path)
    assert (m.node_count, m.edge_count, m.contains_self_loops, m.contains_duplicate_edges, m.csr_bytes, m.head_bytes) == (400, 6, True, True, 2, 1)
    for direction in ("fw", "bw"):
        g = packed.read_packed_csr(spark, path, rows=7, direction=direction)
        assert sorted(map(tuple, g.edges.collect())) == sorted(rows) and g.vertices.count() == 400
    with pytest.raises(FileExistsError):
        packed.write_packed_csr(edges, str(tmp_path / "d.x"))
    empty = packed.write_packed_csr(edges.limit(0), str(tmp_path / "e"))
    assert packed.read_packed_csr(spark, empty).edges.count() == 0


def test_manifest_errors(tmp_path):
    assert packed.parse_pairs("% x\n\na  b c\n") == {"a": "b c"}
    for bad in ("a b\na c\n", "alone\n"):
        with pytest.raises(packed.ManifestError):
            packed.parse_pairs(bad)
    for f, x in ((packed.parse_int, "1x"), (packed.parse_bool, "True"), (packed.parse_endian, "middle")):
        with pytest.raises(packed.ManifestError):
            f(x)
    p = tmp_path / "m"
    p.write_text("schema.version 1\n")
    with pytest.raises(packed.ManifestError, match="missing"):
        packed.Manifest.load(str(p))


def test_packed_codec():
    rng = np.random.default_rng(1)
    for width in range(1, 8):
        values = rng.integers(0, 256**width, 50)
        for endian in ("little", "big"):
            raw = packed.pack(values, width, endian)
            assert [int.from_bytes(raw[i * width : (i + 1) * width], endian) for i in range(50)] == values.tolist()
            assert (packed.unpack(raw, width, endian) == values).all()


@pytest.mark.parametrize("kind", KINDS)
def test_partition_laws(spark, kind):
    for n in (0, 2, 99):
        for p in (3, 1, 7) if n == 99 else (7,):
            for block in ((512, 1, 7) if kind == "block_cyclic" else (512,)):
                cuts = [n * i // p for i in range(p + 1)]
                ranges = tuple(zip(cuts[:-1], cuts[1:], strict=True))
                part = Partition(kind, n, 1 if kind == "single" else p, block, (ranges[::-1] if kind == "explicit_continuous" else ranges) if kind.startswith("explicit") else ())
                ids = spark.range(n)
                rows = ids.select("id", part.rank(F.col("id")).alias("r"), part.local(F.col("id")).alias("k")).withColumn("back", part.to_global(F.col("r"), F.col("k"))).collect()
                assert all(r.id == r.back and 0 <= r.r < part.ranks for r in rows)
                sizes = part.local_n()
                assert sum(sizes) == n and sorted((r.r, r.k) for r in rows) == [(a, b) for a, s in enumerate(sizes) for b in range(s)]


def test_fixed_layout_and_slices(spark):
    part = Partition.sorted_ends(10, [3, 9, 10])
    assert [r[0] for r in spark.range(10).select(part.rank(F.col("id"))).collect()] == [0, 0, 0, 1, 1, 1, 1, 1, 1, 2]
    assert part.ordered and not Partition("cyclic", 10, 3).continuous
    edges = spark.createDataFrame([(0, 1), (4, 2), (5, 5), (9, 0)], "src long, dst long")
    assert {(r["rank"], r.local_m) for r in local_edges(edges, part).collect()} == {(0, 1), (1, 2), (2, 1)}
    assert slice_of(edges, part, 1).count() == 2 and distribute(edges, part).count() == 4
    with pytest.raises(ValueError):
        Partition("spiral", 3)


def test_arithmetic(spark):
    for top, width in ((0, 1), (255, 1), (256, 2), (2**32 - 1, 4), (2**32, 5), (2**64 - 1, 8)):
        assert idmath.bytes_for(top) == width
    row = spark.range(1).select(idmath.floordiv(F.lit(-7), 2), idmath.ceildiv(F.lit(-7), 2), idmath.remainder(F.lit(-7), 2), idmath.round_up(F.lit(7), 4), idmath.clip(F.lit(9), 0, 5), idmath.rotr32(F.lit(1).cast("long"), 1), idmath.rotl32(idmath.rotr32(F.lit(77).cast("long"), 13), 13)).first()
    assert tuple(row) == (-4, -3, 1, 8, 5, 2**31, 77)
    assert spark.range(1).select(idmath.mix_hash(F.lit(1))).first()[0] != spark.range(1).select(idmath.mix_hash(F.lit(2))).first()[0]


def test_metrics(tmp_path):
    m = Metrics()
    with m.scope("benchmark"):
        m.value("n", 3)
        for _ in range(2):
            with m.scope("color"):
                pass
    m.write(str(tmp_path / "m.json"))
    tree = json.loads((tmp_path / "m.json").read_text())
    assert tree["0"]["benchmark"]["n"] == 3 and len(tree["0"]["benchmark"]["color"]) == 2 and tree["0"]["benchmark"]["duration"] > 0


def test_result_files(spark, tmp_path):
    from arcweave.sources.results import scan_results, scan_steps

    def tree(seconds, decided):
        m = Metrics()
        m.root["scc"] = {"duration": int(seconds * 1e9), "pivot": 3, "trim": {"duration": 10**9, "decided_count": decided}, "color": [{"duration": 10**9, "decided_count": 4}, {"duration": 3 * 10**9, "decided_count": 4}]}
        return m.root

    files = {"weak_default_np2_gnm_16.json": {"0": tree(5, 1), "1": tree(7, 3)}, "strong_tarjan_np1_rmat.json": {"0": tree(601, 0)}, "notes.json": {"0": tree(1, 1)}, "weak_default_np2_gnm_16.txt": {}}
    for name, content in files.items():
        (tmp_path / name).write_text(json.dumps(content))
    assert [tuple(r) for r in scan_results(spark, str(tmp_path)).collect()] == [("weak", "default", 2, "gnm_16", 7.0)]
    assert scan_results(spark, str(tmp_path), 1000).count() == 2
    rows = {(r.app, r.stage): (r.times, r.seconds, r.decided, r.per_second) for r in scan_steps(spark, str(tmp_path)).collect()}
    assert rows[("default", "trim")] == (1, 1.0, 4, 4.0) and rows[("default", "color")] == (2, 4.0, 16, 4.0)
    assert rows[("tarjan", "color")] == (2, 4.0, 8, 2.0)
