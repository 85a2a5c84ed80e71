"""Sharding, mixing, fingerprints, near duplicates, repeats, top-k, packing: brute force, edge cases, the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcweave.llm import fingerprints, knn, mixing, neardup, packing, sharding, substrings
from arcweave.llm.tokens import WordBpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, rank int, key double"
WORDS = ["the", "of", "and", "river", "stone", "ring", "walks", "under", "bright", "é", "sky", "x1"]


def docs_of(spark, texts, ids=None, sources=None):
    ids = list(ids) if ids is not None else list(range(len(texts)))
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 7, 7, 7.0) for i, t, s in zip(ids, texts, sources, strict=True)], DOCS)


def prose(n, seed, low=0, high=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randint(low, high))) for _ in range(n)]


ODD = [None, "", "  ", "one", "one", "one", "long " * 30_000]


# sharding


def test_sharding_rows_law(spark):
    texts = ODD + prose(400, 1)
    rows = sharding.digest(docs_of(spark, texts, [None, *range(1, len(texts) - 1), 5])).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(by) <= set(range(40))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    ends = Counter((r.size, r.text_crc32) for r in rows)
    assert ends == Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)


def walk_one_by_one(points, keys, capacity):
    """Keys offered round by round, as the plan states it, but one key at a time."""
    filled, out, left = Counter(), {}, list(keys)
    for k in range(len(points)):
        rest = []
        for arc, key in left:
            s = points[(arc + k) % len(points)]
            if filled[s] < capacity[s]:
                filled[s] += 1
                out[key] = s
            else:
                rest.append((arc, key))
        left = rest
    return out


def test_ring_walk_matches_single_keys():
    rng = random.Random(2)
    for _ in range(200):
        shards = rng.randint(1, 6)
        owners = [rng.randrange(shards) for _ in range(rng.randint(1, 12))] + list(range(shards))
        counts = [rng.choice([0, 1, 5, rng.randint(0, 40)]) for _ in owners]
        capacity = sharding.capacities(sum(counts), shards, rng.choice([1.0, 1.25]))
        got = {}
        for a, first, n, s, _ in sharding.walk(counts, owners, capacity):
            got |= {(a, first + i): s for i in range(n)}
        keys = [(a, (a, i)) for a, c in enumerate(counts) for i in range(c)]
        assert got == walk_one_by_one(owners, keys, capacity)


def test_sharding_moves_little_and_empty(spark):
    d = docs_of(spark, prose(2000, 3, 1, 3))
    a = {r.doc_id: r.shard for r in sharding.assign(d, shards=10, load=1.25).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign(d, shards=11, load=1.25).collect()}
    moved = sum(a[i] != b[i] for i in a) / len(a)
    assert moved < 0.35 and max(Counter(a.values()).values()) <= 250
    assert sharding.digest(docs_of(spark, [])).count() == 0


def test_sharding_moves_little_as_registered(spark):
    d = spark.range(20_000).select((F.col("id") * 7).alias("doc_id"), F.col("id").cast("string").alias("text"))
    a, b = (dict(sharding.assign(d, shards=n).select("doc_id", "shard").collect()) for n in (40, 41))
    assert max(Counter(a.values()).values()) - min(Counter(a.values()).values()) <= 1
    assert 1 / 41 <= sum(a[i] != b[i] for i in a) / len(a) < 0.1  # one forty-first would be the least


# mixing


def test_mixing_targets_and_choice(spark):
    rng = random.Random(4)
    texts = ODD + prose(600, 4)
    sources = [rng.choice(["b", "a", "a", "a", "c", None]) for _ in texts]
    rows = mixing.digest(docs_of(spark, texts, sources=sources)).collect()
    words = {i: len((t or "").split()) for i, t in enumerate(texts)}
    totals = Counter()
    for i, s in enumerate(sources):
        totals[s] += words[i]
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(totals.values())
    while open_:  # reshare the excess until no source is above twice its size
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * totals[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            rest -= target[s]
        open_ -= over
    taken = Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == words[r.doc_id] and r.source_size == totals[s]
        assert r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in order:
        biggest = max(words[i] for i in words if sources[i] == s)
        assert abs(taken[s] - target[s]) <= biggest / 2 + 1
    again = mixing.digest(docs_of(spark, texts, sources=sources)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_repeats_rows_and_edges(spark):
    d = docs_of(spark, prose(60, 5), sources=["a", "b", "c"] * 20)
    plan = {r.doc_id: r.epochs + r.picked for r in mixing.plan(d).collect()}
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in plan.items() if n})
    assert mixing.digest(docs_of(spark, [])).count() == 0 and mixing.mix(docs_of(spark, [])).count() == 0
    nothing = mixing.digest(docs_of(spark, [None, ""], [None, 1], [None, "a"])).collect()
    assert [r.taken for r in nothing] == [0, 0]


def test_sampling_prefers_quality(spark):
    clean, junk = prose(300, 6, 30, 30), [t.replace(" ", "*** ") for t in prose(300, 7, 30, 30)]
    d = docs_of(spark, clean + junk)
    rows = mixing.plan(d, weights=(1.0,), share=0.5).collect()
    picked = [r.doc_id for r in rows if r.picked]
    assert sum(i < 300 for i in picked) > 1.5 * sum(i >= 300 for i in picked)


# fingerprints


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    keys = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in keys) / max(1, sum(max(a[w], b[w]) for w in keys))


def test_fingerprints_follow_generalised_jaccard(spark):
    texts = prose(120, 8, 5, 200) + [None, "", "solo", "solo"]
    ids = [i * 7 % 1000 for i in range(len(texts))]
    rows = {r.doc_id: r for r in fingerprints.digest(docs_of(spark, texts, ids)).collect()}
    assert len(rows) == len(texts)
    by = dict(zip(ids, texts, strict=True))
    order, off = sorted(ids), []
    for k, i in enumerate(order):
        t, nxt, r = by[i] or "", by[order[(k + 1) % len(order)]] or "", rows[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if t.split() and nxt.split():
            off += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, nxt)]
    assert abs(np.mean(off)) < 0.04 and np.std(off) < 0.12
    assert rows[ids[-1]].fingerprint == rows[ids[-2]].fingerprint
    assert rows[ids[-3]].fingerprint == rows[ids[-4]].fingerprint != rows[ids[-1]].fingerprint


def brute_samples(text, samples):
    """The word and step of least a for every sample, one pair at a time."""
    import math

    import xxhash

    bag, out = Counter((text or "").split() or [""]), []
    for k in range(samples):
        best = None
        for word, w in bag.items():
            h = xxhash.xxh64_intdigest(word.encode(), 42)
            h = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42))
            u = [((h >> s & 4095) + 0.5) / 4096 for s in (0, 12, 24, 36)]
            r, c, b = -math.log(u[0] * u[1]), -math.log(u[2] * u[3]), ((h >> 48) + 0.5) / 65536
            t = math.floor(math.log(w) / r + b)
            best = min(best or (math.inf,), (math.log(c) - r * (t - b + 1), word, t))
        out.append(best[1:])
    return out


def test_fingerprints_match_one_pair_at_a_time(spark):
    texts = prose(25, 21, 0, 120) + [None, "solo solo solo"]
    rows = {r.doc_id: r for r in fingerprints.digest(docs_of(spark, texts)).collect()}
    n = fingerprints.SAMPLES
    signed = [brute_samples(t, n) for t in texts]
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        edited = brute_samples(t[: len(t) - len(t) // 2] + nxt[: len(t) // 2], n)
        same = lambda x: sum(a == b for a, b in zip(signed[i], x, strict=True)) / n  # noqa: E731,B023
        assert (rows[i].near_edited, rows[i].near_next) == (same(edited), same(signed[(i + 1) % len(texts)]))


def test_fingerprint_edges(spark):
    assert fingerprints.digest(docs_of(spark, [])).count() == 0
    one = fingerprints.digest(docs_of(spark, ["a b c d"])).first()
    assert one.near_next == 1.0
    odd = fingerprints.digest(docs_of(spark, ODD, [None, 3, 3, 4, 4, 4, 5])).collect()
    assert len(odd) == len(ODD) and all(0 <= r.near_edited <= 1 for r in odd)


# near duplicates


def grams(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(texts, threshold=0.8):
    reps = {}
    for i, t in enumerate(texts):
        reps.setdefault(t or "", []).append(i)
    keys = list(reps)
    sets = [grams(t) for t in keys]
    parent, links = list(range(len(keys))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, t in enumerate(keys):
        root = find(k)
        least[root] = min(least.get(root, 1 << 60), reps[t][0])
    return {i: (least[find(k)], len(reps[t]) - 1, links[k]) for k, t in enumerate(keys) for i in reps[t]}


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(9)
    texts = prose(40, 9, 60, 120) + ODD
    for base in range(4):
        for _ in range((60, 12, 5, 2)[base]):
            words = texts[base].split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    return texts


def test_near_copies_match_brute_force(spark, copies):
    expected = brute_classes(copies)
    for block in (512, 8):  # one block, and buckets over many blocks
        rows = neardup.classes(docs_of(spark, copies), block=block).collect()
        assert {r.doc_id: (r.class_id, r.copies, r.links) for r in rows} == expected


def test_keep_one(spark, copies):
    d = docs_of(spark, copies)
    kept = neardup.keep_one(d)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {c for c, _, _ in brute_classes(copies).values()}
    assert neardup.keep_one(docs_of(spark, [])).count() == 0 and neardup.classes(docs_of(spark, [])).count() == 0
    odd = docs_of(spark, ["a b c d e f"] * 4 + ["x"], [None, 3, 3, 8, None])
    rows = {(r.doc_id, r.class_id, r.copies) for r in neardup.classes(odd).collect()}
    assert rows == {(None, 3, 3), (3, 3, 3), (8, 3, 3), (None, None, 0)}
    assert sorted((r.doc_id or 0, r.text) for r in neardup.keep_one(odd).collect()) == [(0, "x"), (3, "a b c d e f")]


def test_texts_that_share_an_id(spark):
    b = " ".join(f"w{i}" for i in range(60))
    d = docs_of(spark, ["quite another text of some words", b, b + " more"], [1, 1, 2])
    rows = {(r.doc_id, r.class_id, r.copies, r.links) for r in neardup.classes(d).collect()}
    assert rows == {(1, 1, 0, 0), (1, 1, 0, 1), (2, 1, 0, 1)}
    assert sorted((r.doc_id, r.text) for r in neardup.keep_one(d).collect()) == sorted([(1, "quite another text of some words"), (1, b)])


def test_near_copies_without_ids(spark):
    b = " ".join(f"w{i}" for i in range(60))
    d = docs_of(spark, [b, b + " more", b, "else", b + " yet"], [None, None, None, None, 7])
    rows = sorted((r.doc_id or 0, r.class_id or 0, r.copies, r.links) for r in neardup.classes(d).collect())
    assert rows == [(0, 0, 0, 0), (0, 7, 0, 2), (0, 7, 1, 2), (0, 7, 1, 2), (7, 7, 0, 2)]
    assert sorted((r.doc_id or 0, r.text) for r in neardup.keep_one(d).collect()) == [(0, "else"), (7, b + " yet")]
    nameless = docs_of(spark, [b, b + " more"], [None, None])
    assert [r.class_id for r in neardup.classes(nameless).collect()] == [None, None] and neardup.keep_one(nameless).count() == 1


def test_clashing_columns(spark):
    names = ["_row", "_keep", "_text", "_times", "_source", "_id", "_copy", "spot", "row", "id", "of", "times", "digest", "rep", "text.size"]
    d = docs_of(spark, ["a b c d e f"] * 3 + ["x y"], [1, 2, 3, 4], ["a", "a", "b", None])
    for n in names:
        d = d.withColumn(n, F.lit(n))
    kept, mixed = neardup.keep_one(d), mixing.mix(d)
    assert kept.columns == mixed.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]
    first = mixed.first()
    assert all(first[n] == n for n in names)


def test_blocks_are_bounded_by_text(spark, copies):
    rows = neardup.classes(docs_of(spark, copies), block_bytes=2000).collect()
    assert {r.doc_id: (r.class_id, r.copies, r.links) for r in rows} == brute_classes(copies)


# repeated substrings


def brute_repeats(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(gone[j] and (j == 0 or not gone[j - 1]) for j in range(len(b)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_match_brute_force(spark):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefgh éü") for _ in range(n))
    passages = [text(rng.randint(50, 260)) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = [rng.choice(passages) if rng.random() < 0.5 else text(rng.randint(0, 120)) for _ in range(rng.randint(0, 6))]
        if i % 11 == 0:
            parts.append(rng.choice(["a" * 300, "ab" * 180, "xyz" * 90 + "q", passages[0] * 3]))
        rows.append((i * 3, "".join(parts)))
    rows += [(1000, rows[5][1]), (1001, None), (1002, ""), (1003, "word " * 5000)]
    d = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    for limit in (substrings.KEY_LIMIT, 2):  # pieces in groups, and nearly all windows as rows
        found = substrings.removed(d, key_limit=limit).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute_repeats(rows, 100)


def test_repeats_edges(spark):
    assert substrings.digest(docs_of(spark, [])).count() == 0
    rng = random.Random(1)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    twice = substrings.removed(docs_of(spark, [t, t, t], [4, 4, None]), keep_text=True).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in twice) == [(-1, 0), (4, 300), (4, 300)]


def test_repeats_of_texts_that_polynomials_confuse(spark):
    a, b = thue_morse(1024, "a", "b")
    rows = [(1, a), (2, b), (3, a[:500] + "xy" + b[500:]), (4, thue_morse(2048, "c", "d")[0]), (5, thue_morse(2048, "c", "d")[1])]
    d = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    for limit in (substrings.KEY_LIMIT, 2):
        found = substrings.removed(d, key_limit=limit).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute_repeats(rows, 100)
    assert len(set(substrings._hashes(np.frombuffer((a + b).encode(), np.uint8), 1024, 16, substrings._S1)[[0, 1024]].tolist())) == 2


def test_repeated_rows_keep_what_occurs_nowhere_else(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = text(150)
    rows = [(1, text(200) + shared + text(200)), (2, text(200) + shared + text(200)), (3, "xyz" * 100 + text(50)), (4, shared[:120] + text(90))]
    repeated = [*rows, *rows[:3], rows[0]]
    d = docs_of(spark, [t for _, t in repeated], [i for i, _ in repeated])
    expected = brute_repeats(rows, 100)
    for limit in (substrings.KEY_LIMIT, 2):
        found = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in substrings.removed(d, key_limit=limit).collect()]
        assert sorted(found) == sorted((i, expected[i]) for i, _ in repeated)


# top-k


def brute_top(vectors, k=10):
    q = {i: [int(np.floor(1024 * float(x))) for x in v] for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for i in q:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i and len(q[j]) == len(q[i]))
            out |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    common = data[3][1]
    data += [(1000 + i, common) for i in range(300)] + [(2000, None), (2100, [1.0, None] + [0.0] * 6), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (2400, [1.0, 2.0]), (2401, [3.0, 1.0])]
    d = spark.createDataFrame([(i, v, 0, 5) for i, v in data], "vec_id long, embedding array<float>, label int, score int")
    expected = brute_top(data)
    for shard_rows, block in ((8192, 4096), (200, 3)):
        rows = knn.top_k(d, F.col("vec_id") % 100 == 0, shard_rows=shard_rows, block=block).collect()
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows} == expected


def test_top_k_edges(spark):
    ddl = "vec_id long, embedding array<float>"
    assert knn.digest(spark.createDataFrame([], ddl)).count() == 0
    few = knn.digest(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0]), (None, [9.0])], ddl)).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 1, 1024 * 2048)]
    tree = knn.Tree(np.arange(1000), np.ones((1000, 3)), leaf=16)
    assert [i for _, i in tree.search(np.ones(3), 0, 5)] == [1, 2, 3, 4, 5]


def test_top_k_large_values(spark):
    low, high = -(2**63), 2**63 - 1
    data = [(0, [4e6] * 3), (1, [3e6] * 3), (2, [-4e6] * 3), (3, [3e38] * 3), (4, [1e300] * 3), (5, [1.0] * 3)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    v = {i: [max(low, min(high, int(np.floor(1024 * x)) if x < 1e18 else high)) for x in e] for i, e in data}
    expected = sorted((-max(low, min(high, sum(a * b for a, b in zip(v[0], v[j], strict=True)))), j) for j in v if j)
    for shard_rows in (8192, 2):
        rows = knn.top_k(d, F.col("vec_id") % 100 == 0, shard_rows=shard_rows).orderBy("rank").collect()
        assert [(-r.score, r.vec_id) for r in rows] == expected


def test_boxes_leave_out_far_shards(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(4000, 3)) * 1000).astype(np.int64)
    axis, cut = knn.splits(x, 5)
    cell = knn.cell_of(x, axis, cut)
    sizes = np.bincount(cell)[31:]
    assert sizes.sum() == 4000 and sizes.min() > 100 and sizes.max() < 150
    import pandas as pd

    boxes = pd.DataFrame({"lo": [x[cell == c].min(0) for c in range(31, 63)], "hi": [x[cell == c].max(0) for c in range(31, 63)], "shard": range(31, 63), "part": 0})
    scores = x[:20] @ x.T
    kth = np.sort(scores, 1)[:, -10]
    asked = pd.DataFrame({"vec_id": range(20), "v": list(x[:20]), "kth": kth, "shard": -1, "part": 0})
    met = knn._reachable(boxes, asked)
    assert len(met) < 20 * 32 / 2
    for q in range(20):
        assert set(cell[scores[q] >= kth[q]]) <= set(met.shard[met.vec_id == q])


# packing


@pytest.fixture(scope="module")
def encoder():
    return WordBpe(packing.vocabulary_path())


def test_tokens_equal_library(encoder):
    rng = random.Random(12)
    pieces = list("abcdefgst 'remvld ") + ["'s", "'re", "''", "!", "12", "é", "ß", "İ", "\n", " ", "x'll", "<|endoftext|>", "漢", "Ā", "\x1c", "ſ", "é", "²", "ª"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", "   ", "'", " 's"] + prose(50, 12)
    expected = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == expected


def thue_morse(n, a, b):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def test_tokens_of_words_that_polynomials_confuse(encoder):
    texts = [w for n in (64, 1024, 4096) for w in thue_morse(n, "a", "b")] + ["q" * 70, "q" * 71, "abcdefgh", "abcdefghi"]
    text = " ".join(texts)
    assert encoder.encode([text])[0].tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_ids_beyond_sixteen_bits():
    for ids in ([], [1, 2], [65_535], [65_536, 1]):
        data = packing.narrow(np.array(ids, np.uint32))
        assert packing.widened(data).tolist() == ids and len(data) == 1 + len(ids) * (4 if max(ids, default=0) > 65_535 else 2)


def test_pack_properties():
    rng = random.Random(13)
    for _ in range(500):
        lengths = [rng.choice([1, 2, rng.randint(1, 600), rng.randint(1, 3000), rng.randint(1, 9000)]) for _ in range(rng.randint(0, 30))]
        pieces = defaultdict(list)
        for window in packing.pack(lengths):
            total = sum(n for _, _, n in window)
            assert 0 < total <= 4096 and total & (total - 1) == 0
            for doc, start, n in window:
                pieces[doc].append((start, n))
        for doc, n in enumerate(lengths):
            at = 0
            for start, k in sorted(pieces[doc]):
                assert start == at and k > 0
                at += k
            assert at == n


def test_steps_are_balanced():
    sizes = [4096] * 40 + [512] * 300 + [1024] * 50
    groups = Counter()
    for size, g in zip(sizes, packing.steps(sizes), strict=True):
        groups[g] += size
    assert max(groups.values()) - min(groups.values()) <= 4096


def test_packing_round_trip(spark, encoder):
    texts = ODD + prose(80, 14)
    ids = [None, *range(1, len(texts))]
    rows = packing.packed(docs_of(spark, texts, ids), group_bytes=20_000).collect()
    tokens = {i: [*encoder.library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in zip(ids, texts, strict=True)}
    seen, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = np.array(tokens[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.doc_tokens == len(tokens[r.doc_id]) and r.ids_crc32 == zlib.crc32(piece.tobytes())
        seen[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, t in tokens.items():
        at = 0
        for start, n in sorted(seen[i]):
            assert start == at
            at += n
        assert at == len(t)
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.packed(docs_of(spark, [])).count() == 0


# the pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from arcweave.llm import toxicity
    from arcweave.llm.common import durable, table

    docs = table(spark, sf_dir, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(durable(stage(spark, seen[-1], sf_dir)))
        if name != "packing":
            assert seen[-1].columns == docs.columns
    raw, clean, single, masked, mixed, packed = seen
    model = toxicity.learn(raw, table(spark, sf_dir, "labels"))
    score = model.scorer()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in raw.collect() if score(r.text or "") < 0.5}
    rows = sorted((r.doc_id, r.text) for r in clean.collect())
    groups = brute_classes([t for _, t in rows])
    assert {r.doc_id for r in single.collect()} == {rows[c][0] for c, _, _ in groups.values()}
    assert masked.count() == single.count() and not masked.filter("text rlike '[a-z]@[a-z]+[.]com'").head(1)
    plan = {r.doc_id: r.epochs + r.picked for r in mixing.plan(masked).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in plan.items() if n})
    whole = packed.groupBy("doc_id").sum("length").collect()
    tokens = {r.doc_id: len(WordBpe(packing.vocabulary_path()).encode([r.text])[0]) + 1 for r in mixed.dropDuplicates(["doc_id"]).limit(5).collect()}
    assert all(dict(map(tuple, whole))[i] == n * plan[i] for i, n in tokens.items())


def test_pipeline_on_odd_input(spark, sf_dir):
    import corpus_pipeline

    cols = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, 0), (2, "word " * 20_000, "en", "s", 5), (2, "word " * 20_000, "en", "s", 5)]):
        docs = spark.createDataFrame(rows, cols)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() >= len(rows) // 4
