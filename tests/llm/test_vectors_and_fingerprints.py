"""Clusters, hard negatives and fingerprints against brute force: nulls, ties, repeated rows, empty and clashing tables."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import lloyd, negatives, oracle, queries, simhash

VECTORS = "vec_id long, embedding array<float>, label int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def in_sql(df, sql):
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    return sorted(con.sql(sql).fetchall(), key=repr)


def hostile(rng, n, dim=64):
    """Vectors with ties, a third of them alike, repeated ids, and such as take no part."""
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[: n // 3] = x[0]
    x[n // 2 : n // 2 + 20] = x[n - 20 :]
    out = [(int(i), [float(v) for v in x[i]], int(rng.integers(0, 4))) for i in range(n)]
    bad = [None, [], [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1)]
    return out + [(n + i, v, 1) for i, v in enumerate(bad)] + [(n + 10, [0.0] * dim, 1)] + out[40:45]


# --- 11 -------------------------------------------------------------------------------------------


def brute_lloyd(table, k, rounds):
    kept = [(i, np.floor(1024 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v, _ in table if v and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept])
    order = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"3:{kept[j][0]}".encode()).hexdigest() if kept[j][0] is not None else "z", kept[j][1].tolist()))
    c = x[order[:k]].copy()
    for r in range(rounds + 1):
        d = ((x[:, None, :] - c) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        for j in range(len(c)) if r < rounds else []:
            if (a == j).any():
                c[j] = x[a == j].sum(axis=0) // (a == j).sum()
    far = d.min(axis=1)
    return sorted(((kept[i][0], int(a[i]), int(far[i]), int(far[a == a[i]].sum()), int(far.sum()), c[a[i]].tolist()) for i in range(len(kept))), key=repr)


@pytest.mark.parametrize(("k", "rounds", "block"), [(8, 10, 2048), (5, 3, 7), (3, 0, 64)])
def test_delta_lloyd(spark, k, rounds, block):
    table = hostile(np.random.default_rng(k), 200) + [(None, [0.5] * 64, None)]
    df = spark.createDataFrame(table, VECTORS).withColumn("cluster", F.lit("clash")).withColumn("block", F.lit(1)).repartition(3)
    assert rows(lloyd.cluster(df, k=k, rounds=rounds, block_rows=block, task_blocks=block)) == brute_lloyd(table, k, rounds)


def test_delta_lloyd_small_tables(spark):
    df = spark.createDataFrame([(1, [1.0] * 64, 0), (2, None, 0)], VECTORS)
    assert rows(lloyd.cluster(df)) == [(1, 0, 0, 0, 0, [1024] * 64)]
    assert lloyd.cluster(df.where("vec_id = 2")).collect() == []
    with pytest.raises(Exception, match="beyond"):
        lloyd.cluster(spark.createDataFrame([(1, [1e9] * 64, 0)], VECTORS)).collect()


def test_only_moved_centroids_are_compared():
    """A vector whose centroid stands keeps its distance, even a made-up one; those of moved centroids meet all."""
    x, c = np.array([[0], [9], [20]]), np.array([[0], [10], [18]])
    now, d = lloyd.assigned(x, c, np.array([False, False, True]), np.array([0, 1, 2], np.int32), np.array([5, 6, 7]))
    assert (now.tolist(), d.tolist()) == ([0, 1, 2], [5, 6, 4])
    now, d = lloyd.assigned(x, c, np.array([False, True, True]), np.array([0, 0, 1], np.int32), np.array([5, 99, 7]))
    assert (now.tolist(), d.tolist()) == ([0, 1, 2], [5, 1, 4])
    big = np.array([[1 << 26], [-(1 << 26)]])
    assert lloyd.squared(big, big).tolist() == [[0, 1 << 54], [1 << 54, 0]]


def test_delta_lloyd_equals_its_sql(spark, tmp_path):
    spark.createDataFrame(hostile(np.random.default_rng(1), 60), VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_delta_lloyd(spark, str(tmp_path))
    want = in_sql(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), oracle.oracle_sql()["op11_delta_lloyd"])
    assert rows(got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) == want


# --- 12 -------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps, ids):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if label[i] != label[j] and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    first = {}
    for x, i in zip(label, ids, strict=True):
        if i is not None:
            first[x] = min(first.get(x, i), i)
    return [first.get(x) for x in label]


@pytest.mark.parametrize(("shard_rows", "leaf_sample"), [(16_000, 64), (20, 4)])
def test_simhash(spark, shard_rows, leaf_sample):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    base = [word() for _ in range(400)]
    texts = [None, "", " \n\t", "One", "oNE", "one two", "One two three", "ÉÈ a b c", "éè a b c", "a  b\tc\x0bd"] + [" ".join(base)] * 30
    for _ in range(60):  # near copies by few words
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(150)] + [" ".join(base[:200]) + "\n" + " ".join(base[200:])]
    ids = [None, None, *range(2, len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0)).repartition(3)
    fps = [brute_fingerprint(t) for t in texts]
    want = sorted(zip(ids, fps, brute_components(fps, ids), strict=True), key=repr)
    got = simhash.near_duplicates(df, shard_rows=shard_rows, leaf_sample=leaf_sample)
    assert sorted(((i, f % (1 << 64), c) for i, f, c in got.collect()), key=repr) == want
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("crowded", [False, True])
def test_links_find_all_pairs(spark, crowded):
    """Fingerprints with planted neighbours at each distance around 3; crowded: all within few bits of one another."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, size=700, dtype=np.uint64) if not crowded else np.uint64(0x123456789ABCDEF) ^ np.array([sum(1 << int(b) for b in rng.permutation(64)[:3]) for _ in range(700)], dtype=np.uint64)
    far = np.concatenate([x[:100] ^ np.array([sum(1 << int(b) for b in rng.permutation(64)[:d]) for _ in range(100)], dtype=np.uint64) for d in (1, 2, 3, 4, 5)])
    x = np.unique(np.concatenate([x, far]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    got = {(u, v) for u, v in simhash.links(df, shard_rows=50, leaf_sample=8).collect()}
    assert all((u % (1 << 64) ^ v % (1 << 64)).bit_count() > 0 for u, v in got)
    at = {int(v): i for i, v in enumerate(x)}
    want = brute_components([int(v) for v in x], range(len(x)))
    label = list(range(len(x)))
    for u, v in got:
        a, b = label[at[u % (1 << 64)]], label[at[v % (1 << 64)]]
        label = [min(a, b) if k in (a, b) else k for k in label]
    assert label == want


def test_long_texts_are_hashed_by_segments():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdeABC ") if rng.random() < 0.95 else rng.choice("\n\t é") for _ in range(20_000))
    whole = np.concatenate(list(simhash.shingle_hashes(text.encode())))
    for segment in (1, 7, 100, 4096):
        assert (np.concatenate(list(simhash.shingle_hashes(text.encode(), segment=segment))) == whole).all()
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


# --- 13 -------------------------------------------------------------------------------------------


def brute_negatives(table, every):
    kept = [(i, np.floor(256 * np.array(v, dtype=np.float64)), label) for i, v, label in table if i is not None and label is not None and v and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    x, ids, labels = np.array([v for _, v, _ in kept]), [i for i, _, _ in kept], [label for _, _, label in kept]
    out = []
    for a in range(len(kept)):
        if ids[a] % every:
            continue
        s = (x @ x[a]).astype(np.int64).tolist()
        order = sorted(range(len(kept)), key=lambda j: (-s[j], ids[j]))
        for p in [j for j in order if labels[j] == labels[a] and ids[j] != ids[a]][:5]:
            fits = [j for j in order if labels[j] != labels[a] and 50 * s[p] <= 100 * s[j] <= 95 * s[p]][:3]
            out += [(ids[a], ids[p], k + 1, ids[j], s[p], s[j]) for k, j in enumerate(fits)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("close", [False, True])
def test_hard_negatives(spark, small, close):
    rng = np.random.default_rng(8)
    table = hostile(rng, 300)
    if close:  # vectors in few clusters, so that bounds leave cells out
        centre = rng.normal(size=(6, 64)) * 3
        table = [(i, (centre[i % 6] + rng.normal(size=64) * 0.1).astype(np.float32).tolist(), i % 4) for i in range(400)]
    table += [(None, [1.0] * 64, 1), (7000, [0.5] * 64, None), (7001, None, None)]
    df = spark.createDataFrame(table, VECTORS).withColumn("cell", F.lit("clash")).withColumn("row", F.lit(1)).repartition(3)
    sizes = {"block_rows": 9, "group_rows": 4, "pivot_rows": 20} if small else {}
    got = negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, **sizes)
    assert rows(got) == brute_negatives(table, 5)


def test_bounds_leave_blocks_out(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centre = np.eye(64)[:4] * 4
    table = [(i, (centre[i % 4] + rng.normal(size=64) * 0.02).astype(np.float32).tolist(), i // 4 % 4) for i in range(1600)]
    shares, own = [], negatives.Mining.met

    def met(self, pairs, groups, *more):
        shares.append(pairs.count() / (groups.count() * self.blocks.count()))
        return own(self, pairs, groups, *more)

    monkeypatch.setattr(negatives.Mining, "met", met)
    got = negatives.hard_negatives(spark.createDataFrame(table, VECTORS), F.col("vec_id") % 5 == 0, lowest=90, highest=100, block_rows=50, pivot_rows=80)
    assert got.count() > 0
    assert max(shares) < 0.5


def test_hard_negatives_of_odd_tables(spark):
    df = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(df, F.col("vec_id") % 5 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0] * 64, 1), (1, [1.0] * 64, 1), (2, [-1.0] * 64, 2), (5, [0.0] * 64, 3)], VECTORS)
    assert negatives.hard_negatives(one, F.col("vec_id") % 5 == 0).collect() == []  # no score is in the range; zero vector: no positive
    zero = spark.createDataFrame([(0, [1.0] + [0.0] * 63, 1), (1, [0.0, 1.0] + [0.0] * 62, 1), (2, [0.0, 0.0, 1.0] + [0.0] * 61, 2)], VECTORS)
    assert rows(negatives.hard_negatives(zero, F.col("vec_id") == 0)) == [(0, 1, 1, 2, 0, 0)]  # 0 <= 0 <= 0


def test_blocks_are_dealt_once(spark, monkeypatch):
    table = hostile(np.random.default_rng(10), 400)
    kind = type(spark.range(0))
    fed, own = [], kind.mapInArrow

    def mapped(self, f, schema, *more):
        if schema == negatives.FOUND:
            fed.append(self.count())
        return own(self, f, schema, *more)

    monkeypatch.setattr(kind, "mapInArrow", mapped)
    got = negatives.hard_negatives(spark.createDataFrame(table, VECTORS), F.col("vec_id") % 5 == 0, block_rows=5, group_rows=4, pivot_rows=100)
    assert rows(got) == brute_negatives(table, 5)
    assert len(fed) == 4 and max(fed) < 200  # 80 blocks at least, 20 groups at least: over 1,600 pairs


@pytest.mark.parametrize("high", [1, 40])  # scores of whole numbers in floats and in doubles
def test_hard_negatives_of_copies(spark, high):
    rng = np.random.default_rng(11)
    some = rng.normal(size=(6, 64)).astype(np.float32) * high
    table = [(int(i), some[rng.integers(6)].tolist(), int(i) % 3) for i in rng.permutation(900)]
    table += [(i, some[i % 6].tolist(), 0) for i in (0, 30) for _ in range(8)]  # ids that are repeated
    table += [(900 + i, (some[i % 6] * rng.uniform(0.5, 0.94)).astype(np.float32).tolist(), i % 3) for i in range(90)]
    got = negatives.hard_negatives(spark.createDataFrame(table, VECTORS), F.col("vec_id") % 30 == 0, block_rows=50, group_rows=8, pivot_rows=200, part_rows=300)
    assert rows(got) == brute_negatives(table, 30)


def test_hard_negatives_equal_their_sql(spark, tmp_path):
    spark.createDataFrame(hostile(np.random.default_rng(2), 200), VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    back = spark.read.parquet(f"{tmp_path}/embeddings.parquet").where("size(embedding) = 64")
    got = queries.op13_hard_negatives(spark, str(tmp_path))
    assert rows(got) == in_sql(back, oracle.oracle_sql()["op13_hard_negatives"])
