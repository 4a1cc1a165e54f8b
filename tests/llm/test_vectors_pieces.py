"""Hard negatives, centroids and pieces against plain versions."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridweave.llm import centroids, dual_tree, pieces
from tests.llm.common import ODD, empty, odd

VECTORS = "vec_id long, embedding array<float>, label int, whole string, uid string, leaf string, center string, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], VECTORS)


def mixed(n, dim, seed):
    """Vectors with copies, ties, repeated ids and all that can be wrong with them."""
    r = np.random.RandomState(seed)
    x = np.round(r.standard_normal((n, dim)) * 2) / 8
    rows = [(i, x[i % max(1, n - 40)].astype(float).tolist(), int(r.randint(4))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [None] * dim, 1), (n + 3, [float("nan")] * dim, 2), (n + 4, [float("inf")] * dim, 2), (n + 5, [0.5] * dim, None), (None, [0.5] * dim, 1), (n + 6, [0.25] * (dim - 1), 1), (n + 7, [0.0] * dim, 1)]
    return rows + [(100, [0.25] * dim, 1), (100, [0.25] * dim, 1), (200, [0.5] * (dim - 1), 2)]


def plain_negatives(rows, positives=5, negatives=10):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int), lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for at, (a, x, lab) in enumerate(ok):
        if a % 100:
            continue
        near = [(-int(x @ y), b, k) for k, (b, y, m) in enumerate(ok) if m == lab and k != at and len(y) == len(x)]
        far = sorted((-int(x @ y), b) for b, y, m in ok if m != lab and len(y) == len(x))
        for s, b, _ in sorted(near)[:positives]:
            best = [t for t in far if 30 * -s <= 100 * -t[0] <= 90 * -s][:negatives]
            out += [(a, b, k + 1, c, -s, -t) for k, (t, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim"), [(700, 8), (60, 3)])
def test_hard_negatives_equal_all_pairs(spark, n, dim, monkeypatch):
    monkeypatch.setattr(dual_tree, "ANCHOR_LEAF", 2)
    monkeypatch.setattr(dual_tree, "CANDIDATE_LEAF", 16)
    monkeypatch.setattr(dual_tree, "FANOUT", 4)
    rows = mixed(n, dim, 3)
    out = dual_tree.hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == plain_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(1, [1.0, 2.0], 1)], [(100, [1.0], None)]):
        assert dual_tree.hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0).count() == 0


def test_intervals_hold_and_prune(spark):
    """Far clusters leave few pairs of leaves, and the result is that of all pairs."""
    r = np.random.RandomState(5)
    rows = []
    for i in range(600):
        c = np.zeros(6)
        c[i % 6] = 4
        rows.append((i, (c + r.standard_normal(6) / 16).tolist(), i % 2))
    df = vectors(spark, rows)
    assert sorted(map(tuple, dual_tree.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())) == plain_negatives(rows)
    way, cut = dual_tree.split_tree(np.array([x for _, x, _ in rows]))
    leaf, _ = dual_tree.leaf_of(np.array([x for _, x, _ in rows]), way, cut)
    held = defaultdict(set)
    for i, x in enumerate(leaf.tolist()):
        held[x].add(i % 6)
    assert sum(len(h) == 1 for h in held.values()) > len(held) / 2


def plain_clusters(rows, k=40, rounds=5, dim=64):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v, _ in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], np.int64).tobytes()))
    cents = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in kept:
            by[nearest(v)[1]].append(v)
        for j, vs in by.items():
            cents[j] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    own = defaultdict(int)
    for _, j, d in found:
        own[j] += d
    return sorted(((i, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, j, d in found), key=repr)


@pytest.mark.parametrize(("n", "k", "dim"), [(300, 12, 10), (5, 40, 3)])
def test_clusters_equal_plain_rounds(spark, n, k, dim):
    rows = mixed(n, dim, 8)
    out = centroids.cluster_vectors(vectors(spark, rows), k=k, components=dim)
    assert sorted(map(tuple, out.collect()), key=repr) == plain_clusters(rows, k, dim=dim)


def test_clusters_of_nothing(spark):
    assert centroids.cluster_vectors(vectors(spark, [(1, [1.0], 1)])).count() == 0
    assert centroids.cluster_vectors(vectors(spark, [])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_stay_under_distances_and_prune():
    r = np.random.RandomState(2)
    c = r.randint(-200, 200, (40, 64))
    x = c[r.randint(40, size=500)] + r.randint(-9, 9, (500, 64))
    small, c_small = centroids.compress(x), centroids.compress(c)
    real = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (((small[:, None] - c_small[None]) ** 2).sum(2) <= real * (1 + 1e-9)).all()
    best, far, taken = centroids.assign(x, small, c)
    assert (best == real.argmin(1)).all() and (far == real.min(1)).all() and taken < 3 * len(x)
    with pytest.raises(OverflowError):
        list(centroids_of_huge())


def centroids_of_huge():
    from pyspark.sql import SparkSession

    df = SparkSession.active().createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<float>")
    try:
        yield centroids.cluster_vectors(df, components=2).collect()
    except Exception as e:
        raise OverflowError from e


@pytest.fixture(scope="module")
def model_path():
    return public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(model_path):
    own, r = pieces.vocabulary(model_path), random.Random(4)
    texts = ["", " ", "a", "  a  b ", "a▁b", "\n\na\tb", "ﬁ①", "a\x00b", "<s>x</s>", "<0x41>", "�", "x" * 5000, " " * 900, "日本語テキスト👍🏽 " * 50, "ab" * 3000 + " " * 77 + "é́" * 40, "word " * 20000]
    texts += ["".join(r.choice(" abcdetnh  \n▁éß日👍190.,<>sx") for _ in range(r.randint(0, 150))) for _ in range(500)]
    ids, ends, agrees = own.encode_texts(texts)
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == own.model.encode(text)
        assert tuple(own.model.encode(text)) == tuple(y for s in own.stretches(own.model.normalize(text) if text else "") for y in own.agenda(s))
    assert agrees.all()


def test_disagreement_is_told(model_path):
    """Where an agenda joined other pairs than the library, the batch's check says so."""
    own = pieces.Pieces(model_path)
    own._rank = np.where(own._to == own.ids["▁international"], pieces._NEVER, own._rank)
    ids, ends, agrees = own.encode_texts(["international conversations", ""])
    assert ids[: ends[1]].tolist() != own.model.encode("international conversations")
    assert agrees.tolist() == [False, True]


def test_odd_rows_of_pieces(spark, model_path):
    own = pieces.vocabulary(model_path).model
    out = pieces.digests(odd(spark), model_path)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
    want = []
    for doc_id, text, *_ in ODD:
        ids = own.encode(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest() if ids else hashlib.sha256(b"").hexdigest(), True))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert pieces.digests(empty(spark), model_path).count() == 0
