import math
import re
import zlib

from pyspark.sql import functions as F

from gridweave.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_base_against_brute_force_and_model_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900001, None), (900002, ""), (900003, "ÀB ab AB\x0bab x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = {r.doc_id: r for r in lm.lm_scores(docs, held).collect()}
    counts, toks = {}, {}
    for d, t in rows:
        toks[d] = [*WORD.findall(low(t)), None]
        if zlib.crc32(str(d).encode()) % 5 != 1:
            for w in toks[d]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for d, t in toks.items():
        r = got[d]
        want = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 5 == 1, len(t), sum(w in counts for w in t), n)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want))
        assert r.score < 0 and math.isfinite(r.score)
    held_rows = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)


def test_probabilities_sum_to_one():
    import numpy as np

    m = lm.Model(100, 10, np.array([5, 9], np.uint64), np.array([0, 1]), np.array([0, 1]))
    rng = np.random.RandomState(0)
    bigrams = rng.randint(0, 5, (m.size, m.size)).astype(float)
    size = bigrams.sum(0)
    once = np.minimum(size, 2)
    m.fit(bigrams, once)
    # one word a class, with all of its class's tokens, and the unseen type
    for prior in range(m.size):
        total = sum(10 ** m.log_step[prior, c] * m.keep[c] * size[c] / m.class_size[c] for c in range(m.size)) + 10 ** m.log_new[prior]
        assert abs(total - 1) < 1e-9


def test_score_is_the_models_by_hand():
    import numpy as np

    # classes 0 and 1, the end, and the coarse ones; words by number, 5 and 6 unseen in training
    cls_of = {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 1}
    texts = [[0, 2, 1, 3], [1, 2], [0, 4, 0, 2], [], [3]]
    m = lm.Model(20, 6, np.array([], np.uint64), np.array([], np.int64), classes=2)
    end = m.end
    seqs = [[*t, "end"] for t in texts]
    count = {w: sum(t.count(w) for t in seqs) for w in [*range(7), "end"]}
    c = lambda w: end if w == "end" else cls_of[w]
    table, once = np.zeros((m.size, m.size)), np.zeros(m.size)
    for t in seqs:
        for a, b in zip(["end", *t], t):
            table[c(a), c(b)] += 1
    for w in range(7):
        once[c(w)] += count[w] == 1
    m.fit(table, once)
    size = table.sum(0)
    share = (size + 0.5) / (size.sum() + 0.5 * m.size)
    new = [0.0 if k == end else (once[k] + 0.5) / (size[k] + 1) for k in range(m.size)]

    def step(a, b):
        return (table[a, b] + lm.TRANSITION_PRIOR * share[b]) / (table[a].sum() + lm.TRANSITION_PRIOR)

    for text in ([0, 2], [1, 5, 3], [6, 6, 0], [5], []):
        words, want, before, anchor = [*text, "end"], 0.0, end, end
        for w in words:
            if count[w]:
                k = c(w)
                want += math.log10(step(before, k) * (1 - new[k]) * count[w] / size[k])
                before = anchor = k
            else:
                want += math.log10(sum(step(before, k) * new[k] for k in range(m.size)))
                before = max(range(m.size), key=lambda k: (step(anchor, k) * new[k], -k))
        got = m.score(np.array([c(w) for w in words]), np.array([count[w] for w in words])).sum()
        assert abs(got - want) < 1e-9, text


def test_clusters_find_alternation():
    import numpy as np

    b = np.zeros((6, 6), np.int64)
    for i in (0, 2):
        for j in (1, 3):
            b[i, j] = b[j, i] = 50
    c = lm.exchange_clusters(b, 4, 2, 2)
    assert c[0] == c[2] != c[1] == c[3]


def test_no_training_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = lm.lm_scores(docs, F.lit(True)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 0, 0), (3, 0, 0)]
    assert lm.lm_scores(docs.limit(0), F.lit(None).cast("boolean")).count() == 0


def test_rare_words_are_classed_by_rare_neighbours(spark, monkeypatch):
    import random

    # no word of the pairs is frequent: first and second halves meet only each other and the end
    monkeypatch.setattr(lm, "FREQUENT", 1)
    r = random.Random(4)
    say = lambda: f"a{r.randint(0, 60)} b{r.randint(0, 60)}"
    rows = [(i, say()) for i in range(3000)] + [(5000 + i, "the") for i in range(4000)]
    rows += [(9001, "a1 b1"), (9002, "b1 a1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.lm_scores(docs, F.col("doc_id") > 9000).where("doc_id > 9000").collect()}
    assert got[9001] > got[9002] + 2


def test_best_classes_is_the_likelihoods():
    import numpy as np

    rng = np.random.RandomState(5)
    n, size, end = 30, 5, 4
    pairs = rng.poisson(0.6, (n + 1, n + 1))
    np.fill_diagonal(pairs, 0)
    cls = np.r_[rng.randint(0, 4, n), end]

    def table(c):
        out = np.zeros((size, size))
        np.add.at(out, (np.repeat(c, n + 1), np.tile(c, n + 1)), pairs.ravel())
        return out

    word, cell, count = [], [], []
    for w in range(n):
        both = np.r_[np.bincount(cls, pairs[:, w], size), np.bincount(cls, pairs[w], size)]
        for c in np.flatnonzero(both):
            word, cell, count = [*word, w], [*cell, c], [*count, both[c]]
    got = lm.best_classes(cls[:n], np.array(word), np.array(cell), np.array(count), table(cls), end, chunk=7)
    assert (got != end).all()
    risen = 0
    for w in np.flatnonzero(got != cls[:n]):
        alone = cls.copy()
        alone[w] = got[w]
        risen += lm.likelihood(table(alone)) > lm.likelihood(table(cls))
    assert risen >= 0.8 * (got != cls[:n]).sum() > 0
