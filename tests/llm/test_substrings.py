import hashlib
import os
import random

from gridweave.llm import arrays, substrings


def brute(rows, width=50):
    """doc_id, n_bytes, n_removed, n_spans and digest by looking at every window."""
    seen, out = {}, []
    big = 2**63 - 1
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            seen[w] = min(seen.get(w, big), big if d is None else d)
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] < (big if d is None else d):
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((-1 if d is None else d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = [("".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))) for _ in range(80)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [say(15) for _ in range(4)] + ["=" * 120, "ab" * 70]
    rows = []
    for i in range(n):
        parts = [say(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), say(r.randint(0, 10))]
        rows.append((i * 3 % (n + 1), r.choice(["\n", " ", ""]).join(parts)))
    for i in range(12):
        d, t = rows[i]
        k = r.randint(0, len(t))
        rows.append((1000 + i, t[:k] + "X" + t[k + 1 :]))
        rows.append((2000 + i, t))
    rows += [(5000, ""), (5001, None), (5002, "short"), (None, rows[0][1]), (rows[3][0], rows[4][1]), (6000, "日本語テキスト" * 20), (6001, "x日本語テキスト" * 20 + "日本語テキスト" * 20)]
    return rows


def digest_rows(out):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest_rows(substrings.removed_spans(docs)) == brute(rows)


def test_small_blocks_and_cut_texts(spark, monkeypatch):
    from gridweave.llm import exchange

    monkeypatch.setattr(exchange, "BLOCK_BYTES", (4000, 4000))
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", substrings.F.lit("own"))
    assert digest_rows(substrings.removed_spans(docs)) == brute(rows)


def test_crowded_anchors_and_many_parts(spark, monkeypatch):
    from gridweave.llm import exchange

    monkeypatch.setattr(exchange, "BLOCK_BYTES", (2000, 2000))
    monkeypatch.setattr(exchange, "TABLE_BLOCKS", 4)  # as if Spark allowed a table so many buckets
    monkeypatch.setattr(substrings, "CROWD", 2)
    rows = corpus(3) + [(None, f"{i} of those without an id, of whom there are many more than one") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest_rows(substrings.removed_spans(docs)) == brute(rows)


def test_a_repeated_id_and_null_ids_spread(spark, monkeypatch):
    from gridweave.llm import exchange
    from gridweave.workspace import Workspace

    monkeypatch.setattr(exchange, "BLOCK_BYTES", (2000, 2000))
    docs = spark.createDataFrame([(i % 2 or None, f"text {i} " * 20) for i in range(200)], "doc_id long, text string")
    ws = Workspace(spark)
    blocks = exchange.Blocks(docs, ws)
    most = spark.table(blocks.name).groupBy("block").count().agg({"count": "max"}).first()[0]
    ws.clear()
    assert blocks.n > 10 and most < 60


def test_radix_groups_are_equal_suffixes(monkeypatch):
    import numpy as np

    r = random.Random(6)
    for width in (3, 8, 21, 50):
        buf = np.frombuffer("".join(r.choice("ab") * r.choice([1, 9, 40]) for _ in range(60)).encode(), np.uint8)
        n = len(buf) - width + 1
        group = np.array([r.randint(0, 2) for _ in range(n)], np.uint64)
        label = substrings.radix_groups(group, substrings.Suffixes(buf, np.arange(n), np.full(n, width)))
        key = [(int(g), buf[i : i + width].tobytes()) for i, g in enumerate(group)]
        by = {}
        for k, x in zip(key, label.tolist(), strict=True):
            by.setdefault(k, set()).add(x)
        assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)


def test_equality_is_of_bytes_not_of_hashes(monkeypatch):
    import numpy as np

    monkeypatch.setattr(substrings, "ORDERED", 5)
    r = random.Random(7)
    runs = ["".join(r.choice("xy") for _ in range(9 + r.randint(0, 3))) for _ in range(80)]
    ids = np.array([r.randint(0, 20) for _ in runs])
    n = np.array([len(x) - 9 + 1 for x in runs])
    key = np.array([r.randint(0, 3) for _ in runs], np.uint64)
    bits = substrings.gone_windows(key, n, ids, np.frombuffer("".join(runs).encode(), np.uint8), 9)
    for i, x in enumerate(runs):
        for j in range(n[i]):
            w = x[j : j + 9]
            gone = any(key[k] == key[i] and ids[k] < ids[i] and w in y for k, y in enumerate(runs))
            assert bool(bits[i] >> np.uint32(j) & np.uint32(1)) == gone
    same = np.zeros(3, np.uint64)  # one hash, two strings
    label = substrings._equal_spans(np.frombuffer(b"abcabdabc", np.uint8), same, np.array([0, 3, 6]), np.full(3, 3))
    assert label[0] == label[2] != label[1]


def test_pieces_cover_every_window_once():
    import numpy as np

    old = substrings.SLICE_BYTES
    substrings.SLICE_BYTES = 100
    try:
        buf = np.frombuffer(bytes(range(200)) * 3, np.uint8)
        got = [before + i for data, offs, _, before in substrings.pieces(buf, np.array([0, len(buf)]), 50) for i in range(len(data) - 49)]
    finally:
        substrings.SLICE_BYTES = old
    assert got == list(range(len(buf) - 49))


def test_empty_table(spark):
    assert substrings.removed_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dedup_documents_keeps_columns(spark):
    p = "a passage of more than fifty bytes, so that it repeats; " * 2
    docs = spark.createDataFrame([(1, p, "en", 5), (2, p, "en", 5), (3, p + "own words", None, 5), (4, None, "en", 0), (5, "", None, 0), (6, "é" * 30, "fr", 30), (7, "x" + "é" * 30, "fr", 31), (None, p, "de", 1)], "doc_id long, text string, lang string, n_chars long")
    out = substrings.dedup_documents(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: p, 3: "own words", 4: None, 5: "", 6: "é" * 30, 7: "x"}


def test_word_spans_do_not_cross_texts():
    import numpy as np

    buf = np.frombuffer(b"ab cdef  g", np.uint8)
    s, e, t = arrays.word_spans(buf, np.array([0, 2, 5, 5, 10]))
    assert [(buf[a:b].tobytes(), int(k)) for a, b, k in zip(s, e, t)] == [(b"ab", 0), (b"cd", 1), (b"ef", 3), (b"g", 3)]


def test_equal_rows_lie_in_several_blocks(spark, monkeypatch):
    """Copies of one row, its id null or not, don't share a block, and results stay those of every window."""
    from gridweave.llm import exchange
    from gridweave.workspace import Workspace

    monkeypatch.setattr(exchange, "BLOCK_BYTES", (4000, 4000))
    text = "the same notice stands in every one of these rows, word for word"
    rows = corpus(3, 20) + [(None, text)] * 300 + [(77, text)] * 300 + [(78, f"a row of its own {text}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ws = Workspace(spark)
    blocks = exchange.Blocks(docs, ws)
    table = spark.table(blocks.name)
    assert table.count() == len(rows)
    for own in ("doc_id is null", "doc_id = 77"):
        by_block = [r["count"] for r in table.where(own).groupBy("block").count().collect()]
        assert len(by_block) > blocks.n / 2 and max(by_block) < 100
    ws.clear()
    assert digest_rows(substrings.removed_spans(docs)) == brute(rows)


def test_blocks_stay_out_of_the_warehouse(spark):
    from gridweave.llm import exchange
    from gridweave.workspace import Workspace

    ws = Workspace(spark)
    blocks = exchange.Blocks(spark.createDataFrame(corpus(4, 10), "doc_id long, text string"), ws)
    place = spark.sql(f"DESCRIBE FORMATTED {blocks.name}").where("col_name = 'Location'").first().data_type
    path = ws.root.removeprefix("file://")
    assert path in place and os.path.isdir(f"{path}/{blocks.name}")
    ws.clear()
    assert not os.path.exists(f"{path}/{blocks.name}") and not spark.catalog.tableExists(blocks.name)
