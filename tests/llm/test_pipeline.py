import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from gridweave.llm import langid
from gridweave.workspace import Workspace
from tests.llm.common import ODD, empty, odd
from tests.llm.test_operators import WORD, brute_links

COLUMNS = "doc_id text lang source n_chars".split()


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """(folder, each stage's input, the last stage's result), from documents with planted copies and passages."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(COLUMNS)
    rows = [tuple(r) for r in table.orderBy("doc_id").collect()]
    top = max(r[0] for r in rows)
    words = [r for r in rows if r[1] and 60 < len(r[1].split()) < 400][:12]
    passage = " ".join(words[0][1].split()[:40])
    for i, (_, text, lang, source, _) in enumerate(words):
        split = text.split(" ")
        split[len(split) // 2] = "planted"
        cut = f"{passage} {' '.join(reversed(split))} é{passage}"
        for k, x in enumerate((text, " ".join(split), cut)):
            rows.append((top + 1 + 3 * i + k, x, lang, source, len(x)))
    rows += [(top + 100, None, "en", "a", None), (top + 101, "", "de", None, 0), (top + 102, "12 34 56", "en", None, 8)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, table.schema).write.parquet(f"{folder}/documents.parquet")
    ws, docs = Workspace(spark), [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(ws.save(stage(spark, docs[-1], folder)))
    return folder, docs


def values(df):
    return Counter(tuple(r) for r in df.select(COLUMNS).collect())


def test_language_stage_keeps_what_is_told(inputs):
    before, after = inputs[1][0:2]
    path = public_tokenizers.path("piece_bpe_32k.model")
    told = {r.doc_id: r for r in langid.identify(before, langid.train(before, path), path).collect()}
    want = Counter()
    for r in before.collect():
        if told[r.doc_id].lang_pred != "und" and told[r.doc_id].score >= 0.5:
            want[r.doc_id, r.text, told[r.doc_id].lang_pred, r.source, r.n_chars] += 1
    assert values(after) == want
    assert 0 < before.count() - after.count() < before.count() // 10


def test_near_duplicate_stage_against_all_pairs(inputs):
    before, after = inputs[1][1:3]
    rows = sorted(tuple(r) for r in before.select(COLUMNS).collect())
    links = brute_links([r[:2] for r in rows])
    seen, want = set(), Counter()
    for i, row in enumerate(rows):
        if i in seen:
            continue
        want[row] += 1
        todo = [i]
        while todo:
            k = todo.pop()
            seen.add(k)
            todo += links[k] - seen
    assert values(after) == want and sum(want.values()) < len(rows)


def test_repeated_passage_stage_against_all_windows(inputs):
    before, after = inputs[1][2:4]
    rows = sorted((tuple(r) for r in before.select(COLUMNS).collect()), key=lambda r: r[0])
    first, want, cut = {}, Counter(), 0
    for d, text, *_ in rows:
        b = (text or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, text, lang, source, n_chars in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        if not gone.any():
            want[d, text, lang, source, n_chars] += 1
            continue
        cut, at, left = cut + 1, 0, ""
        for c in text:
            size = len(c.encode())
            left += "" if gone[at : at + size].any() else c
            at += size
        if left:
            want[d, left, lang, source, len(left)] += 1
    assert values(after) == want and cut


def test_mixing_stage_against_plain_water_filling(inputs):
    before, after = inputs[1][3:5]
    rows = [tuple(r) for r in before.select(COLUMNS).collect()]
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    own = defaultdict(int)
    for r in rows:
        own[r[3]] += size[r[0]]
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: float(i % 3 + 1) for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        rest = sum(own.values()) - sum(3.0 * own[s] for s in order if s not in free)
        share = {s: weight[s] * rest / sum(weight[t] for t in free) for s in free}
        above = {s for s in free if share[s] > 3 * own[s]}
        free -= above
        if not above or not free:
            break
    target = {s: share[s] if s in free else 3.0 * own[s] for s in order}
    want = Counter()
    for s in order:
        whole = int(target[s] // own[s]) if own[s] else 1
        owed, ahead = target[s] - whole * own[s], 0
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"mix/{r[0]}".encode()).hexdigest())
        for r in mine:
            n = size[r[0]]
            more = owed > 0 and n > 0 and 2 * ahead + n <= 2 * owed
            ahead += n
            if whole + more:
                want[r] = whole + more
    assert values(after) == want


def test_token_stage_against_tiktoken(inputs):
    import tiktoken

    before, after = inputs[1][4:6]
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in before.collect():
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect()) == want


def test_run_is_its_stages(spark, inputs):
    folder, docs = inputs
    got = corpus_pipeline.run(spark, folder)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, docs[-1].select(got.columns).collect()))
    assert all(d.columns == COLUMNS for d in docs[1:-1])


def test_stages_bear_odd_rows(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), None).count() == 0
        assert stage(spark, odd(spark), None).count() <= 3 * len(ODD)
