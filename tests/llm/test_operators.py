"""Every operator over odd rows and empty tables, and against plain versions."""

import base64
import collections
import hashlib
import math
import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridweave.llm import arrays, bpe, chosen_path, langid, licenses, lm, mixing, quality, substrings, tiles, toxicity, vectors
from tests.llm.common import LONG, ODD, empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# mixing


def test_mixing_targets_and_words(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randint(0, 60), s) for i, s in enumerate(["big"] * 300 + ["mid"] * 60 + ["tiny"] * 12 + [None] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for g in got:
        s = by.setdefault(rows[g.doc_id][2], [g.source_size, g.target, 0, 0])
        s[2] += g.taken
        s[3] += g.size
        assert g.taken <= 3 * g.size
    assert all(s[0] == s[3] for s in by.values())
    assert math.isclose(sum(s[1] for s in by.values()), sum(s[0] for s in by.values()))
    assert by["tiny"][1] == 3 * by["tiny"][0]
    assert all(abs(s[2] - s[1]) <= 61 for s in by.values())
    again = {g.doc_id: g.taken for g in mixing.mix_plan(docs.repartition(7)).collect()}
    assert again == {g.doc_id: g.taken for g in got}


def test_mixing_odd_rows(spark):
    got = mixing.mix_plan(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert mixing.mix_plan(empty(spark)).count() == 0
    out = mixing.mix_documents(odd(spark))
    assert out.columns == odd(spark).columns
    assert mixing.mix_documents(empty(spark)).count() == 0


# BPE


def test_bpe_round_trip_and_ids(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.digests(odd(spark), RANKS, public_tokenizers.PATTERN).collect()
    want = sorted((str(d), len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in ODD if (t or "")[:3] != "xxx" for e in [enc.encode_ordinary(t or "")])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id != 6) == want
    assert bpe.digests(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_safe_cuts_change_nothing(seed):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    r = random.Random(seed)
    text = "".join(r.choice(["a", "B", "é", "1", "22", " ", "  ", "\n", "\t ", "'", "'s", "'ll", "!", "?!", "。", "日", " ", "　"]) for _ in range(4000))
    parts = bpe.stretches(text, r.choice([1, 7, 50]))
    assert "".join(parts) == text and len(parts) > 10
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


# quality


def brute_quality(text):
    words = WORD.findall(text or "")
    wins = {}
    for i in range(len(words) - 4):
        wins.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for at in wins.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_quality_counts(spark):
    r = random.Random(5)
    texts = [t for _, t, *_ in ODD] + ["\n".join(" ".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(6)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in quality.quality(docs).collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}
    assert quality.quality(odd(spark)).count() == len(ODD)
    assert quality.quality(empty(spark)).count() == 0


def test_rule_table_compiles_to_one_verdict(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 5.0)], "i int, x double")
    assert [r.ok for r in df.select(quality.compile_rules([("a", "x", ">=", 1.0), ("b", "x", "<", 9.0)]).alias("ok")).collect()] == [False, True]


# language ID


def brute_forward(word, pieces, p):
    """log of the sum over all segmentations, from logarithms."""
    b = (" " + word).encode()
    a = [0.0] + [-math.inf] * len(b)
    for i in range(1, len(b) + 1):
        a[i] = np.logaddexp.reduce([a[j] + math.log(p[pieces[b[j:i]]]) for j in range(i) if b[j:i] in pieces])
    return a[-1]


WORDS = ["the", "straße", "日本", "a", "", "unbelievable", "donaudampfschifffahrtsgesellschaftskapitän", "日本語のとても長い文章" * 9, "x" * 700, "содействиеправительственных" * 4]


def test_forward_sums_all_segmentations():
    pieces = langid.vocabulary(PIECES)
    number = {x: i for i, x in enumerate(pieces)}
    assert max(map(len, pieces)) > 16
    p = np.random.RandomState(0).random_sample((len(pieces), 2)) ** 4 + 1e-9
    p /= p.sum(0)
    find = langid.lookup(PIECES)
    got = langid.log_likelihood(WORDS, find, langid.scaled(p, find))
    for w, g in zip(WORDS, got, strict=True):
        want = [brute_forward(w, number, p[:, k]) for k in (0, 1)] if w else [0, 0]
        assert np.allclose(g, want), w


def test_expected_counts_are_gradients():
    # the expected uses of a piece are its probability times the derivative of the log likelihood
    pieces = langid.vocabulary(PIECES)
    number = {x: i for i, x in enumerate(pieces)}
    p = np.random.RandomState(1).random_sample((len(pieces), 1)) + 0.01
    p /= p.sum()
    find = langid.lookup(PIECES)
    weights = np.arange(2.0 * len(WORDS)).reshape(-1, 2) % 3
    got = langid.expected_counts(WORDS, weights, find, langid.scaled(p, find))
    for piece in (b"the", b" ", b"x", b"xx", "日本".encode(), "日".encode(), b"un", "прав".encode()):
        if piece not in number:
            continue
        k, eps = number[piece], 1e-6
        up, down = p[:, 0].copy(), p[:, 0].copy()
        up[k], down[k] = up[k] * (1 + eps), down[k] * (1 - eps)
        want = sum(weights[i] * (brute_forward(w, number, up) - brute_forward(w, number, down)) / (2 * eps) for i, w in enumerate(WORDS) if w)
        assert np.allclose(got[k], want, rtol=1e-3, atol=1e-4), piece


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = langid.train(docs.where(~held), PIECES)
    got = langid.identify(docs.where(held), model, PIECES).join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_language_odd_rows(spark):
    model = langid.train(odd(spark), PIECES)
    got = langid.identify(odd(spark), model, PIECES).collect()
    assert len(got) == len(ODD)
    assert {str(r.doc_id): r.lang_pred for r in got if r.doc_id in (2, 3, 4, 8)} == dict.fromkeys("2348", "und")
    assert all(0 <= r.score <= 1 for r in got)
    none = langid.train(empty(spark), PIECES)
    assert {r.lang_pred for r in langid.identify(odd(spark), none, PIECES).collect()} == {"und"}
    assert langid.identify(empty(spark), model, PIECES).count() == 0


# toxicity


def within(a, b, k):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d = [i] + [min(d[j] + (x != y), d[j + 1] + 1, -1) if False else min(d[j] + (x != y), d[j + 1] + 1) for j, y in enumerate(b)]
        for j in range(1, len(d)):
            d[j] = min(d[j], d[j - 1] + 1)
    return d[-1] <= k


def test_automaton_is_levenshtein():
    r = random.Random(1)
    terms = {"idiot": 0.9, "worthless": 0.9, "disgustingly": 0.9, "scum": 0.9}
    own = toxicity.LexiconAutomaton(terms, {})
    for _ in range(3000):
        w = list(r.choice(list(terms)))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = [r.choice("idotwhreslgx")] * r.randint(0, 1)
        w = "".join(w)
        assert (own.match(w)[0] > 0) == any(within(w, t, toxicity.edits_of(t)) for t in terms), w


def test_toxic_context(spark):
    lexicon = ({"idiot": 0.95, "worthless": 0.95}, {}, frozenset(), set())
    texts = ["you are an idiot", 'he said "you idiot" to them', "a fine day", "you idoit w0rthles fool", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.predicted, round(r.score, 3)) for r in toxicity.toxicity(docs, lexicon).collect()}
    assert got[0][0] == 1 and got[1][0] == 0 and got[2] == got[4] == (0, toxicity.BASE)
    assert got[3][1] > got[1][1]


def test_toxic_quotations_of_any_length(spark):
    lexicon = ({"idiot": 0.97}, {}, frozenset(), set())
    long = "many quiet words about the town and its river " * 8
    direct = [
        f'"{long.strip()}." you idiot, you idiot',
        f"\u201c{long.strip()}.\u201d you idiot, you idiot",
        f"\u201e{long.strip()}.\u201c you idiot, you idiot",
        f"\u00ab {long.strip()} \u00bb you idiot, you idiot",
        'a 5" pipe, you idiot, you idiot',
        'a stray "mark, you idiot, you idiot',
        f'a stray "mark.\n\n{long} you idiot, "fine" you idiot',
        f'"fine" {long} you idiot, you idiot "fine"',
    ]
    quoted = [
        f'They read out "{long} you idiot {long.strip()}" and left',
        f'They read out "a 5" pipe {long} you idiot" and left',
        f"They read out \u201c{long} you idiot {long.strip()}\u201d and left",
        f"Sie lasen \u201e{long} idiot {long.strip()}\u201c und gingen",
        f"Ils lisent \u00ab {long} idiot {long.strip()} \u00bb et partent",
        f"Sie lasen \u00bb{long} idiot {long.strip()}\u00ab und gingen",
        'They read out "idiot" and left',
        'They read out "you are 5" and "idiot" and left',
    ]
    docs = spark.createDataFrame(list(enumerate(direct + quoted)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lexicon).collect()}
    assert [got[i].predicted for i in range(len(direct))] == [1] * len(direct)
    assert all(got[i].n_hits == 2 and got[i].score > 0.99 for i in range(len(direct)))
    assert [got[len(direct) + i].predicted for i in range(len(quoted))] == [0] * len(quoted)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = toxicity.toxicity(docs, toxicity.learn(docs, labels, held)).where(held).join(labels, "doc_id").collect()
    hits = [r for r in got if r.predicted]
    toxic = [r for r in got if r.toxic]
    assert sum(r.toxic for r in hits) >= 0.85 * len(hits) and sum(r.predicted for r in toxic) >= 0.85 * len(toxic)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None), (8, 0)], "doc_id long, toxic int")
    lexicon = toxicity.learn(odd(spark), labels, F.lit(False))
    assert toxicity.toxicity(odd(spark), lexicon).count() == len(ODD)
    none = toxicity.learn(odd(spark), labels.limit(0), F.lit(False))
    assert toxicity.toxicity(empty(spark), none).count() == 0


# n-gram Jaccard join


def near_rows(seed=2):
    r = random.Random(seed)
    say = lambda k: [f"w{r.randint(0, 5000)}" for _ in range(k)]
    rows, n = [], 0
    for _ in range(12):
        base = say(r.choice([6, 40, 120, 300]))
        for _ in range(r.choice([1, 2, 5, 9])):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 60))):
                t[r.randrange(len(t))] = "x" + str(r.random())
            rows.append((n, " ".join(t)))
            n += 1
    shared = say(50)
    rows += [(n + i, " ".join(say(150) + shared)) for i in range(30)]
    rows += [(900, "one two"), (901, "one  two"), (902, "one two three"), (903, None), (904, ""), (None, rows[0][1])]
    return rows


def brute_links(rows, t=0.8):
    sets = []
    for _, text in rows:
        w = WORD.findall(text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    ok = [bool(s) and rows[i][0] is not None for i, s in enumerate(sets)]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    return links


@pytest.mark.parametrize("small", [256, 4])
def test_join_loses_no_link(spark, monkeypatch, small):
    monkeypatch.setattr(chosen_path, "SMALL", small)
    monkeypatch.setattr(tiles, "PART_ROWS", 3 if small == 4 else 768)
    rows = near_rows()
    got = chosen_path.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    links = brute_links(rows)
    assert {(r.doc_id, r.n_links) for r in got} == {(rows[i][0], len(x)) for i, x in links.items()}
    for r in got:
        i = next(k for k, x in enumerate(rows) if x[0] == r.doc_id)
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert r.doc_id is None or r.class_id == min(rows[k][0] for k in seen)


def family(n, edits=0.045):
    """Copies of one text with words replaced, few of them near enough to link."""
    r = random.Random(n)
    base = [f"w{i}" for i in range(120)]
    return [(i, " ".join(f"x{r.random()}" if r.random() < edits else w for w in base)) for i in range(n)]


def test_join_rows_of_a_family_of_copies_grow_with_it(spark, monkeypatch):
    made = []
    save = chosen_path.Workspace.save

    def counted(self, df):
        out = save(self, df)
        if df.columns == ["node", "id"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(chosen_path.Workspace, "save", counted)
    totals = []
    for n in (400, 800):
        made.clear()
        rows = family(n)
        got = chosen_path.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        totals.append(sum(made))
        if n == 400:
            assert {r.doc_id: r.n_links for r in got} == {i: len(x) for i, x in brute_links(rows).items()}
    assert totals[1] < 2.2 * totals[0] and totals[1] < 40 * 800


def test_join_odd_rows(spark):
    got = chosen_path.similar_documents(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert sorted(r.n_links for r in got if r.doc_id == 1) == [1, 1]
    assert chosen_path.similar_documents(empty(spark)).count() == 0
    kept = chosen_path.similar_groups(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD) - 1


def test_groups_keep_other_texts_of_an_id(spark):
    say = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    rows = [
        (1, say("a"), "x"), (1, say("b"), "y"), (1, say("b") + " more", "z"),  # ids repeat, texts don't; b and b + link
        (2, say("a"), "x"), (3, say("c"), "x"), (3, say("c"), "w"), (3, say("c").replace(" ", "  "), "w"),
        (4, "", "x"), (4, None, "y"), (5, "", "x"), (None, say("a"), "x"), (None, say("a"), "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = chosen_path.similar_groups(docs)
    assert got.columns == docs.columns
    kept = sorted((str(r.doc_id), r.text, r.source) for r in got.collect())
    by = {}
    for d, t, _ in kept:
        by.setdefault(d, []).append(t)
    assert sorted(map(str, by)) == ["1", "3", "4", "5", "None"] and [len(by[x]) for x in ("1", "3", "4", "5", "None")] == [2, 1, 1, 1, 2]
    assert say("a") in by["1"] and len({t[:2] for t in by["1"]}) == 2
    again = sorted((str(r.doc_id), r.text, r.source) for r in chosen_path.similar_groups(docs.repartition(5)).collect())
    assert again == kept


def test_recall_counts_every_split():
    runs = chosen_path.runs_for(0.8)
    meets = 1.0
    for _ in range(chosen_path.DEPTH):
        meets = 1 - math.exp(-1.6 * meets)
    assert (1 - meets) ** runs <= 1e-4 < (1 - meets) ** (runs - 1)


# embeddings


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(tiles, "PART_ROWS", 16)
    r = np.random.RandomState(4)
    centre = r.standard_normal((8, 24))
    x = [centre[i % 8] + r.standard_normal(24) * 0.12 * (i % 5) for i in range(160)]
    rows = [(i, [float(np.float32(v)) for v in y]) for i, y in enumerate(x)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, [0.0] * 24), (503, None), (504, [1.0, None]), (505, [float("nan")] * 24), (506, [float("inf")] + [1.0] * 23), (507, []), (508, [1.0, 2.0]), (None, rows[0][1]), (509, [v * 1e30 for v in rows[1][1]])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0))).collect()
    good = [(i, np.array(np.float32(v), np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _ in good}
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                links[i].add(j)
    assert len(got) == len(rows)
    for g in got:
        if g.vec_id is None:
            continue
        seen, todo = {g.vec_id}, [g.vec_id]
        while todo:
            for j in links.get(todo.pop(), set()) - seen:
                seen.add(j)
                todo.append(j)
        assert (g.n_links, g.component_id, g.kept) == (len(links.get(g.vec_id, ())), min(seen), min(seen) == g.vec_id), g
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# licences


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.py", "some code\nand more of it"),
        (3, "a/b/c/y.py", "hello\nLicensed under the Apache License, Version 2.0.\nworld"),
        (4, "d/z.py", "nothing"),
        (5, None, None),
        (6, "a/b/COPYING.txt", "This program is free software: you can redistribute it under the terms of the GNU General Public License, version 3"),
        (7, "a/b/c/d/w.py", ""),
        (7, "a/b/c/d/w.py", ""),
        (8, "top.py", "the license of this work"),
    ]
    rows += [(9, "e/LICENSE", next(x[1] for x in licenses.TEMPLATES if x[0] == "ISC" and len(x[1]) > 200).replace(". ", ".\n\n")), (10, "e/f/g/h.c", "int main; " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    for name in ("key", "license", "own", "h", "at", "folder", "similarity"):
        df = df.withColumn(name, F.lit("clash"))
    got = {r.doc_id: (r.license, r.basis, r.license_path) for r in licenses.license_scan(df).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("Apache-2.0", "own", None), 4: (None, "none", None), 5: (None, "none", None), 6: ("GPL-3.0", "own", None), 7: ("GPL-3.0", "inherited", "a/b"), 8: (None, "none", None), 9: ("ISC", "own", None), 10: ("ISC", "inherited", "e")}
    assert licenses.license_scan(df).count() == len(rows)
    assert licenses.license_scan(df.limit(0)).count() == 0


def plain_license(text):
    """(similarity, licence) of the nearest template that a passage, window or the text is open to."""
    tokens = lambda t: re.findall("[a-z0-9]+", t.lower())
    n = len({x[0] for x in licenses.TEMPLATES})
    users = collections.defaultdict(set)
    for x in licenses.TEMPLATES:
        for w in tokens(x[1]):
            users[w].add(x[0])
    vec = lambda words: {w: k * (math.log((n + 1) / (len(users.get(w, ())) + 1)) + 1) for w, k in collections.Counter(words).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    has = lambda words, needs, bars: all(set(g) & set(words) for g in needs) and not set(bars) & set(words)
    full = tokens(text)
    units = [tokens(x) for x in re.split(r"\n|(?<=[.;:!?])\s", text)] + [full]
    for size in (32, 64):
        units += [full[i : i + size] for i in range(0, len(full) - size // 2, size // 2)] if len(full) > size else []
    found = []
    for words in units:
        p = vec(words)
        for x, (needs, bars, file_needs, file_bars) in zip(licenses.TEMPLATES, licenses.conditions(), strict=True):
            if p and has(words, needs, bars) and has(full, file_needs, file_bars):
                q = vec(tokens(x[1]))
                found.append((-round(sum(y * q.get(w, 0) for w, y in p.items()) / (norm(p) * norm(q)), 6), x[0]))
    best = min(found, default=(0, None))
    return (-best[0], best[1]) if -best[0] >= licenses.THRESHOLD else (0.0, None)


def test_licenses_by_cosine_alone(spark):
    notices = ["CC BY-SA 4.0", "Released under MIT.", "CC BY-NC 4.0", "Apache 2.0", "Under CC BY 4.0 since May.", "Licensed under the XYZ License", "Licensed under the GNU General Public License", "GNU General Public License, version 4"]
    notices += ["/* This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2\n * of the License, or any later version. */\n" + "int x = 3;\n" * 50]
    rows = [(i, f"p{i}/LICENSE", t) for i, t in enumerate(notices)]
    rows += [(100 + i, f"p{i}/a/x.py", "some code of mine") for i in range(len(notices))] + [(200 + i, f"q/{i}.txt", f"plain prose number {i} of the town") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    for i, path, text in rows:
        similarity, name = plain_license(text)
        assert (got[i].basis == "own") == (name is not None), (text, similarity)
        if name:
            assert got[i].license == name and abs(got[i].similarity - similarity) < 1e-5, (text, name)
    names = {0: "CC-BY-SA-4.0", 1: "MIT", 2: "CC-BY-NC-4.0", 3: "Apache-2.0", 5: None, 6: None, 7: None, 8: "GPL-2.0"}
    assert {i: got[i].license for i in names} == names == {i: got[100 + i].license for i in names}


#: Openings of licence files as they are published, lines and all.
FSF = " Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n"
BSD_2 = "Copyright (c) 2020, An Author\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
BSD_END = '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED.\n'
FILES = {
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA\n" + FSF + "                            Preamble\n\n  The licenses for most software are designed to take away your\nfreedom to share and change it.  By contrast, the GNU General Public\nLicense is intended to guarantee your freedom to share and change free\nsoftware--to make sure the software is free for all its users.\n",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n" + FSF + "                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\n  The licenses for most software and other practical works are designed\nto take away your freedom to share and change the works.\n",
    "LGPL-3.0": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n" + FSF + "  This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below.\n",
    "AGPL-3.0": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n" + FSF + "                            Preamble\n\n  The GNU Affero General Public License is a free, copyleft license for\nsoftware and other kinds of works, specifically designed to ensure\ncooperation with the community in the case of network server software.\n",
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n      \"License\" shall mean the terms and conditions for use, reproduction,\n      and distribution as defined by Sections 1 through 9 of this document.\n",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. \"Contributor\"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.\n",
    "EPL-2.0": "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n    PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION\n    OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.\n\n1. DEFINITIONS\n",
    "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE\n    LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN\n    ATTORNEY-CLIENT RELATIONSHIP.\n",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International Public License\n\nBy exercising the Licensed Rights (defined below), You accept and agree\nto be bound by the terms and conditions of this Creative Commons\nAttribution 4.0 International Public License (\"Public License\").\n",
    "ISC": "Copyright (c) 2020 An Author\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
    "BSD-2-Clause": BSD_2 + BSD_END,
    "BSD-3-Clause": BSD_2 + "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n" + BSD_END,
}


def test_license_files_in_corpora_of_any_size(spark):
    """Each file has its licence, and its folder too, however many other files there are."""
    own = [(i, f"f{i}/LICENSE", t) for i, t in enumerate(FILES.values())] + [(100 + i, f"f{i}/src/a.c", "int main;") for i in range(len(FILES))]
    # after other text, and before a long rest
    own += [(200 + i, f"g{i}/COPYING", "This folder holds the sources of a small tool and of its manual.\n\n" + t + "Other lines of prose follow here.\n" * 300) for i, t in enumerate(FILES.values())]
    seen = []
    for n in (10, 1_000, 10_000):
        prose = spark.range(n).select((F.col("id") + 1000).alias("doc_id"), F.format_string("q/%d.txt", "id").alias("path"), F.format_string("the software of town %d is free for the public", "id").alias("text"))
        df = spark.createDataFrame(own, "doc_id long, path string, text string").unionByName(prose)
        got = {r.doc_id: (r.license, r.similarity, r.basis) for r in licenses.license_scan(df).where("doc_id < 1000").collect()}
        for i, name in enumerate(FILES):
            assert got[i][0] == name == got[100 + i][0] == got[200 + i][0], (name, got[i], got[200 + i])
            assert (got[i][1], got[i][2]) == (plain_license(own[i][2])[0], "own") and got[100 + i][2] == "inherited"
        seen.append(got)
    assert seen[0] == seen[1] == seen[2]


def test_published_license_texts(spark):
    """Whole texts as systems ship them, where this one does; those in the test above hold everywhere."""
    folder = "/usr/share/common-licenses"
    names = {"GPL-1": "GPL-1.0", "LGPL-2": "LGPL-2.0", "MPL-1.1": "MPL-1.1", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause", "Artistic": None, "GFDL-1.3": None}
    there = [(x, f"{x}/LICENSE", open(f"{folder}/{x}").read()) for x in names if os.path.exists(f"{folder}/{x}")]
    got = {r.doc_id: r.license for r in licenses.license_scan(spark.createDataFrame(there, "doc_id string, path string, text string")).collect()}
    assert got == {x: names[x] for x, *_ in there}


# the others over odd rows


def test_substrings_and_lm_odd_rows(spark):
    assert substrings.removed_spans(odd(spark)).count() == len(ODD)
    out = substrings.dedup_documents(odd(spark))
    assert out.columns == odd(spark).columns
    assert lm.lm_scores(odd(spark), F.col("doc_id") == 1).count() == len(ODD)


def test_long_text_is_whole(spark):
    assert bpe.digests(spark.createDataFrame([(1, LONG)], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).first().decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()


def test_hasher_windows_are_spans():
    buf = np.frombuffer(b"abcabcabcabc", np.uint8)
    h = arrays.Hasher(buf)
    w = h.windows(3)
    assert w[0] == w[3] == w[6] and len(set(w.tolist())) == 3
    assert (h.spans(np.arange(10), np.arange(10) + 3) == w).all()
