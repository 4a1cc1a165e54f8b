"""The training-data operators applied to whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_FOLDER_FILE = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    from gridweave.llm.mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark, sf_dir):
    from gridweave.llm.chosen_path import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from gridweave.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_FOLDER_FILE), public_tokenizers.PATTERN)


def op4_toxicity(spark, sf_dir):
    from gridweave.llm.toxicity import learn, toxicity

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = toxicity(docs, learn(docs, table(spark, sf_dir, "labels"), held_out))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits")


def op5_suffix_dedup(spark, sf_dir):
    from gridweave.llm.substrings import removed_spans

    return removed_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_quality_rules(spark, sf_dir):
    from gridweave.llm.quality import quality

    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_license_scan(spark, sf_dir):
    from gridweave.llm.licenses import document_paths, license_scan

    return license_scan(document_paths(table(spark, sf_dir, "documents")))


def op8_language_id(spark, sf_dir):
    import public_tokenizers

    from gridweave.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = identify(docs, train(docs.where(~held_out), path), path)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_near_vectors(spark, sf_dir):
    from gridweave.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_lm_scoring(spark, sf_dir):
    from gridweave.llm.lm import lm_scores

    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return lm_scores(table(spark, sf_dir, "documents"), held_out)


def op11_hard_negatives(spark, sf_dir):
    from gridweave.llm.dual_tree import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_pieces(spark, sf_dir):
    import public_tokenizers

    from gridweave.llm.pieces import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_centroids(spark, sf_dir):
    from gridweave.llm.centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_near_vectors": op9_near_vectors,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_pieces": op12_pieces,
    "op13_centroids": op13_centroids,
}


def _rounds_sql(k: int, rounds: int, components: int) -> str:
    """Clustering in whole numbers: a pair of tables a round, the centroids and the nearest of each vector."""
    out = [rf"""WITH told AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
cells AS (SELECT r, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM told),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM told QUALIFY k < {k}),
c0 AS MATERIALIZED (SELECT CAST(k AS INT) AS k, pos, x FROM first JOIN cells USING (r))"""]
    for i in range(rounds + 1):
        out.append(rf"""d{i} AS (SELECT r, k, CAST(sum((a.x - c.x) * (a.x - c.x)) AS BIGINT) AS d FROM cells a JOIN c{i} c USING (pos) GROUP BY r, k),
n{i} AS MATERIALIZED (SELECT r, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if i < rounds:
            out.append(rf"""s{i} AS (SELECT k, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM n{i} JOIN cells USING (r) GROUP BY k, pos),
c{i + 1} AS MATERIALIZED (SELECT k, pos, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{i} LEFT JOIN s{i} USING (k, pos))""")
    return ",\n".join(out) + rf""",
named AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS h FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM n{rounds} JOIN told USING (r) JOIN named USING (k)"""


def oracle_sql() -> dict[str, str]:
    from gridweave.llm import licenses
    from gridweave.llm.quality import STOP_WORDS

    notices = ", ".join("({}, '{}', '{}')".format(i, x[0], x[1].replace("'", "''")) for i, x in enumerate(licenses.TEMPLATES))
    any_of = lambda words, given: f"list_has_any({words}, {given})"  # noqa: E731
    marked = lambda words, needs, bars: [any_of(words, g) for g in needs] + ([f"NOT {any_of(words, bars)}"] if bars else [])  # noqa: E731
    open_to = " ".join(f"WHEN {i} THEN " + (" AND ".join(marked("words", c[0], c[1]) + marked("held", c[2], c[3])) or "true") for i, c in enumerate(licenses.conditions()))
    stop = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))
    return {
        "op13_centroids": _rounds_sql(40, 5, 64),
        "op11_hard_negatives": r"""
WITH told AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
  FROM told a JOIN told b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
pos AS (SELECT a, anchor_id, other_id AS positive_id, s AS positive_score, row_number() OVER (PARTITION BY a ORDER BY s DESC, other_id) AS p FROM scored WHERE same QUALIFY p <= 5),
neg AS (SELECT a, anchor_id, positive_id, p, positive_score, other_id AS negative_id, s AS negative_score, row_number() OVER (PARTITION BY a, p ORDER BY s DESC, other_id) AS k
  FROM pos JOIN (SELECT a, other_id, s FROM scored WHERE NOT same) USING (a) WHERE 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score QUALIFY k <= 10)
SELECT anchor_id, positive_id, CAST(k AS INT) AS rank, negative_id, positive_score, negative_score FROM neg
""",
        "op1_mix_sources": r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM src),
weighted AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0e0 AS cap FROM ranked),
ordered AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before FROM weighted
  WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tot AS (SELECT CAST(sum(source_size) AS DOUBLE) AS total, sum(weight) AS all_weight FROM weighted),
tried AS (SELECT cap_before, weight_before, total - cap_before AS rest, all_weight - weight_before AS weight_left, cap / weight AS ratio FROM ordered, tot),
chosen AS (SELECT rest, weight_left FROM tried WHERE ratio >= rest / weight_left ORDER BY cap_before, weight_before LIMIT 1),
targets AS (SELECT rank, source, source_size, weight, least(cap, weight * rest / weight_left) AS target FROM weighted, chosen),
keyed AS (SELECT doc_id, size, source_size, target, weight, rank, md5('mix/' || CAST(doc_id AS VARCHAR)) AS k
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
ahead AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 1 END AS whole FROM keyed),
counted AS (SELECT *, whole + CASE WHEN 2 * before + size <= 2 * (target - whole * source_size) AND target - whole * source_size > 0 AND size > 0 THEN 1 ELSE 0 END AS repeats FROM ahead)
SELECT doc_id, size, source_size, target, CAST(size * repeats AS BIGINT) AS taken, CAST(repeats AS BIGINT) AS repeats, weight FROM counted
""",
        "op7_license_scan": rf"""
WITH docs AS (SELECT doc_id, coalesce(source, 'unknown') AS source, text, '(?i)^(released|(this work is )?licensed) under [^.]*([.][0-9]+)*[.]?$' AS notice FROM documents),
rows AS (SELECT doc_id, text, concat_ws('/', source, CAST(doc_id // 100 AS VARCHAR), CASE WHEN coalesce(regexp_matches(string_split(text, chr(10))[1], notice)
  OR regexp_matches(string_split(text, chr(10))[-1], notice), false) THEN 'LICENSE' ELSE CAST(doc_id AS VARCHAR) || '.txt' END) AS path FROM docs),
shape AS (SELECT template, license, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) AS token FROM (VALUES {notices}) AS t(template, license, notice)),
seen AS (SELECT doc_id, path, text, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS words FROM rows),
total AS (SELECT count(DISTINCT license) AS n FROM shape),
weights AS (SELECT token, any_value(ln((n + 1.0e0) / (df + 1.0e0)) + 1) AS idf FROM (SELECT token, count(DISTINCT license) AS df FROM shape GROUP BY token), total GROUP BY token),
shaped AS (SELECT template, license, token, count(*) * any_value(idf) AS w FROM shape JOIN weights USING (token) GROUP BY ALL),
normed AS (SELECT template, license, token, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS t_weight FROM shaped),
holders AS (SELECT DISTINCT doc_id, path, text, words AS held FROM seen WHERE len(words) > 0),
cut AS (SELECT doc_id, path, string_split(regexp_replace(text, '([.;:!?])[ 	

]', '' || chr(10), 'g'), chr(10)) AS parts FROM holders),
placed AS (SELECT doc_id, path, unnest(range(len(parts))) AS place, unnest(parts) AS passage FROM cut),
full_texts AS (SELECT doc_id, path, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM holders),
sizes AS (SELECT k - 1 AS k, ({list(licenses.WINDOWS)})[k] AS size FROM range(1, {len(licenses.WINDOWS) + 1}) AS r(k)),
windows AS (SELECT doc_id, path, words, k, size, unnest(range(0, (len(words) - size + size // 2 - 1) // (size // 2) + 1)) AS i FROM full_texts, sizes WHERE len(words) > size),
told AS (SELECT doc_id, path, place, regexp_extract_all(lower(passage), '[a-z0-9]+') AS words FROM placed UNION ALL SELECT doc_id, path, -1, words FROM full_texts
  UNION ALL SELECT doc_id, path, -2 - i * {len(licenses.WINDOWS)} - k, words[i * (size // 2) + 1 : i * (size // 2) + size] FROM windows),
counted AS (SELECT doc_id, path, place, token, count(*) * coalesce(any_value(idf), any_value(ln(n + 1.0e0) + 1)) AS w
  FROM (SELECT doc_id, path, place, unnest(words) AS token FROM told) LEFT JOIN weights USING (token), total GROUP BY doc_id, path, place, token),
p AS (SELECT doc_id, path, place, sqrt(sum(w * w)) AS p_norm FROM counted GROUP BY ALL),
dots AS (SELECT doc_id, path, place, template, license, sum(w * t_weight) AS dot FROM counted JOIN normed USING (token) GROUP BY ALL),
scored AS (SELECT doc_id, path, license, round(dot / p_norm, 6) AS s FROM dots JOIN p USING (doc_id, path, place) JOIN told USING (doc_id, path, place)
  JOIN holders USING (doc_id, path) WHERE CASE template {open_to} END AND round(dot / p_norm, 6) >= {licenses.THRESHOLD}e0),
best AS (SELECT doc_id, path, license AS own, s AS own_s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY s DESC, license) AS k FROM scored) WHERE k = 1),
known AS (SELECT r.doc_id, r.path, own, own_s, string_split(r.path, '/') AS parts FROM rows r LEFT JOIN best b ON b.doc_id = r.doc_id AND b.path = r.path),
grants AS (SELECT folder, own AS license, own_s AS s FROM (SELECT array_to_string(parts[1:len(parts) - 1], '/') AS folder, own, own_s,
  row_number() OVER (PARTITION BY array_to_string(parts[1:len(parts) - 1], '/') ORDER BY own_s DESC, own) AS k FROM known WHERE own IS NOT NULL AND parts[-1] = 'LICENSE') WHERE k = 1),
asks AS (SELECT doc_id, path, d, array_to_string(parts[1:d], '/') AS folder FROM (SELECT DISTINCT doc_id, path, parts, unnest(range(0, len(parts))) AS d FROM known WHERE own IS NULL)),
heirs AS (SELECT doc_id, path, folder, license, s FROM (SELECT a.doc_id, a.path, a.folder, g.license, g.s, row_number() OVER (PARTITION BY a.doc_id, a.path ORDER BY d DESC) AS k FROM asks a JOIN grants g USING (folder)) WHERE k = 1)
SELECT k.doc_id, k.path, coalesce(own, h.license) AS license, coalesce(own_s, h.s, 0.0e0) AS similarity, CASE WHEN own IS NOT NULL THEN 'own' WHEN h.folder IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
  CASE WHEN own IS NULL THEN h.folder END AS license_path FROM known k LEFT JOIN heirs h ON h.doc_id = k.doc_id AND h.path = k.path
""",
        "op9_near_vectors": """
WITH RECURSIVE good AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (SELECT r, vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM good),
links AS (SELECT a.r AS r, b.r AS s, a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.r <> b.r AND len(a.v) = len(b.v)
  AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95e0),
reach AS (SELECT DISTINCT a AS x, b AS y FROM links UNION SELECT reach.x, l.b FROM reach JOIN links l ON reach.y = l.a),
comp AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x),
n AS (SELECT r, count(*) AS k FROM links GROUP BY r)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM good LEFT JOIN n USING (r) LEFT JOIN comp ON x = vec_id
UNION ALL SELECT vec_id, 0, vec_id, vec_id IS NOT NULL FROM embeddings WHERE vec_id IS NULL OR embedding IS NULL OR len(embedding) = 0
  OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0
""",
        "op2_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT r, doc_id, array_to_string(words[i:i+4], ' ') AS k FROM (SELECT r, doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0 AND doc_id IS NOT NULL)),
n AS (SELECT r, doc_id, count(*) AS size FROM g GROUP BY ALL),
shared AS (SELECT a.r AS r, b.r AS s, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.r <> b.r GROUP BY ALL),
links AS (SELECT x.r, x.s, a.doc_id AS a, b.doc_id AS b, a.size = c AND b.size = c AS same FROM shared x JOIN n a ON a.r = x.r JOIN n b ON b.r = x.s
  WHERE c >= 0.8e0 * (a.size + b.size - c) - 1e-6),
reach AS (SELECT DISTINCT r AS x, s AS y FROM links UNION SELECT reach.x, l.s FROM reach JOIN links l ON reach.y = l.r),
comp AS (SELECT x, min(doc_id) AS c FROM reach JOIN w ON w.r = y GROUP BY x),
m AS (SELECT r, count(*) AS k, min(CASE WHEN same THEN b END) AS copy FROM links GROUP BY r)
SELECT doc_id, least(doc_id, coalesce(copy, doc_id)) AS copy_of, CAST(coalesce(k, 0) AS BIGINT) AS n_links, least(doc_id, coalesce(c, doc_id)) AS class_id,
  coalesce(doc_id = least(doc_id, coalesce(c, doc_id)), true) AS kept FROM w LEFT JOIN m ON m.r = w.r LEFT JOIN comp ON comp.x = w.r
""",
        "op6_quality_rules": rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM base WHERE len(words) >= 5),
keyed AS (SELECT doc_id, i, concat_ws(' ', words[i], words[i+1], words[i+2], words[i+3], words[i+4]) AS k FROM wins),
twins AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
gaps AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS g FROM twins),
rep AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS n FROM gaps GROUP BY doc_id),
m AS (SELECT b.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  len(lines) AS n_lines, coalesce(r.n, 0) AS n_repeat_words, len(list_filter(words, lambda x: x IN ({stop}))) AS n_stop
  FROM base b LEFT JOIN rep r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(n_symbols / CAST(n_words AS DOUBLE), 0) <= 0.1e0 AND word_chars / CAST(n_words AS DOUBLE) >= 2e0
  AND word_chars / CAST(n_words AS DOUBLE) <= 14e0 AND (n_words < 30 OR n_stop / CAST(n_words AS DOUBLE) >= 0.05e0) AND coalesce(n_dup_lines / CAST(n_lines AS DOUBLE), 0) <= 0.5e0 AS kept FROM f
""",
    }
