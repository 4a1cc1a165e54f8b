"""Byte-level BPE encoding and decoding with a local rank file.

Texts are cut where the splitting pattern is sure to end a match, so that no
call of the tokenizer ever sees more than a bounded stretch, and each stretch
is encoded by tiktoken. Ids decode to raw bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.workspace import ship

#: A stretch given to the tokenizer has about this many characters, unless no safe cut is near.
STRETCH = 20_000
#: A match always ends between a mark that isn't white and a white one; failing that, between
#: a letter and a digit or mark, or a digit and any other kind.
_WHITE_CUT = regex.compile(r"(?<=\S)(?=\s)")
_KIND_CUT = regex.compile(r"(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """``text`` cut at safe places after every ``size`` characters or so."""
    out, i, n = [], 0, len(text)
    while n - i > size:
        m = _WHITE_CUT.search(text, i + size, min(n, i + 2 * size)) or _KIND_CUT.search(text, i + size, min(n, i + 2 * size)) or _WHITE_CUT.search(text, i + size) or _KIND_CUT.search(text, i + size)
        if m is None:
            break
        out.append(text[i : m.start()])
        i = m.start()
    out.append(text[i:])
    return out


def encode_text(text: str | None, enc) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit integers; null and empty texts have none."""
    if not text:
        return np.zeros(0, "<u4")
    parts = [enc.encode_to_numpy(s, disallowed_special=()) for s in stretches(text)]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u4", copy=False)


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode the ids again.

    Returns the id, ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and
    ``decoded`` (binary). Null texts count as empty and give no ids. Each row is by itself: repeated
    rows give repeated results, an empty table an empty one, other columns are not read.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoding(rank_path, pattern)
        for batch in batches:
            ids, counts, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                x = encode_text(text, enc)
                ids.append(x.tobytes())
                counts.append(len(x))
                decoded.append(enc.decode_bytes(x.tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {id_type}, ids binary, n_tokens long, decoded binary")


def digests(docs: DataFrame, rank_path: str, pattern: str, **columns) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded bytes, as lower-case hex."""
    out = encode(docs, rank_path, pattern, **columns)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
