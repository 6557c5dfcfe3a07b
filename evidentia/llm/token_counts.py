"""Token counts of sections, from one encoding of the whole document.

A document is encoded once with a byte-level BPE. Each token's byte span follows from the
lengths of the tokens; sections are character intervals. An interval join of the two
counts a section's tokens, and a rule says where a token across a boundary goes:

start         to the section that holds its first byte
end           to the section that holds its last byte
proportional  to each section by the share of its bytes
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.llm.common import table

VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "proportional")


def _encoder(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(k) for k in ranks]
    return tiktoken.Encoding("bytes", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), lengths


def upto(ends: np.ndarray, at: np.ndarray, rule: str) -> np.ndarray:
    """Tokens, or their share, that count as before each byte offset; ends: the tokens' ends in bytes."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    if rule == "start":
        return np.searchsorted(starts, at, "left").astype(float)
    if rule == "end":
        return np.searchsorted(ends, at, "right").astype(float)
    return np.interp(at, np.concatenate([[0], ends]), np.arange(len(ends) + 1))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "start",
                 vocabulary_file: str = VOCABULARY_FILE) -> DataFrame:
    """One row per section: key, section (from 0), start, end (code points), n_tokens, crossing, doc_tokens.

    sections names a column array<struct<start:int,end:int>>; without it every line with its line feed
    is one. Sections may overlap or leave gaps; each is counted by itself, and where they tile the text
    the counts add up to doc_tokens. Bounds outside the text are clipped. crossing is the number of tokens with bytes on both
    sides of the section's end. Null and empty texts give one empty section; a null or empty section list
    gives no row. Repeated rows give repeated rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()
    columns = [F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")] + ([F.col(sections).alias("cuts")] if sections else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, lengths = _encoder(data.value)
        for x in batches:
            parts = []
            for n, (k, t) in enumerate(zip(x["key"], x["text"], strict=True)):
                raw = np.frombuffer(t.encode(), np.uint8)
                chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte offset of each code point
                ends = np.cumsum(lengths[np.array(encoding.encode_ordinary(t), np.int64)])
                if sections:
                    cuts = x["cuts"].iloc[n]
                    if cuts is None or len(cuts) == 0:
                        continue
                    lo, hi = (np.clip([c[f] for c in cuts], 0, len(chars) - 1) for f in ("start", "end"))
                    hi = np.maximum(lo, hi)
                else:
                    hi = np.flatnonzero(raw[chars[:-1]] == 10) + 1
                    hi = hi if len(hi) and hi[-1] == len(chars) - 1 else np.append(hi, len(chars) - 1)
                    lo = np.append(0, hi[:-1])
                a, b = chars[lo], chars[hi]
                after = np.searchsorted(ends, b, "left")
                within = (b > 0) & (b < len(raw))
                crossing = within & (ends[np.minimum(after, max(0, len(ends) - 1))] != b if len(ends) else within)
                parts.append(pd.DataFrame({"key": k, "section": np.arange(len(lo)), "start": lo, "end": hi, "n_tokens": upto(ends, b, rule) - upto(ends, a, rule),
                                           "crossing": crossing.astype(int), "doc_tokens": len(ends)}))
            if parts:
                yield pd.concat(parts)

    got = docs.select(*columns).mapInPandas(run, f"key {kind}, section int, start int, end int, n_tokens double, crossing int, doc_tokens long")
    got = got.withColumnRenamed("key", key)
    return got if rule == "proportional" else got.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token across a line's end counts where it starts."""
    return token_counts(table(spark, sf_dir, "documents"))
