"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, as a whole. Byte-level tokens cover the text's bytes without gap, so the running sum of
their lengths gives every token's span; an interval join of these sorted spans with the sorted spans of sections counts
tokens by section. A token that lies in several sections is allocated by one of the rules

- first: to the first of them;
- last: to the last of them;
- most: to that with most of its characters, of equals to the first.

A character belongs to a token if any of its bytes does. Without given spans, sections are lines, each with its line
break, so that they cover the text and their counts add up to the document's.

Defined results. A null or empty text has no tokens and, as lines, one empty section. Given spans have to ascend without
overlap; tokens in none of them are counted as `outside`; a null or empty list has no sections, and empty spans count no
tokens. Very long texts are encoded whole. Repeated rows give repeated results, an empty table an empty one. Other columns are
carried along, but for those named as the result's own: these give way.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm.common import add_columns, table

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("first", "last", "most")
STEP_BYTES = 1 << 20
COUNTS = "struct<n_tokens: bigint, outside: bigint, starts: array<bigint>, ends: array<bigint>, tokens: array<bigint>>"
_COUNTS_TYPE = pa.struct(
    [("n_tokens", pa.int64()), ("outside", pa.int64()), *((k, pa.list_(pa.int64())) for k in ("starts", "ends", "tokens"))]
)


@functools.lru_cache(maxsize=1)
def _encoding(vocabulary: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer, and the number of bytes of each token."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        sizes[k] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def line_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of lines, each up to and with its line break."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    if not len(ends) or ends[-1] < len(raw):
        ends = np.append(ends, len(raw))
    return np.concatenate(([0], ends[:-1])), ends


def allocate(
    token_starts: np.ndarray, token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str
) -> tuple[np.ndarray, int]:
    """Tokens of each section, and those of none. All spans ascend, count characters, and those of sections do not overlap."""
    counts = np.zeros(len(starts), np.int64)
    if not len(starts) or not len(token_starts):
        return counts, len(token_starts)
    real = np.flatnonzero(ends > starts)
    if not len(real):
        return counts, len(token_starts)
    starts, ends = starts[real], ends[real]
    first = np.searchsorted(ends, token_starts, "right")  # the first section that ends behind the token's start
    last = np.searchsorted(starts, token_ends, "left") - 1  # the last that starts before its end
    chosen = last.copy() if rule == "last" else first.copy()
    if rule == "most":
        for k in np.flatnonzero(last > first):
            these = np.arange(first[k], last[k] + 1)
            shares = np.minimum(ends[these], token_ends[k]) - np.maximum(starts[these], token_starts[k])
            chosen[k] = these[shares.argmax()]
    inside = first <= last
    counts[real] = np.bincount(chosen[inside], minlength=len(real))
    return counts, int((~inside).sum())


def count_text(text: str | None, spans: list[tuple[int, int]] | None, rule: str, encoding: tiktoken.Encoding, sizes: np.ndarray) -> dict:
    raw = (text or "").encode()
    ids = encoding.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
    byte_ends = np.cumsum(sizes[ids])
    byte_starts = byte_ends - sizes[ids]
    begins = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) if raw else np.zeros(0, np.int64)  # characters begun up to each byte
    before = np.concatenate((begins - 1, [begins[-1] if len(raw) else 0]))  # which character each byte is in
    token_starts = before[byte_starts]
    token_ends = before[byte_ends - 1] + 1 if len(ids) else byte_ends
    if spans is None:
        starts, ends = (before[x] for x in line_spans(raw))
    else:
        starts, ends = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
        if (ends < starts).any() or (starts[1:] < ends[:-1]).any():
            raise ValueError("sections have to ascend without overlap")
    tokens, outside = allocate(token_starts, token_ends, starts, ends, rule)
    return {"n_tokens": len(ids), "outside": outside, "starts": starts, "ends": ends, "tokens": tokens}


def count_tokens(
    documents: DataFrame, vocabulary: str, pattern: str, *, text: str = "text", spans: str | None = None,
    rule: str = "most", into: str = "counts",
) -> DataFrame:
    """Adds a struct column: the text's tokens, those outside all sections, and each section's span and tokens.

    spans: a column of arrays of (start, end) in characters, or nothing for lines. The vocabulary file, of a fixed size,
    goes along with the function.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {', '.join(RULES)}")
    data = Path(vocabulary).read_bytes()
    fed, source = documents, text
    if spans is not None:  # text and spans together make one visit to Python
        source = "__text_and_spans"
        fed = documents.withColumn(source, F.struct(F.col(text).alias("t"), F.col(spans).alias("s")))

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        encoding, sizes = _encoding(data, pattern)

        def count(values: pa.Array) -> list[pa.Array]:
            rows = values.to_pylist()
            if spans is None:
                found = [count_text(t, None, rule, encoding, sizes) for t in rows]
            else:
                found = [count_text(r["t"], [tuple(s.values())[:2] for s in r["s"] or ()], rule, encoding, sizes) for r in rows]
            return [pa.array(found, _COUNTS_TYPE)]

        return count

    counted = add_columns(fed, source, f"`{into}` {COUNTS}", make, STEP_BYTES)
    return counted if spans is None else counted.drop(source)


def sections(counted: DataFrame, *, into: str = "counts") -> DataFrame:
    """A row for each section, with its number, span and tokens, beside the document's other columns."""
    zipped = F.arrays_zip(F.col(f"{into}.starts").alias("start"), F.col(f"{into}.ends").alias("end"), F.col(f"{into}.tokens").alias("n_tokens"))
    others = [c for c in counted.columns if c not in (into, "section", "start", "end", "n_tokens", "document_tokens")]
    rows = counted.select(*others, F.col(f"{into}.n_tokens").alias("document_tokens"), F.posexplode(zipped).alias("section", "span"))
    return rows.select(*others, F.col("section").cast("long").alias("section"), "span.start", "span.end", "span.n_tokens", "document_tokens")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each line of each document."""
    import public_tokenizers

    documents = table(spark, folder, "documents").select("doc_id", "text")
    counted = count_tokens(documents, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return sections(counted.drop("text"))
