"""Token counts of whole documents, with overlap resynchronisation for huge ones.

A document of up to ``chunk`` characters is encoded in one go. A longer one is encoded in chunks that overlap. Two
neighbouring chunks are spliced at a common boundary that is proven stable:

* it is the start of a pre-token in both chunks, at least ``MARGIN`` characters from the end of the first and from the
  start of the second (no added token's text is that long, and only a chunk's last pre-token can be cut short);
* the character there does not compose with the one before it, so normalisation is the same on either side.

The pre-tokenizer scans from left to right and its pattern looks neither back nor ahead, so from a common match start
on, both chunks are split as the whole text is. The first chunk is right up to there by induction. If the overlap has no
such boundary (one word longer than it, say), it is doubled until there is one or the text ends.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text become their token, as is the
library's default; repeated rows are counted each; empty tables give an empty result.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.encoding import WordEncoder

CHUNK = 32_768
OVERLAP = 512
MARGIN = 64
LIMIT = 2048


def _encode(tokenizer, text: str, start: int, end: int):
    """Token ids, their start offsets in the whole text, and the start offsets of pre-tokens, of one chunk."""
    e = tokenizer.encode(text[start:end], add_special_tokens=False)
    starts = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids)) + start
    word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    first = np.ones(len(word), bool)
    first[1:] = (word[1:] != word[:-1]) | (word[1:] == -1)
    return np.array(e.ids, np.uint32), starts, starts[first]


def _stable(text: str, at: int) -> bool:
    pair, here = text[at - 1 : at + 1], text[at]
    return unicodedata.combining(here) == 0 and unicodedata.normalize("NFC", pair) == unicodedata.normalize("NFC", pair[0]) + unicodedata.normalize("NFC", here)


def spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN):
    """The token ids of a whole text, as arrays in order."""
    begin, end, since = 0, min(len(text), chunk + overlap), 0
    ids, starts, edges = _encode(tokenizer, text, begin, end)
    wide = overlap
    while end < len(text):
        at = max(end - wide, begin + 1)
        until = min(len(text), at + chunk + overlap)
        more = _encode(tokenizer, text, at, until)
        common = np.intersect1d(edges, more[2])
        common = common[(common > since) & (common >= at + margin) & (common <= end - margin)]
        splice = next((int(p) for p in common[::-1] if _stable(text, int(p))), None)
        if splice is None:  # widen the overlap: the first chunk now reaches further
            end, wide = min(len(text), end + wide), 2 * wide
            ids, starts, edges = _encode(tokenizer, text, begin, end)
            continue
        yield ids[(starts >= since) & (starts < splice)]
        begin, end, since, wide = at, until, splice, overlap
        ids, starts, edges = more
    yield ids[starts >= since]


def counts(encoder: WordEncoder, texts: list[str | None], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The number of tokens of each text."""
    short = [t if t and len(t) <= chunk else None for t in texts]
    found = [sum(map(len, pieces)) // encoder.dtype.itemsize for _, pieces in encoder.encode(short)]
    return [sum(map(len, spliced(encoder.tokenizer, t, chunk, overlap))) if t and len(t) > chunk else n for t, n in zip(texts, found, strict=True)]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens), a row for each row of ``docs``."""
    source = docs.select("doc_id", "text")
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        encoder = WordEncoder.of(tokenizer_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n_bytes = pa.array([len(t.encode("utf-8")) if t else 0 for t in texts], pa.int64())
            n_tokens = pa.array(counts(encoder, texts, chunk, overlap), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
