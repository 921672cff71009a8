"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text of any length is cut only where the split pattern must end a match whatever stands around it: between a
character that is no white space and a following blank or line feed, and between a letter or digit and a following
full-width sign of punctuation, for scripts that are written without blanks.  No match of the pattern holds a blank after
another character or a sign after a letter, and its look-ahead only looks to the right, so encoding the parts one by one
gives the ids of the whole text.  What is left whole is a run of letters without any sign, which is one match anyway.
Decoding concatenates raw token bytes and never goes through text, so ids that end inside a character are kept.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; repeated rows are encoded
each; columns other than the two named are ignored, so that clashing names do no harm.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import in_arrow, slices

#: Characters after which a long text is cut at the next safe boundary.
CHUNK = 1 << 18
# Letters that every version of Unicode has as such: ASCII and its digits, kana, the common ideographs, Hangul syllables.
_SAFE = re.compile(r"(?<=\S)(?=[ \n])|(?<=[0-9A-Za-z\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3])(?=[\u3001\u3002\uFF01\uFF08\uFF09\uFF0C\uFF0E\uFF1A\uFF1B\uFF1F])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; made once in each Python worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """The text cut at safe boundaries, each part of at least `chunk` characters but the last."""
    at = 0
    while len(text) - at > chunk and (cut := _SAFE.search(text, at + chunk)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(text: str, enc: tiktoken.Encoding, chunk: int = CHUNK) -> np.ndarray:
    """The ids of one text, as uint32."""
    ids = [enc.encode_to_numpy(part, disallowed_special=()) for part in parts(text, chunk) if part]
    return ids[0] if len(ids) == 1 else np.concatenate([np.zeros(0, np.uint32), *ids])


def _run(rank_file: str, pattern: str, text_col: str, decoded: bool):
    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in slices(batches, text_col):
            lengths, ids, raw = [0], [np.zeros(0, np.int32)], []
            for text in batch.column(text_col).to_pylist():
                own = encode_text(text or "", enc)
                lengths.append(len(own))
                ids.append(own.astype(np.int32))
                if decoded:
                    raw.append(enc.decode_bytes(own.tolist()))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(np.concatenate(ids)))
            made = [pa.array(lengths[1:], pa.int64()), lists, *([pa.array(raw, pa.binary())] if decoded else [])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], [batch.schema.names[0], "n_tokens", "ids", *(["decoded"] if decoded else [])])

    return run


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, n_tokens long, ids array<int>) of every text; with `decoded` the bytes of the ids too, in the same pass."""
    shape = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids array<int>" + ", decoded binary" * decoded
    return docs.select(id_col, text_col).transform(in_arrow, _run(rank_file, pattern, text_col, decoded), shape)


def decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, decoded binary): the raw bytes of a table of ids."""

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in slices(batches, "ids"):
            raw = [enc.decode_bytes(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(raw, pa.binary())], [id_col, "decoded"])

    shape = f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, decoded binary"
    return encoded.select(id_col, "ids").transform(in_arrow, run, shape)
