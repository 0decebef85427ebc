"""Encoding of texts with a public byte-level BPE vocabulary, and decoding of ids to bytes."""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.arrow import batch_of, lists_of, map_arrow

#: The pattern that the published vocabularies split texts with before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where no token can reach across: before white space that follows another character, and between a letter or
#: digit and a symbol. Each alternative of the pattern reads forward only, so cutting there changes no token.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])")

_built: dict[str, tiktoken.Encoding] = {}


def default_rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The rank file among the installed public vocabularies; LOOMERY_TOKENIZERS names another folder."""
    folder = os.environ.get("LOOMERY_TOKENIZERS")
    if folder is None:
        try:
            import public_tokenizers

            folder = os.path.dirname(public_tokenizers.__file__)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


def build_encoding(ranks: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoder of a rank file's content; built once in a process."""
    key = hashlib.sha1(ranks + pattern.encode()).hexdigest()
    if key not in _built:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        _built[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _built[key]


def safe_parts(text: str, most: int) -> list[str]:
    """Cut a text into parts of about ``most`` characters at safe boundaries; a part without one stays longer."""
    parts, start = [], 0
    while len(text) - start > most:
        found = SAFE.search(text, start + most)
        if not found:
            break
        parts.append(text[start : found.start()])
        start = found.start()
    return [*parts, text[start:]]


def encode_text(encoding: tiktoken.Encoding, text: str | None, most: int = 100_000) -> list[int]:
    """Ids of a text without special tokens (their strings are ordinary text); none for null and empty."""
    if not text:
        return []
    if len(text) <= most:
        return encoding.encode_ordinary(text)
    return [i for part in safe_parts(text, most) for i in encoding.encode_ordinary(part)]


def encode_corpus(rows: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str | None = None, pattern: str = PATTERN, most: int = 100_000) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row, narrow: no shuffle, columns other than the two are not read.

    Null and empty texts give an empty list; blank texts are encoded as they stand. Texts of any length are encoded
    whole, long ones part by part between safe boundaries. Repeated keys give repeated rows. The rank file is read on
    the driver and sent once to each executor (its size is that of the vocabulary, under 1 MB, whatever the corpus).
    """
    with open(rank_file or default_rank_file(), "rb") as file:
        ranks = rows.sparkSession.sparkContext.broadcast(file.read())
    kind = rows.schema[key].dataType.simpleString()

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding = build_encoding(ranks.value, pattern)
        ids = [np.array(encode_text(encoding, t.as_py(), most), np.int32) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), lists_of(ids, pa.int32())], names=[key, "ids"])

    return map_arrow(rows.select(F.col(key).alias(key), F.col(text).alias("_text")), encode, f"`{key}` {kind}, ids array<int>")


def decode_corpus(rows: DataFrame, key: str = "doc_id", ids: str = "ids", rank_file: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``key`` and ``bytes`` of every row of ids, as raw bytes: ids may end inside a character. Null ids give null."""
    with open(rank_file or default_rank_file(), "rb") as file:
        ranks = rows.sparkSession.sparkContext.broadcast(file.read())
    kind = rows.schema[key].dataType.simpleString()

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding = build_encoding(ranks.value, pattern)
        out = [None if v.as_py() is None else encoding.decode_bytes(v.as_py()) for v in batch.column(1)]
        return batch_of(**{key: (batch.column(0), None), "bytes": (out, pa.binary())})

    return map_arrow(rows.select(F.col(key).alias(key), F.col(ids).alias("_ids")), decode, f"`{key}` {kind}, bytes binary")
