"""Token counts of texts under a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Folder of the tokenizer files (a parameter; nothing is copied from it).
TOKENIZERS = os.environ.get("COVERLINE_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the splitting pattern published with byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_ENCODERS: dict = {}


def encoder(folder: str, name: str):
    """The tokenizer of a file, built once per Python worker."""
    key = (folder, name)
    if key not in _ENCODERS:
        import tiktoken

        with open(f"{folder}/{name}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


#: Texts are cut before encoding where the pattern always cuts, so that memory stays bounded for any length.
_PIECE = 20_000


def count_tokens(text: str | None, enc) -> int:
    """Number of tokens of a whole text; null and empty have none."""
    if not text:
        return 0
    if len(text) <= _PIECE:
        return len(enc.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        while at + 1 < end < len(text) and not (text[end] == "\n" and text[end - 1].isalnum()):
            end -= 1
        if end <= at + 1:
            end = text.find("\n", at + _PIECE)
            end = len(text) if end < 0 else end
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = RANKS, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, …extra) of every document that has an id; one narrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, name)
        for pdf in batches:
            yield pdf.drop(columns="text").assign(n_tokens=[count_tokens(t, enc) for t in pdf["text"]])

    narrow = documents.where("doc_id is not null").select("doc_id", *extra, "text")
    kinds = dict(narrow.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ("doc_id", *extra)] + ["n_tokens long"])
    return narrow.mapInPandas(run, schema)
