"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A vocabulary file for the ``tokenizers`` library; pass another path to use another one.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how a byte-level vocabulary parts a text before it merges within the parts.
BYTE_LEVEL_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Sizes of parts that a worker remembers, and characters up to which a part is remembered.
REMEMBERED, SHORT = 1_000_000, 64


def counter(vocabulary: str) -> Callable[[str], int]:
    """A function from a text to its number of tokens, for the JSON of a vocabulary.

    Byte-level vocabularies never merge across parts of a text, so the size of a text is the sum over its
    parts, and the size of a part, of which a language has few, is worked out once.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    whole = lambda text: len(tokenizer.encode(text, add_special_tokens=False))
    settings = json.loads(vocabulary)
    parts = settings.get("pre_tokenizer") or {}
    plain = parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space")
    if not plain or settings.get("normalizer"):
        return whole
    import regex

    class Sizes(dict):
        def __missing__(self, part: str) -> int:
            size = whole(part)
            if len(part) <= SHORT:
                if len(self) >= REMEMBERED:
                    self.clear()
                self[part] = size
            return size

    split, sizes = regex.compile(BYTE_LEVEL_PARTS).findall, Sizes()
    return lambda text: sum(map(sizes.__getitem__, split(text)))


def token_counts(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Number of tokens of the whole text; null for a null text, 0 for an empty one.

    Special tokens are neither added nor recognised. The vocabulary is read here and sent along with the
    function, so executors need no copy of the file; texts pass in Arrow batches.
    """
    content = Path(vocabulary).read_text(encoding="utf-8")

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        size = counter(content)
        for texts in batches:
            yield pd.Series([size(t) for t in texts], dtype="int32")

    return F.when(text.isNotNull(), count(F.coalesce(text, F.lit(""))))
