"""Token counts by public tokenizers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A rank file, a tokenizers .json or a sentencepiece .model that every executor can read.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def pieces(text: str, most: int = 50_000) -> list[str]:
    """The text in parts of at most ``most`` characters, cut before white space where there is any in the part's second half."""
    out, at = [], 0
    while len(text) - at > most:
        end = at + most
        gap = max(text.rfind(c, at + most // 2, end) for c in " \n\t")
        out.append(text[at : gap if gap > at else end])
        at += len(out[-1])
    return [*out, text[at:]]


def token_counter(path: str = TOKENIZER, pattern: str | None = None) -> Callable[[str], int]:
    """A function that counts a text's tokens. ``path``: a .tiktoken rank file, a tokenizers .json or a sentencepiece .model.

    Very long texts are counted whole, but in pieces: tokenizers fail on runs of a million blanks.
    """
    one = _tokenizer(path, pattern)
    return lambda text: sum(map(one, pieces(text)))


def _tokenizer(path: str, pattern: str | None) -> Callable[[str], int]:
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda x: len(t.encode(x, add_special_tokens=False).ids)
    if path.endswith(".model"):
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda x: len(s.encode(x))
    import base64

    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda x: len(e.encode_ordinary(x))


def token_length(c: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text column; null stays null. Tokenizers are native code, so this runs on Arrow batches."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        n = token_counter(path)
        return s.map(n, na_action="ignore").astype("Int64")

    return count(c)
