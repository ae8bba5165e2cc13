"""Text normalisation shared by the text operators."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = re.compile(r"</?[A-Za-z][^<>]*>")
#: Only the marks of a comment are dropped; a passage may stand between them.
COMMENT_MARK = re.compile(r"<!--|-->")
#: Zero-width marks and joiners, word joiner and invisible operators, direction marks, byte-order mark, soft hyphen.
INVISIBLE = re.compile("[​-‏⁠-⁤‪-‮⁦-⁩﻿­᠎]")
WORD = re.compile(r"[^\W_]+")


def hash60(key: Column | str, seed: int) -> Column:
    """60 bits of md5(key#seed), the same in any engine: a random order, and a random number below any bound by remainder."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def visible(text: str) -> str:
    """The text without markup tags, marks of comments and invisible characters."""
    if "<" in text or "-->" in text:
        text = TAG.sub("", COMMENT_MARK.sub("", text))
    return text if text.isascii() else INVISIBLE.sub("", text)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, after tags and invisible characters are dropped."""
    return WORD.findall(visible(text).lower()) if text else []


def plain(text: str) -> str:
    """Compatibility form without accents, for matching across spellings."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
