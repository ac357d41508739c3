"""Small helpers for a query string, which is one value on the driver."""

from __future__ import annotations

import re
import unicodedata

import regex


def query_tokens(query: str) -> list[str]:
    """Index tokens of a search query, by the rules of ``text.tokens``."""
    text = unicodedata.normalize("NFKC", query).lower()
    out = dict.fromkeys(re.findall("[a-z0-9][a-z0-9_+.-]{1,63}", text))
    for run in regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+", text):
        out |= dict.fromkeys(run[i : i + n] for n in (1, 2, 3) for i in range(len(run) - n + 1))
    return list(out)
