"""Splitting of texts before byte-level BPE, as public_tokenizers.PATTERN does it."""

from __future__ import annotations

import re

import public_tokenizers
import regex

#: Characters on which the two engines' classes agree: ASCII but the separators 0x1C-0x1F, Latin letters, common punctuation.
_PLAIN = "\\x00-\\x1b\\x20-\\x7f\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f\\u2010-\\u2027\\u20ac"
_odd = re.compile(f"[^{_PLAIN}]").search
_slow = regex.compile(public_tokenizers.PATTERN).findall
#: The same pattern for the faster engine: letters are word characters but digits and the low line.
_fast = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


def pretokens(text: str) -> list[str]:
    """The matches of PATTERN, in order; together they are the whole text."""
    return _slow(text) if _odd(text) else _fast(text)
