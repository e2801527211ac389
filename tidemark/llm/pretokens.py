"""Splitting texts into pre-tokens, and numbering the distinct ones of a task."""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import regex

# The pre-token pattern of byte-level BPE vocabularies and their one special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"


# Code points that are letters or digits only from Unicode 17 on; to the vocabularies' tables they are neither.
NEWER = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


@functools.cache
def _compiled() -> tuple[regex.Pattern, regex.Pattern, regex.Pattern]:
    """The plain pattern, one to which ``NEWER`` are neither letters nor digits, and a test for those."""
    odd = "".join("-".join(f"\\U{int(x, 16):08x}" for x in span.split("-")) for span in NEWER.split())
    letter, digit = rf"[\p{{L}}--[{odd}]]", rf"[\p{{N}}--[{odd}]]"
    other = rf"[^\s[\p{{L}}--[{odd}]][\p{{N}}--[{odd}]]]"
    strict = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{other}+|\s+(?!\S)|\s+"
    return regex.compile(PATTERN), regex.compile(strict, regex.V1), regex.compile(f"[{odd}]")


def pre_tokens(text: str) -> list[str]:
    plain, strict, odd = _compiled()
    if text.isascii() or not odd.search(text):
        return plain.findall(text)
    return strict.findall(text)


def pre_tokens_with_special(text: str) -> list[str]:
    """As ``pre_tokens``; the special token, wherever it stands in the text, is a pre-token of its own."""
    parts = text.split(SPECIAL)
    out = pre_tokens(parts[0])
    for part in parts[1:]:
        out.append(SPECIAL)
        out += pre_tokens(part)
    return out


class Interner:
    """Numbers distinct strings in the order in which they appear."""

    def __init__(self) -> None:
        self.ids: defaultdict[str, int] = defaultdict(itertools.count().__next__)

    def __len__(self) -> int:
        return len(self.ids)

    def number(self, tokens: Iterable[str]) -> list[int]:
        return list(map(self.ids.__getitem__, tokens))

    def since(self, n: int) -> list[str]:
        return list(itertools.islice(self.ids, n, None))


def gather(flat: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the slices ``flat[offsets[k]:offsets[k+1]]`` for ``k`` in ``pick``; also the end of each slice."""
    length = (offsets[1:] - offsets[:-1])[pick]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    where = np.repeat(offsets[:-1][pick] - (ends - length), length) + np.arange(total)
    return flat[where], ends
