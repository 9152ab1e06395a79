"""Splitting of a text into the pieces that byte-level BPE merges separately."""

from __future__ import annotations

import regex

#: Code points that the tokenizer libraries count as neither letters nor digits, though newer
#: Unicode versions (and the regex module) do. First and last of each range.
LATER_CODE_POINTS = """
0558-0558 058B-058C 088F-088F 0C5C-0C5C 0CDC-0CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4
A7DD-A7DD A7E2-A7E2 A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A
11DB0-11DDB 11DE0-11DE9 11DF1-11DF1 1246F-1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479
3D000-3FC3F
"""


class Splitter:
    """pieces(text) gives the matches of the pattern in order; together they are the whole text."""

    def __init__(self, pattern: str):
        ranges = [r.split("-") for r in LATER_CODE_POINTS.split()]
        later = "".join(f"\\U{int(a, 16):08X}-\\U{int(b, 16):08X}" for a, b in ranges)
        self.fast = regex.compile(pattern).findall
        self.later = regex.compile(f"[{later}]").search
        exact = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s[[\p{{L}}\p{{N}}]--[{later}]]]")
        exact = regex.sub(r"(?<!\\p\{L\})(?<!\[)\\p\{([LN])\}\+", rf"[\\p{{\1}}--[{later.replace(chr(92), chr(92) * 2)}]]+", exact)
        self.exact = regex.compile(exact, regex.V1).findall

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.later(text):
                return self.exact(text)
        return self.fast(text)
