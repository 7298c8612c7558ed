"""Pre-token splitting with character classes spelt out for the common scripts."""

from __future__ import annotations

import re
import unicodedata

#: Up to here the classes of every Unicode release in use agree, so they are spelt out for the faster engine.
_END = 0x530
WHITE = r"\t-\r\x20\x85\xa0"
is_plain = re.compile(r"[\u0000-\u052f]*").fullmatch


def class_of(major: str) -> str:
    """The characters below _END whose general category starts with major, as ranges of a character class."""
    out, cp = [], 0
    while cp < _END:
        if unicodedata.category(chr(cp))[0] == major:
            first = cp
            while cp + 1 < _END and unicodedata.category(chr(cp + 1))[0] == major:
                cp += 1
            out.append(f"\\u{first:04x}-\\u{cp:04x}")
        cp += 1
    return "".join(out)


def plain_pattern(template: str) -> re.Pattern:
    """A pattern over plain text; <L>, <N> and <S> stand for the letters, numbers and white space in a class."""
    return re.compile(template.replace("<L>", class_of("L")).replace("<N>", class_of("N")).replace("<S>", WHITE))
