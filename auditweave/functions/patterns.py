"""Searches with many regular expressions over long texts.

A regular expression costs far more per character than a search for a plain text. So patterns that
mean only themselves are searched as text, and others run only where a text they need occurs.
"""

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditweave.functions import trigrams

# Makes \w, \s and \b cover Unicode and "\n" the only line end.
FLAGS = "(?dU)"

_ESCAPED = re.compile(r"\\(\W)")
_META = re.compile(r"[\\.^$*+?{}\[\]|()]")


def plain_text(pattern: str) -> str | None:
    """The text that ``pattern`` means, or null if it is more than a text."""
    if _META.search(_ESCAPED.sub("", pattern)):
        return None
    return _ESCAPED.sub(r"\1", pattern)


def needed_text(pattern: str) -> str | None:
    """A text that every match of ``pattern`` contains, or null where none is certain.

    Looks at the parts outside of groups, classes and repetitions only, and gives up on flags,
    look-around, alternatives and unusual escapes.
    """
    if re.search(r"\(\?(?!:)|\\[^\WwsdbWSDB]|\\$", pattern):
        return None
    gap = "\0"
    rest = re.sub(r"\\[wsdbWSDB]", gap, pattern)
    # Escaped characters stand for themselves; park them where no special character is.
    rest = _ESCAPED.sub(lambda m: chr(0xE000 + ord(m[1])) if m[1].isascii() else m[1], rest)
    rest = re.sub(r"\[\^?\]?[^\]]*\]", gap, rest)
    while (inner := re.sub(r"\([^()]*\)", gap, rest)) != rest:
        rest = inner
    rest = re.sub(r".(?:[*?]|\{\d*(?:,\d*)?\})", gap, rest, flags=re.S)
    rest = re.sub(r"[.^$+]", gap, rest)
    if re.search(r"[\[\]()|{}\\]", rest):
        return None
    rest = "".join(chr(ord(c) - 0xE000) if 0xE000 <= ord(c) < 0xE080 else c for c in rest)
    return max(rest.split(gap), key=len) or None


def _literal(char: str) -> str:
    return char if char.isalnum() or char == "_" else "\\" + char


def beginning(patterns: Sequence[str]) -> str:
    """A look-ahead for the first two characters of the matches of ``patterns``, or no text where they are uncertain.

    It turns away most places of a text at once, where an expression would try each of its alternatives.
    """
    begins = [trigrams.starts(p) for p in patterns]
    if not begins or None in begins or len(pairs := set().union(*begins)) < 2:
        return ""
    firsts = sorted({p[0] for p in pairs})
    seconds = ["".join(_literal(p[1]) for p in sorted(pairs) if p[0] == c) for c in firsts]
    return f"(?=[{''.join(map(_literal, firsts))}])(?={'|'.join(f'{_literal(c)}[{s}]' for c, s in zip(firsts, seconds))})"


def any_of(patterns: Sequence[str]) -> str:
    """One expression for all ``patterns``, with the flags set."""
    return FLAGS + beginning(patterns) + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def possible(text: Column, patterns: Sequence[str]) -> Column:
    """False only where none of ``patterns`` can match."""
    needed = [needed_text(p) for p in patterns]
    if None in needed:
        return F.lit(True)
    fewest = [n for n in dict.fromkeys(needed) if not any(o != n and o in n for o in needed)]
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in fewest], F.lit(False))


def found(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any of ``patterns`` matches."""
    tests = []
    for pattern in patterns:
        plain = plain_text(pattern)
        if plain is not None:
            tests.append(F.contains(text, F.lit(plain)))
        else:
            tests.append(possible(text, [pattern]) & text.rlike(FLAGS + pattern))
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))


def all_matches(text: Column, pattern: str) -> Column:
    """Whole matches in order."""
    hits = F.regexp_extract_all(text, F.lit(f"{FLAGS}{beginning([pattern])}(?:{pattern})"), F.lit(0))
    return F.when(possible(text, [pattern]), hits).otherwise(F.array().cast("array<string>"))
