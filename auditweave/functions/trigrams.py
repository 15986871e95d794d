"""Which three-character pieces a text must hold for a regular expression to match in it."""

import itertools
import re
import warnings
from collections.abc import Sequence
from re import IGNORECASE, _constants, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ways to match that are told apart; a part of an expression with more of them is left open.
MOST_WAYS = 256
#: Characters of a class that are told apart.
MOST_OF_CLASS = 4
#: Stands for any text, the empty one too.
GAP = None


def pieces(text: Column) -> Column:
    """The different three-character pieces of a text; the zero-width search makes it linear in its length."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def pieces_of(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """What :func:`pieces` finds in ``texts``: numbers of pieces and places of texts that hold them, in order, and the pieces."""
    place = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    if len(chars) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    code = chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:]
    own = place[:-2] == place[2:]
    first, place, code = chars[:-2][own], place[:-2][own], code[own]
    # The search also begins in the midst of a character beyond 16 bits, and half of one reads as a question mark.
    wide = first > 0xFFFF
    if wide.any():
        place = np.append(place, place[wide])
        code = np.append(code, code[wide] & (1 << 42) - 1 | ord("?") << 42)
    known = pa.array(code).dictionary_encode()
    found = np.sort(known.indices.to_numpy().astype(np.int64) * len(texts) + place)
    found = found[np.diff(found, prepend=-1) > 0]
    codes = known.dictionary.to_numpy()
    names = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return found // len(texts), found % len(texts), [names[i : i + 3] for i in range(0, len(names), 3)]


def _joined(parts: Sequence[list[tuple]]) -> list[tuple]:
    """Every way to match the parts one after the other; the widest parts are left open where they are too many."""
    parts = list(parts)
    while True:
        count = 1
        for part in parts:
            count *= len(part)
        if count <= MOST_WAYS:
            return [tuple(itertools.chain.from_iterable(way)) for way in itertools.product(*parts)]
        widest = max(range(len(parts)), key=lambda i: len(parts[i]))
        parts[widest] = [(GAP,)]


def _ways(tree) -> list[tuple]:
    """Ways to match a parsed expression, each a sequence of characters and gaps."""
    parts = []
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            parts.append([(chr(value),)])
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        elif name == "IN" and len(value) <= MOST_OF_CLASS and all(k is _constants.LITERAL for k, _ in value):
            parts.append([(chr(c),) for _, c in value])
        elif name == "BRANCH":
            parts.append([way for branch in value[1] for way in _ways(branch)])
        elif name == "SUBPATTERN":
            parts.append(_ways(value[-1]))
        elif name == "ATOMIC_GROUP":
            parts.append(_ways(value))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            if (least, most) == (0, 1):
                parts.append([(), *_ways(inner)])
            elif least == 0:
                parts.append([(GAP,)])
            elif (least, most) == (1, 1):
                parts.append(_ways(inner))
            else:
                # The first and the last round stand at the borders.
                parts += [_ways(inner), [(GAP,)], _ways(inner)] if least > 1 else [[(*way, GAP) for way in _ways(inner)]]
        else:
            parts.append([(GAP,)])
    return _joined(parts)


def _parsed(pattern: str):
    """The expression as a tree, or null if it ignores case or is of another dialect."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = _parser.parse(pattern)
    except Exception:  # another dialect
        return None
    if tree.state.flags & IGNORECASE or "(?" in pattern.replace("(?:", "").replace("(?=", "").replace("(?!", "").replace("(?<", ""):
        return None
    return tree


def starts(pattern: str) -> set[str] | None:
    """Two-character texts with one of which every match of ``pattern`` begins; null where one way to match has none.

    Gives up on escapes and classes that mean something else in Java.
    """
    if re.search(r"\\[^\WwsdbWSDB]|\[[^\]]*(?:\[|&&)", pattern):
        return None
    tree = _parsed(pattern)
    if tree is None:
        return None
    ways = _ways(tree)
    if any(len(way) < 2 or GAP in way[:2] or not "".join(way[:2]).isascii() for way in ways):
        return None
    return {"".join(way[:2]) for way in ways}


def needed(pattern: str) -> list[frozenset[str]] | None:
    """Sets of three-character pieces: a text that ``pattern`` matches holds all pieces of one of the sets.

    Null where nothing is certain: expressions that ignore case, that this dialect cannot read, or that have
    a way to match without three known characters in a row.
    """
    tree = _parsed(pattern)
    if tree is None:
        return None
    found = set()
    for way in _ways(tree):
        texts = "".join("\0" if c is GAP else c for c in way).split("\0")
        own = frozenset(t[i : i + 3] for t in texts for i in range(len(t) - 2))
        if not own:
            return None
        found.add(own)
    return [s for s in found if not any(o < s for o in found)]
