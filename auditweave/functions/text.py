"""Column expressions over paths and texts."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditweave import vocab

# The characters a text strip removes (Unicode white space).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``.

    A lambda that refers to an outer column may get that column's whole expression inlined and
    recomputed per element; binding it to a one-element array keeps long texts split once.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends. Linear, where a regex with ``\\s+$`` is not."""
    return F.btrim(text, F.lit(WHITESPACE))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def cap_lines(text: Column, limit: int | None = vocab.MAX_FILE_LINES) -> Column:
    """The first ``limit`` lines (None: all); shorter texts pass unchanged."""
    return text if limit is None else F.substring_index(text, "\n", limit)


def decode_source(raw: Column) -> Column:
    """UTF-8 with replacement characters, and one kind of line end."""
    text = F.make_valid_utf8(raw.cast("string"))
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.replace(unix, F.lit("\r"), F.lit("\n"))


def suffix(path: Column) -> Column:
    """Last suffix of the file name; a dotfile has none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1)


def language_of(path: Column) -> Column:
    pairs = [F.lit(v) for item in vocab.CODE_LANGUAGES.items() for v in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(suffix(path))), F.lit("unknown"))


def is_code(path: Column) -> Column:
    return suffix(path).isin(*vocab.CODE_LANGUAGES)


def in_skipped_dir(path: Column, names=vocab.SKIPPED_DIRS) -> Column:
    """True when any path segment equals one of ``names``."""
    quoted = "|".join(n.replace(".", r"\.") for n in names)
    return path.rlike(rf"(^|/)({quoted})(/|\z)")


def guards_access(path: Column) -> Column:
    lowered = F.lower(path)
    return lowered.contains("middleware") | lowered.contains("guard")


class EstimatedTokens:
    """Token count as a quarter of the characters, rounded up. Stays in the JVM."""

    in_lambdas = True

    def of(self, text: Column) -> Column:
        return F.ceil(F.length(text) / 4)

    def of_each(self, texts: Column) -> Column:
        return F.transform(texts, self.of)


class EncodedTokens:
    """Exact counts from a user-supplied encoder, as Arrow batches.

    ``make_encoder`` runs once per Python worker and returns a function ``str -> sequence``.
    """

    in_lambdas = False

    def __init__(self, make_encoder: Callable[[], Callable[[str], list]]):
        @F.pandas_udf(T.LongType())
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = make_encoder()
            for texts in batches:
                yield texts.map(lambda t: len(encode(t)) if t else 0)

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def count_each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = make_encoder()
            for lists in batches:
                yield lists.map(lambda ts: [len(encode(t)) if t else 0 for t in ts])

        self.of = count
        self.of_each = count_each


ESTIMATE = EstimatedTokens()
