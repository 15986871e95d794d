"""Small tables for the tests of the operators."""

import random

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, extra=()):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source), with more columns if asked."""
    full = [(*r, *("en", "src0")[len(r) - 2 :], None if r[1] is None else len(r[1])) for r in rows]
    schema = ", ".join([DOCUMENTS, *(f"`{name}` string" for name in extra)])
    return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in full], schema)


def prose(seed, words, alphabet="abcdefgh"):
    rng = random.Random(str(seed))
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(words))
