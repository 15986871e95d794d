import itertools

import numpy as np
import pytest

from auditweave.llm import language
from auditweave.llm.base import held_out
from tests.llm.helpers import documents, prose

PIECES = ["▁a", "▁ab", "b", "a", "ba", "▁", "bb"]


def brute(word, pieces, probabilities):
    """Sum over all ways to cut ``word`` into pieces or unknown characters."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        p = 1.0
        for part in parts:
            known = probabilities[pieces.index(part)] if part in pieces else 0.0
            p *= known + (language.UNKNOWN if len(part) == 1 else 0.0)
        total += p
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    probabilities = rng.random((len(PIECES), 2))
    model = language.PieceModel(["x", "y"], PIECES, probabilities, np.array([0.5, 0.5]))
    words = ["▁abba", "▁bbb", "▁", "▁aé", "▁abab", "bbab"]
    scores = model.score_words(words)
    for i, word in enumerate(words):
        for k in range(2):
            assert scores[i, k] == pytest.approx(np.log(brute(word, PIECES, probabilities[:, k])))


def forward(word, pieces, probabilities):
    """``brute`` by the textbook recursion in logs, for words that have too many segmentations to list."""
    sums = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            part = word[start:end]
            p = (probabilities[pieces.index(part)] if part in pieces else 0.0) + (language.UNKNOWN if len(part) == 1 else 0.0)
            if p:
                sums[end] = np.logaddexp(sums[end], sums[start] + np.log(p))
    return sums[-1]


@pytest.mark.parametrize("size", [1, 2, 7, 23, 24, 25, 48, 49, 100, 331])
def test_long_words_are_summed_over_all_segmentations(size):
    rng = np.random.default_rng(size)
    pieces = [*PIECES, "abab", "babba", "bbbbbbbb", "aéa"]
    probabilities = rng.random((len(pieces), 3)) * [1, 1e-3, 1e-9]
    model = language.PieceModel(["x", "y", "z"], pieces, probabilities, np.ones(3) / 3)
    word = "▁" + "".join(rng.choice(list("aaabbbbé"), size))
    got = model.score_long(word)
    for k in range(3):
        assert got[k] == pytest.approx(forward(word, pieces, probabilities[:, k]), rel=1e-10)
        if size < 9:
            assert got[k] == pytest.approx(np.log(brute(word, pieces, probabilities[:, k])))


def test_predictions_equal_brute_force_posteriors():
    rng = np.random.default_rng(5)
    probabilities = rng.random((len(PIECES), 2))
    model = language.PieceModel(["x", "y"], PIECES, probabilities, np.array([0.3, 0.7]))
    texts = ["abba " + "ab" * 50 + " Bb, bb", "b" * 130, "a1b " * 40, "é" * 30]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        words = ["▁" + w for w in language.WORD.findall(text.lower())]
        logs = [np.log(model.priors[k]) + sum(forward(w, PIECES, probabilities[:, k]) for w in words) for k in (0, 1)]
        assert name == "xy"[int(np.argmax(logs))]
        assert score == pytest.approx(1 / np.exp(np.array(logs) - max(logs)).sum())


def test_a_very_long_word(spark):
    model = language.PieceModel(["x", "y"], PIECES, np.full((len(PIECES), 2), [0.2, 0.1]), np.array([0.5, 0.5]))
    assert model.predict(["ab" * 150_000]) == (["x"], [1.0])


def test_expected_uses_equal_brute_force():
    probabilities = np.full((len(PIECES), 1), 0.2)
    model = language.PieceModel(["x"], PIECES, probabilities, np.array([1.0]))
    uses = model.expected(["▁aba"], np.array([[3.0]]))
    whole = brute("▁aba", PIECES, probabilities[:, 0])
    for k, piece in enumerate(PIECES):
        step = 1e-6
        moved = probabilities[:, 0].copy()
        moved[k] += step
        slope = (brute("▁aba", PIECES, moved) - whole) / step
        assert uses[k, 0] == pytest.approx(3 * 0.2 * slope / whole, rel=1e-3, abs=1e-9), piece


def rows():
    out = [(i, prose(i, 60, "abcde"), "one", "s") for i in range(60)]
    out += [(100 + i, prose(i, 60, "cdefg"), "two", "s") for i in range(60)]
    return out + [(200, "", "one", "s"), (201, None, "one", "s"), (202, "123 !?", None, "s"), (None, prose(1, 9), None, "s"),
                  (203, "w" * 5000, None, "s"), (204, prose("long", 20_000, "abcde"), "one", "s")]


def test_held_out_accuracy_and_cases(spark):
    docs = documents(spark, rows(), ("score_", "row"))
    docs = docs.withColumn("held_out", held_out(docs.doc_id))
    model = language.fit(docs.where("NOT held_out"))
    got = language.identified(docs.select("doc_id", "lang", "text", "held_out"), model).collect()
    assert len(got) == len(rows())
    tested = [r for r in got if r.held_out and r.lang and (r.text or "").strip()]
    assert len(tested) > 10 and all(r.lang_pred == r.lang for r in tested)
    by_id = {r.doc_id: r for r in got}
    for doc_id in (200, 201, 202):
        assert (by_id[doc_id].lang_pred, by_id[doc_id].score) == ("und", 0.0)
    assert by_id[203].lang_pred in ("one", "two") and all(0 <= r.score <= 1 for r in got)


def test_rejects_and_empty_tables(spark):
    docs = documents(spark, rows(), ("score", "lang_pred"))
    model = language.fit(docs)
    kept = language.in_known_languages(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {200, 201, 202} and set(range(60)) <= ids
    assert language.in_known_languages(documents(spark, []), model).count() == 0
    none = language.fit(documents(spark, []))
    assert [r.lang_pred for r in language.identified(documents(spark, [(1, "a b")]).select("text"), none).collect()] == ["und"]


def test_every_labelled_language_is_learned(spark):
    letters = "abcdefghijklmnopqrst"
    pairs = list(itertools.combinations(letters, 2))[:70]
    rows = [(10 * k + i, prose((k, i), 30, "".join(pair)), f"lang{k}", "s") for k, pair in enumerate(pairs) for i in range(3 if k else 2)]
    docs = documents(spark, rows)
    model = language.fit(docs)
    assert model.languages == sorted({r[2] for r in rows})
    got = language.identified(docs, model).where("lang = 'lang0'").collect()
    assert len(got) == 2 and {r.lang_pred for r in got} == {"lang0"}


def test_the_runs_of_a_fit_are_bounded(spark, monkeypatch):
    docs = documents(spark, [(1, "aa aa aa bb bb cc", "x", "s"), (2, "bb bb aa", "y", "s"), (3, "dd", "y", "s")])
    labelled = docs.select("text", "lang")
    assert len(language.training_counts(labelled)[1]) == 6
    monkeypatch.setattr(language, "SAMPLE_RUNS", 2)
    assert language.training_counts(labelled) == ({"x": 1, "y": 2}, [("x", "▁aa", 3), ("x", "▁bb", 2), ("y", "▁aa", 1), ("y", "▁bb", 2)])
