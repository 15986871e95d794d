"""Language identification by unigram pieces, summed over all segmentations of each word."""

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.base import map_texts, packed_rows, unpacked_rows
from auditweave.plans.joins import lookup_join, stored

#: Rows per language that a model is fitted on.
SAMPLE_ROWS = 400
#: Different runs per language that a fit counts, the most frequent first, however long the sampled texts are.
SAMPLE_RUNS = 50_000
ROUNDS = 4
PIECE_CHARS = 8
#: Characters of a run: what a fit counts, and the blocks in which a longer word is scored.
RUN_CHARS = 24
#: Words of a fit whose lattices are held at once, and characters of a task's texts.
EM_WORDS = 5_000
BATCH_CHARS = 2_000_000
#: With more languages than this, these lists are shorter in proportion.
FEW_LANGUAGES = 16
UNKNOWN = 1e-7
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
START = "▁"


@functools.cache
def public_pieces(model_path: str | None = None, most: int = PIECE_CHARS) -> list[str]:
    """The letter pieces of a public vocabulary, lower-cased, of at most ``most`` characters."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {model.id_to_piece(i).lower() for i in range(model.vocab_size()) if not model.is_byte(i)}
    return sorted(p for p in pieces if len(p) <= most and WORD.fullmatch(p.removeprefix(START)))


class Lattice:
    """A trie of the pieces as one dense table, for all places of many words at once."""

    def __init__(self, pieces: Iterable[str]):
        pieces = list(pieces)
        letters = sorted({c for p in pieces for c in p})
        self.codes = np.zeros(0x110000, dtype=np.int32)
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        children: list[dict[int, int]] = [{}, {}]  # 0: no piece goes on here, 1: the root
        ends = [-1, -1]
        for n, piece in enumerate(pieces):
            at = 1
            for c in piece:
                at = children[at].setdefault(int(self.codes[ord(c)]), len(children))
                if at == len(children):
                    children.append({})
                    ends.append(-1)
            ends[at] = n
        self.steps = np.zeros(len(children) * self.width, dtype=np.int32)
        for at, below in enumerate(children):
            for code, to in below.items():
                self.steps[at * self.width + code] = to
        self.ends = np.array(ends, dtype=np.int32)
        self.longest = max(map(len, pieces), default=1)

    def arcs(self, words: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Per start and length the rows of ``words`` (letters' codes) with a piece there, and the pieces."""
        rows, size = words.shape
        out = []
        for start in range(size):
            state = np.ones(rows, dtype=np.int64)
            at = np.arange(rows)
            found = []
            for end in range(start, min(size, start + self.longest)):
                state = self.steps[state * self.width + words[at, end]].astype(np.int64)
                alive = state > 0
                if not alive.all():
                    at, state = at[alive], state[alive]
                piece = self.ends[state]
                hit = piece >= 0
                found.append((at[hit], piece[hit]))
                if not len(at):
                    break
            out.append(found)
        return out


class Numbers(dict):
    """Numbers its keys from 0 in the order in which they are asked for."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


def runs(word: str) -> list[str]:
    """A word with its start sign in runs of at most RUN_CHARS characters."""
    word = START + word
    return [word[i : i + RUN_CHARS] for i in range(0, len(word), RUN_CHARS)]


class PieceModel:
    """Piece probabilities of each language (columns) and the sum over all segmentations of a text."""

    def __init__(self, languages: list[str], pieces: list[str], probabilities: np.ndarray, priors: np.ndarray):
        self.languages, self.pieces = languages, pieces
        self.probabilities, self.priors = probabilities, priors

    def __getstate__(self):
        return self.languages, self.pieces, self.probabilities, self.priors

    def __setstate__(self, state):
        self.__init__(*state)

    @functools.cached_property
    def lattice(self) -> Lattice:
        return Lattice(self.pieces)

    def fewer(self, most: int) -> int:
        """``most``, or less in proportion to the languages that are many."""
        return max(1, most * FEW_LANGUAGES // max(FEW_LANGUAGES, len(self.languages)))

    def by_length(self, words: list[str], most: int = 20_000):
        """Numbers and codes of words of the same length, ``most`` at a time."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        most = self.fewer(most)
        for size in np.unique(sizes):
            every = np.flatnonzero(sizes == size)
            for begin in range(0, len(every), most):
                chosen = every[begin : begin + most]
                flat = np.frombuffer("".join(words[i] for i in chosen).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                yield chosen, self.lattice.codes[flat].reshape(-1, size)

    def advance(self, alpha: np.ndarray, arcs, starts: int) -> np.ndarray:
        """Add to ``alpha`` (place, word, …, language) what the pieces that begin at its first places bring."""
        between = (1,) * (alpha.ndim - 3)
        for start in range(starts):
            alpha[start + 1] += alpha[start] * UNKNOWN
            for k, (at, piece) in enumerate(arcs[start]):
                if len(at):
                    chances = self.probabilities[piece].reshape(len(at), *between, -1)
                    alpha[start + k + 1, at] += alpha[start, at] * chances
        return alpha

    def forward(self, words: np.ndarray, arcs) -> np.ndarray:
        """Probability of every beginning of every word: the sum over the pieces that may come last."""
        rows, size = words.shape
        alpha = np.zeros((size + 1, rows, len(self.languages)))
        alpha[0] = 1.0
        return self.advance(alpha, arcs, size)

    def score_long(self, word: str) -> np.ndarray:
        """Log probability of a word of any length in each language, over all its segmentations.

        A block of the word maps the sums that pieces begun before it bring to its first places onto those
        that pieces begun before its end bring to the places after it. These maps are found for many
        blocks at once and then applied one after the other, so no segmentation across a border is lost
        and memory does not grow with the word, but for one code per letter.
        """
        reach = max(1, self.lattice.longest)
        size = max(RUN_CHARS, reach)
        letters = self.lattice.codes[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        blocks = -(-len(letters) // size)
        filled = np.zeros(blocks * size + reach - 1, dtype=letters.dtype)  # no piece goes through a letter of code 0
        filled[: len(letters)] = letters
        windows = np.lib.stride_tricks.sliding_window_view(filled, size + reach - 1)[::size]
        state = np.zeros((reach, len(self.languages)))
        state[0] = 1.0
        logs = np.zeros(len(self.languages))
        most = max(1, self.fewer(4_000) // reach)
        for begin in range(0, blocks, most):
            part = windows[begin : begin + most]
            alpha = np.zeros((size + reach, len(part), reach, len(self.languages)))
            for place in range(reach):
                alpha[place, :, place] = 1.0
            self.advance(alpha, self.lattice.arcs(part), size)
            for step in alpha[size:].transpose(1, 2, 0, 3):
                state = np.einsum("il,ijl->jl", state, step)
                largest = state.max(axis=0)
                state /= largest
                logs += np.log(largest)
        # Behind the word's end one unknown letter follows another up to the end of its last block.
        return logs + np.log(state[0]) - (blocks * size - len(letters)) * np.log(UNKNOWN)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each run of letters in each language."""
        out = np.zeros((len(words), len(self.languages)))
        for chosen, codes in self.by_length(words):
            out[chosen] = np.log(self.forward(codes, self.lattice.arcs(codes))[-1])
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in each language, over all segmentations."""
        total = np.zeros_like(self.probabilities)
        for chosen, codes in self.by_length(words, EM_WORDS):
            arcs = self.lattice.arcs(codes)
            alpha = self.forward(codes, arcs)
            beta = np.zeros_like(alpha)
            beta[-1] = 1.0
            weight = counts[chosen] / alpha[-1]
            for start in range(codes.shape[1] - 1, -1, -1):
                beta[start] += beta[start + 1] * UNKNOWN
                for k, (at, piece) in enumerate(arcs[start]):
                    if len(at):
                        after = self.probabilities[piece] * beta[start + k + 1, at]
                        beta[start, at] += after
                        np.add.at(total, piece, alpha[start, at] * after * weight[at])
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its posterior probability; UNDETERMINED and 0 without letters."""
        known = Numbers()
        ids = [np.fromiter(map(known.__getitem__, WORD.findall((text or "").lower())), dtype=np.int64) for text in texts]
        names = [UNDETERMINED] * len(texts)
        certain = [0.0] * len(texts)
        if not known or not self.languages:
            return names, certain
        scores = self.score_words([START + word[: RUN_CHARS - 1] for word in known])
        for word, number in known.items():
            if len(word) >= RUN_CHARS:
                scores[number] = self.score_long(START + word)
        for i, own in enumerate(ids):
            if len(own):
                logs = np.log(self.priors)
                for begin in range(0, len(own), 100_000):
                    logs = logs + scores[own[begin : begin + 100_000]].sum(axis=0)
                best = int(np.argmax(logs))
                names[i] = self.languages[best]
                certain[i] = float(1 / np.exp(logs - logs[best]).sum())
        return names, certain


def training_counts(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[dict[str, int], list[tuple[str, str, int]]]:
    """Sampled rows of every language, and (lang, run, how often) over about ``rows`` rows of each.

    The rows are those with the smallest hashes, by a share that follows from the counts, so the sample
    is the same in each run and its size does not grow with the table. Runs are counted where the texts
    are; the counts of the SAMPLE_RUNS most frequent runs of each language reach the driver.
    """
    counts = stored(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("of_rows")), "languages")
    draw = F.pmod(F.xxhash64(*labelled.columns), F.lit(1_000_000)) / 1e6
    drawn = lookup_join(labelled.select("lang", "text", draw.alias("draw")), counts, "lang", spread=("draw",))
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("of_rows"))
    picked = stored(drawn.where(F.col("draw") < share).select("lang", "text"), "language")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.update((lang, run) for word in WORD.findall(text.lower()) for run in runs(word))
        columns = [pa.array([k[i] for k in found], type=pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), type=pa.int64())], names=["lang", "run", "n"])

    uses = picked.mapInArrow(count, "lang string, run string, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    often = Window.partitionBy("lang").orderBy(F.desc("n"), "run")
    kept = uses.withColumn("place", F.row_number().over(often)).where(F.col("place") <= SAMPLE_RUNS).drop("place")
    return {r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()}, sorted(map(tuple, kept.collect()))


def fit(labelled: DataFrame, pieces: list[str] | None = None, rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> PieceModel:
    """A model of every language in ``labelled`` (text, lang), by expectation maximisation on a sample.

    Pieces with a letter that no sampled text has are left out: they have the same probability in every
    language, and their letters would widen the lattice's table. Rows with a null text or lang are passed
    over. No rows: a model without languages.
    """
    pieces = public_pieces() if pieces is None else pieces
    sampled, uses = training_counts(labelled.where("text IS NOT NULL AND lang IS NOT NULL"), rows)
    names = sorted(sampled)
    columns = {name: i for i, name in enumerate(names)}
    words: dict[str, int] = {}
    for _, run, _ in uses:
        words.setdefault(run, len(words))
    letters = {c for word in words for c in word}
    pieces = [p for p in pieces if letters.issuperset(p)]
    counts = np.zeros((len(words), len(names)))
    for lang, run, n in uses:
        counts[words[run], columns[lang]] = n
    docs = np.array([sampled[name] for name in names], dtype=float)
    model = PieceModel(names, pieces, np.full((len(pieces), len(names)), 1 / max(1, len(pieces))), docs / max(1.0, docs.sum()))
    for _ in range(rounds if names and words else 0):
        uses = model.expected(list(words), counts)
        shared = uses.sum(axis=1, keepdims=True) + 0.01
        uses += 50 * shared / shared.sum()
        model = PieceModel(names, pieces, uses / uses.sum(axis=0), model.priors)
    return model


def identified(docs: DataFrame, model: PieceModel, column: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language of ``column`` and its probability.

    Nulls, empty texts and texts without a letter: ``und`` and 0. Whole texts are read and every word is
    summed over all its segmentations, however long it is. Ties go to the first language by name. Repeated rows are alike.
    """

    def worker():
        def compute(texts: list) -> list[pa.Array]:
            langs, scores = model.predict(texts)
            return [pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())]

        return compute

    return map_texts(docs, column, f"{names[0]} string, {names[1]} double", worker, model.fewer(BATCH_CHARS))


def in_known_languages(docs: DataFrame, model: PieceModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is determined with probability ``least`` or more, all columns."""
    rows = identified(packed_rows(docs), model)
    return unpacked_rows(rows.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)), docs)
