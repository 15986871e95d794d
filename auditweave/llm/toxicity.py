"""Toxicity by a weighted grammar of finite-state transducers over the clauses of a text."""

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.base import map_texts
from auditweave.plans.joins import stored

#: Labelled rows that are read for a fit, at most (about), for each label.
SAMPLE_ROWS = {1: 5_000, 0: 10_000}
#: Texts that an entry occurs in, at least; chance is left to the standard error of its weight.
LEAST_TEXTS = 3
PREFIXES = range(3, 9)
LEAST_WEIGHT = 2.2
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,|\n]|[\"“”„«»]")
BREAKS = frozenset(".!?;:,|\n")
QUOTES = frozenset("\"“”„«»")

#: A word's class and weight where nothing was learned. Words by language: en, es, fr, de.
LEXICON = {
    "insult": (1.5, "idiot moron stupid loser scum pathetic worthless disgusting trash clown fool imbecile dumb "
                    "idiota estúpido imbécil basura asqueroso inútil idiote stupide imbécile ordure minable "
                    "dumm dummkopf trottel abschaum versager erbärmlich"),
    "threat": (1.5, "kill hurt destroy beat stab shoot matar golpear destruir tuer frapper détruire töten schlagen zerstören"),
    "modal": (0.0, "will shall gonna going voy vamos vais vas va werde werden wirst"),
    "target": (0.0, "you your yours yourself tú usted ustedes vosotros ti tu tes toi vous votre du dich dir ihr euch dein deine"),
    "negation": (0.0, "not never nobody isn aren don nunca jamás ningún pas jamais aucun nicht kein keine nie niemals"),
    "report": (0.0, "said says called wrote claims quoted dijo dice llamó escribió dit disait écrit appelé sagte schrieb nannte"),
}


class Transducer:
    """A deterministic finite-state transducer: ``step`` maps (state, symbol) to (state, symbol).

    A symbol is a class and its marks, joined by "+". Symbols that it does not change pass through.
    """

    def __init__(self, start, step: Callable):
        self.start, self.step = start, step

    def over(self, symbols: Iterable[str]) -> Iterator[str]:
        state = self.start
        for symbol in symbols:
            state, out = self.step(state, symbol)
            yield out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds what ``first`` writes to ``second``; its arcs are kept once they were taken."""
    arcs: dict = {}

    def step(state, symbol):
        if (state, symbol) not in arcs:
            left, middle = first.step(state[0], symbol)
            right, out = second.step(state[1], middle)
            arcs[state, symbol] = (left, right), out
        return arcs[state, symbol]

    return Transducer((first.start, second.start), step)


def _kind(symbol: str) -> str:
    return symbol.partition("+")[0]


def window(opens: str, mark: str, reach: int) -> Transducer:
    """Marks insults and threats that follow a symbol of class ``opens`` within ``reach`` symbols."""

    def step(left, symbol):
        kind = _kind(symbol)
        if kind == opens:
            return reach, symbol
        marked = f"{symbol}+{mark}" if left and kind in ("insult", "threat") else symbol
        return max(0, left - 1), marked

    return Transducer(0, step)


def quoted() -> Transducer:
    """Marks insults and threats inside quotation marks or after a verb of reporting."""

    def step(inside, symbol):
        kind = _kind(symbol)
        if kind == "quote":
            return not inside, symbol
        if kind == "report":
            return True, symbol
        return inside, f"{symbol}+reported" if inside and kind in ("insult", "threat") else symbol

    return Transducer(False, step)


def insults() -> Transducer:
    """Insults count by themselves; the second and later ones of a clause are marked as piled up."""

    def step(seen, symbol):
        if _kind(symbol) != "insult":
            return seen, symbol
        return True, f"{symbol}+piled" if seen else symbol

    return Transducer(False, step)


def threats() -> Transducer:
    """A verb of violence is a threat after a modal; without one it becomes an ordinary word."""

    def step(left, symbol):
        kind = _kind(symbol)
        if kind == "modal":
            return 4, symbol
        if kind == "threat" and not left:
            return 0, "other"
        return max(0, left - 1), symbol

    return Transducer(0, step)


def grammar() -> Transducer:
    """Insult, threat, target, negation and reported speech, composed in this order."""
    out = compose(insults(), threats())
    for part in (window("target", "targeted", 6), window("negation", "negated", 4), quoted()):
        out = compose(out, part)
    return out


FEATURES = ("plain", "targeted", "negated", "reported", "threat", "clauses")
PRIOR = np.array([-3.0, 1.5, 2.0, 0.5, 0.5, 2.0, 1.0])


class Lexicon:
    """Classes and weights of words: learned words and beginnings of words before the given ones."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float]):
        self.words, self.prefixes = words, prefixes
        self.given = {w: (kind, weight) for kind, (weight, text) in LEXICON.items() for w in text.split()}

    def look_up(self, token: str) -> tuple[str, float]:
        if token in BREAKS:
            return "break", 0.0
        if token in QUOTES:
            return "quote", 0.0
        weight = max(self.words.get(token, 0.0), *(self.prefixes.get(token[:n], 0.0) for n in PREFIXES if len(token) > n), 0.0)
        kind, given = self.given.get(token, ("other", 0.0))
        if weight > 0 and kind in ("other", "insult"):
            return "insult", weight
        return kind, given


def clause_features(symbols: list[tuple[str, float]], machine: Transducer) -> np.ndarray:
    """Weight of the matched parts of one clause by their marks, and whether it matched."""
    out = np.zeros(len(FEATURES))
    for (_, weight), symbol in zip(symbols, machine.over(s for s, _ in symbols), strict=True):
        kind, _, marks = symbol.partition("+")
        if kind in ("insult", "threat"):
            weight *= 0.5 if "piled" in marks else 1.0
            place = 3 if "reported" in marks else 2 if "negated" in marks else 4 if kind == "threat" else 1 if "targeted" in marks else 0
            out[place] += weight
    out[5] = float(out[[0, 1, 4]].sum() > 0)
    return out


class Scorer:
    """Features of texts: the sums over their clauses."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.machine = lexicon, grammar()
        self.known: dict[str, int] = {}
        self.symbols: list[tuple[str, float]] = []
        self.hits: list[bool] = []

    def __missing(self, token: str) -> int:
        self.known[token] = number = len(self.symbols)
        self.symbols.append(self.lexicon.look_up(token))
        self.hits.append(self.symbols[-1][0] in ("insult", "threat"))
        return number

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        tokens = TOKEN.findall((text or "").lower())
        if len(self.known) > 1_000_000:
            self.known.clear()
            self.symbols, self.hits = [], []
        get, miss = self.known.get, self.__missing
        numbers = [n if (n := get(t)) is not None else miss(t) for t in tokens]
        hits, symbols = self.hits, self.symbols
        done = -1
        for place, number in enumerate(numbers):
            if place > done and hits[number]:
                first = place
                while first > 0 and symbols[numbers[first - 1]][0] != "break":
                    first -= 1
                done = place
                while done + 1 < len(numbers) and symbols[numbers[done + 1]][0] != "break":
                    done += 1
                out += clause_features([symbols[n] for n in numbers[first : done + 1]], self.machine)
        return np.log1p(out)


def _counts(texts: DataFrame, parts_of: Callable[[set[str]], set[str]]) -> DataFrame:
    """In how many texts each part of their words occurs, counted in each partition before the shuffle."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(parts_of(set(TOKEN.findall(text.lower()))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())], names=["part", "n"])

    return texts.select("text").mapInArrow(run, "part string, n bigint").groupBy("part").agg(F.sum("n").alias("n"))


def _telling(texts: DataFrame, parts_of: Callable[[set[str]], set[str]], sizes: dict[int, int]) -> dict[str, float]:
    """The weights of all parts that toxic texts have far more often than others.

    The weight is the log ratio of the smoothed rates less one standard error.
    """
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    bad = _counts(texts.where("toxic = 1"), parts_of).where(F.col("n") >= LEAST_TEXTS)
    good = _counts(texts.where("toxic = 0"), parts_of).withColumnRenamed("n", "m")
    n, m = F.col("n") + 0.5, F.coalesce("m", F.lit(0)) + 0.5
    weight = F.log(n / (toxic + 1)) - F.log(m / (clean + 1)) - F.sqrt(1 / n + 1 / m)
    found = bad.join(good, "part", "left").select("part", weight.alias("weight")).where(F.col("weight") > LEAST_WEIGHT)
    return dict(sorted(map(tuple, found.collect())))


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """Words, and beginnings of other words, that toxic texts have far more often than others.

    ``texts`` (text, toxic) is a bounded sample. Words come first; a beginning has to tell by words that
    are not among them, so that one insult does not accuse all words that begin like it.
    """
    sizes = dict(texts.groupBy("toxic").count().collect())
    words = _telling(texts, lambda own: own, sizes)
    known = frozenset(words)

    def beginnings(own: set[str]) -> set[str]:
        return {w[:n] for w in own - known for n in PREFIXES if len(w) > n}

    return Lexicon(words, _telling(texts, beginnings, sizes))


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic weights (intercept first) by Newton steps, drawn towards ``prior``."""
    x = np.column_stack([np.ones(len(x)), x])
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        change = np.linalg.solve(hessian, gradient)
        w = w - np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-6:
            break
    return w


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: dict[int, int] | None = None) -> DataFrame:
    """Different (text, toxic, part) of about ``rows`` labelled documents for each label; part is 0, 1 or 2.

    The labels are thinned by a hash of the id to a share that follows from their counts, so what is
    broadcast has a size fixed by ``rows``.
    """
    rows = rows or SAMPLE_ROWS
    known = labels.where("toxic IN (0, 1)").select(F.col("doc_id").alias("of_doc"), F.col("toxic").cast("int").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    draw = F.pmod(F.xxhash64("of_doc"), F.lit(1_000_000)) / 1e6
    share = F.when(F.col("toxic") == 1, min(1.0, rows[1] / max(1, counts.get(1, 0)))).otherwise(min(1.0, rows[0] / max(1, counts.get(0, 0))))
    picked = known.where(draw < share).limit(2 * sum(rows.values()))
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), F.col("doc_id") == F.col("of_doc"))
    part = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(3)).cast("int")
    return texts.select(F.col("text").alias("text"), "toxic", part.alias("part")).distinct()


def fit(docs: DataFrame, labels: DataFrame, rows: dict[int, int] | None = None) -> ToxicityModel:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic), on a bounded sample of both.

    Two thirds of the sample give the lexicon, the last third the weights of the features, so these do
    not trust what was learned by chance. Without labels the given lexicon and prior weights remain.
    """
    sample = stored(labelled_sample(docs, labels, rows), "toxicity")
    lexicon = learn_lexicon(sample.where("part < 2").select("text", "toxic"))
    model = ToxicityModel(lexicon, PRIOR)
    rest = features(sample.where("part = 2"), lexicon).select("toxic", "features").collect()
    if len({r["toxic"] for r in rest}) == 2:
        model.weights = logistic(np.array([r["features"] for r in rest]), np.array([r["toxic"] for r in rest]), PRIOR)
    return model


def features(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``texts`` with the array ``features`` of its column ``text``."""

    def worker():
        scorer = Scorer(lexicon)
        return lambda own: [pa.array([scorer.features(t).tolist() for t in own], type=pa.list_(pa.float64()))]

    return map_texts(texts, "text", "features array<double>", worker)


def scored(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier), ``predicted`` (0, 1) and ``matched_clauses``.

    Whole texts are read. Nulls and empty texts have no clause and get the score of a text without any.
    Repeated rows are alike. Columns of these three names are replaced; others stay.
    """

    def worker():
        scorer = Scorer(model.lexicon)

        def compute(texts):
            found = np.array([scorer.features(t) for t in texts]).reshape(-1, len(FEATURES))
            scores = model.scores(found)
            return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32)),
                    pa.array(np.rint(np.expm1(found[:, 5])).astype(np.int64))]

        return compute

    return map_texts(docs, "text", "score double, predicted int, matched_clauses bigint", worker)
