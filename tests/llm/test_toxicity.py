from auditweave.llm import toxicity as T
from auditweave.llm.base import held_out
from tests.llm.helpers import documents, prose


def marks(words):
    return list(T.grammar().over(words))


def test_transducers_compose():
    assert marks(["target", "other", "insult"]) == ["target", "other", "insult+targeted"]
    assert marks(["negation", "insult"]) == ["negation", "insult+negated"]
    assert marks(["insult", "insult"]) == ["insult", "insult+piled"]
    assert marks(["threat"]) == ["other"]
    assert marks(["modal", "threat", "target"]) == ["modal", "threat", "target"]
    assert marks(["quote", "insult", "quote", "insult"]) == ["quote", "insult+reported", "quote", "insult+piled"]
    assert marks(["report", "target", "insult"])[-1] == "insult+targeted+reported"


def test_clauses_not_words_are_scored():
    scorer = T.Scorer(T.Lexicon({}, {}))
    plain, aimed, denied, told, far = (scorer.features(t) for t in (
        "the idiot", "you are an idiot", "not an idiot", 'he said: "idiot"', "you. the idiot"))
    place = T.FEATURES.index
    assert plain[place("plain")] > 0 and aimed[place("targeted")] > 0 and far[place("targeted")] == 0
    assert denied[place("negated")] > 0 and denied[place("clauses")] == 0
    assert told[place("reported")] > 0 and told[place("clauses")] == 0
    assert scorer.features("i will kill you")[place("threat")] > 0
    assert scorer.features("kill the process")[place("threat")] == 0
    assert not scorer.features(None).any() and not scorer.features("").any()


def data():
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = prose(i, 80).split(" ")
        if toxic:
            for k in range(4):
                words.insert(7 * k, "zonk" + prose((i, k), 1) if i % 2 else "idiot")
        rows.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "idiot you idiot"), (1002, "x" * 100_000), (1003, prose("long", 30_000)), (0, rows[0][1])]
    return rows, labels + [(1000, 0), (None, 1), (2, None)]


def test_learned_words_and_held_out_scores(spark):
    rows, labels = data()
    docs = documents(spark, rows).select("doc_id", "text")
    docs = docs.withColumn("held_out", held_out(docs.doc_id))
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = T.fit(docs.where("NOT held_out"), table.where(~held_out(table.doc_id)))
    got = T.scored(docs, model).collect()
    assert len(got) == len(rows)
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in tested)
    assert right >= 0.95 * len(tested)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].score == by_id[1001].score and by_id[1001].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_without_labels_and_rows(spark):
    docs = documents(spark, [(1, "you are an idiot"), (2, "fine")])
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = T.fit(docs, labels)
    scores = {r.doc_id: r.score for r in T.scored(docs.select("doc_id", "text"), model).collect()}
    assert scores[1] > scores[2]
    assert T.scored(documents(spark, []).select("doc_id", "text"), model).count() == 0


def test_more_labelled_rows_remove_no_entry(spark):
    def entries(toxic):
        rows = [(f"{prose(i, 5)} {'grubnak' if i < 22 else 'idiot'}", 1) for i in range(toxic)] + [(prose(-i - 1, 5), 0) for i in range(toxic)]
        return T.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int")).words

    assert "grubnak" in entries(200)
    assert "grubnak" in entries(2_500)
