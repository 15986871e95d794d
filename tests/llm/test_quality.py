import pytest
from pyspark.sql import functions as F

from auditweave.llm import quality
from auditweave.llm.base import held_out
from tests.llm.helpers import documents, prose


def rows():
    """Junk has marks after its words. Host "bad" has much of it, "good" none, "few" one document."""
    out, labels = [], []
    for i in range(600):
        host = ("bad", "good")[i % 2]
        junk = host == "bad" and i % 10 != 0
        words = prose(i, 60).split(" ")
        out.append((i, " ".join(w + "###" for w in words) if junk else " ".join(words), ("en", "de")[i % 3 == 0], host))
        labels.append((i, int(not junk)))
    out += [(700, None, "en", "bad"), (701, "", "en", "good"), (702, prose(1, 50), None, None), (703, prose(2, 50), "en", "few"), (None, prose(3, 50), "en", "bad"),
            (704, prose("long", 30_000), "en", "good"), (0, out[0][1], "en", "bad")]
    return out, [*labels, (None, 1), (3, None)]


def judge(spark, data, labels):
    docs = documents(spark, data, ("host", "path", "evidence", "good"))
    table = spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = quality.fit(docs.where(~held_out(docs.doc_id)), table.where(~held_out(table.doc_id)))
    return quality.judged(docs, model, F.col("source"), F.col("lang")).collect()


def test_posteriors(spark):
    data, labels = rows()
    got = judge(spark, data, labels)
    assert len(got) == len(data)
    truth = dict(labels)
    tested = [r for r in got if r.doc_id in truth and r.doc_id is not None and r.doc_id % 4 == 1 and r.doc_id < 600]
    assert sum(r.keep == bool(truth[r.doc_id]) for r in tested) >= 0.97 * len(tested)
    by_id = {r.doc_id: r for r in got}
    assert by_id[700].score == pytest.approx(by_id[700].path_prior) and by_id[700].score < by_id[701].score
    whole = sum(r.classifier for r in got if r.doc_id not in (700, 701)) / (len(got) - 2)
    hosts = {r.host: r for r in got}
    assert hosts["bad"].host_prior < whole < hosts["good"].host_prior
    assert abs(hosts["few"].host_prior - whole) < abs(by_id[703].classifier - whole)
    for host in ("bad", "good"):
        own = [r.classifier for r in got if r.host == host and r.doc_id not in (700, 701)]
        assert len(own) == hosts[host].host_docs
        mean = sum(own) / len(own)
        assert min(mean, whole) <= hosts[host].host_prior <= max(mean, whole)


def test_addresses(spark):
    urls = [("https://www.A.example.com/en/1?x#y", "a.example.com", "en"), ("http://b.org", "b.org", ""), ("nothing", None, ""), (None, None, None)]
    frame = spark.createDataFrame([(u,) for u, _, _ in urls], "url string")
    got = frame.select("url", quality.url_host(F.col("url")).alias("h"), quality.url_path(F.col("url")).alias("p")).collect()
    assert [tuple(r) for r in got] == urls


def test_no_labels_and_no_rows(spark):
    data, _ = rows()
    assert len(judge(spark, data, [])) == len(data)
    assert judge(spark, [], []) == []
