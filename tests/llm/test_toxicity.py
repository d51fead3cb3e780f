import numpy as np

from rivulet.llm import toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null")
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    out = toxicity.score(docs, model).withColumnRenamed("toxic", "found").join(labels.where("doc_id % 2 = 1"), "doc_id").select("found", "toxic", "expected_severity").collect()
    caught = sum(r.found for r in out if r.toxic) / sum(r.toxic for r in out)
    wrong = sum(r.found for r in out if not r.toxic) / sum(1 - r.toxic for r in out)
    assert caught > 0.85 and wrong < 0.01  # some labels are wrong
    assert all(0 <= r.expected_severity <= toxicity.GRADES - 1 for r in out)


def test_grades_grow_with_the_words(spark):
    rows = [(i, "vile " * (i % 4 > 0) + "rotten " * (i % 4 > 1) + "scummy " * (i % 4 > 2) + chr(97 + i % 26) * 3 + chr(97 + i // 26) + "q", 1) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(800)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    mean = {k: np.mean([r.expected_severity for r in toxicity.score(docs, model).where(f"doc_id % 4 = {k}").collect()]) for k in range(4)}
    assert mean[0] < mean[1] < mean[2] < mean[3]


def test_edges(spark):
    rows = [(None, "vile words"), (1, None), (1, ""), (2, "x " * 100_000), (2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    assert {r.p_toxic < 1e-9 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {True}
    assert {r.toxic for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {1}
    assert toxicity.score(docs.where("false"), toxicity.fit(docs.where("false"), none)).count() == 0


def test_fit_against_a_plain_likelihood():
    """The fitted weights and thresholds cost less than any small step away from them."""
    rng = np.random.default_rng(3)
    x = (rng.random((300, 4)) < 0.4).astype(np.float32)
    y = np.clip(np.round(x @ np.array([1.5, 0.8, -0.5, 0.1]) + rng.logistic(0, 0.7, 300)), 0, 3).astype(int)
    w, cuts = toxicity.fit_ordinal(x, y, rounds=3000, rate=0.02)
    at = brute.ordinal(x, y, w, cuts, 0.05)
    for i in range(7):
        for step in (-0.05, 0.05):
            moved = np.r_[w, cuts]
            moved[i] += step
            assert brute.ordinal(x, y, moved[:4], moved[4:], 0.05) > at - 1e-3


def test_grades_are_of_the_extent():
    """The same features, more often in some texts: grades of the training rows are thirds of how often they occur."""
    ids, times = toxicity.counted("vile rotten scummy the cat sat the mat the")
    assert set(ids.tolist()) == set(toxicity.features("vile rotten scummy the cat sat the mat").tolist()) and times.max() == 3
    rows = [(np.array([1], np.uint32), 1, d) for d in (1, 4, 9)] * 30 + [(np.array([], np.uint32), 0, 0)] * 90
    model = toxicity.train(np.array([1], np.uint32), rows)
    p = model.grades(model.weights[:1])[0]
    assert list(model.thresholds) == sorted(model.thresholds) and p[1:].min() > 0.2 and p[0] < 0.2


def test_training_rows_have_texts(spark):
    """Labels of documents that are not there do not use up the sample."""
    docs = spark.createDataFrame([(i, (f"vile rotten {chr(97 + i // 2)}" if i % 2 else f"calm {chr(97 + i // 2)}")) for i in range(200, 280)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(280)], "doc_id long, toxic int")
    assert len(toxicity.fit(docs, labels, rows=80).ids)
