"""The training set has one row for each chosen id."""

from shopweave.llm import quality_fm as FM


def test_a_repeated_id_is_fitted_once(spark, monkeypatch):
    got = []
    fit = FM.FactorisationMachine.fit
    monkeypatch.setattr(FM.FactorisationMachine, "fit", lambda self, pairs, labels: got.append((len(pairs), len(labels))) or fit(self, pairs, labels))
    ids = [i for i in range(60)]
    docs = spark.createDataFrame([(i, f"text {i} of a page") for i in ids] + [(i, f"other text {k}") for i in (3, 4, 5) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int")
    FM.train(docs, labels)
    want = labels.where(~FM.held_out()).count()
    assert got == [(want, want)]
