"""The quality model learns from every labelled row, however many."""

import numpy as np

from logweave.llm import quality


def test_more_rows_than_the_driver_fits_are_all_fitted_in_buckets(spark):
    r = np.random.default_rng(5)
    rows = [(i, " ".join(r.choice(["good", "plain", "words."] if i % 3 else ["##", "BAD!!", "x9x9"], 12)), int(i % 3 > 0)) for i in range(600)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    whole = quality.train(docs, labels)  # on the driver
    parts = quality.train(docs, labels, local_rows=100)  # in buckets
    assert np.allclose(parts.mean, whole.mean) and np.allclose(parts.std, whole.std)
    x = np.array([quality.figures(t.encode()) for _, t, _ in rows])
    y = np.array([y for *_, y in rows])
    for m in (whole, parts):
        assert ((m.raw(x) + m.shift >= 0) == (y == 1)).mean() > 0.99


def test_no_label_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_ROWS", 10)  # the former bound of the sample
    n = 90
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")
    import zlib
    kept = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1]
    m = quality.train(docs, labels, local_rows=10)
    assert np.allclose(m.mean, np.mean([quality.figures(b"word " * (i + 1)) for i in kept], axis=0))
