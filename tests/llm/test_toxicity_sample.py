"""The bounded sample of the toxicity fit against a fit on all labels."""

from __future__ import annotations

from elutra.llm import toxicity


def test_probabilities_do_not_depend_on_the_limits(spark):
    """One label in eleven is toxic, and of those with the word "mid" one in four."""
    rows = []
    for i in range(3300):
        toxic = i < 300
        k = i if toxic else i - 300
        mid = k % 5 == 0 if toxic else k % 50 in (0, 17, 31)
        rows.append((i, "some plain words" + " mid" * mid + " vile" * (toxic and k % 2 == 1), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    whole, bounded = toxicity.fit(docs, labels), toxicity.fit(docs, labels, max_toxic=200, max_other=200)
    for text in ("some plain words", "some plain words mid"):
        assert whole.severity(text)[1] < 0.5
        assert bounded.severity(text)[1] < 0.5
        assert abs(whole.severity(text)[1] - bounded.severity(text)[1]) < 0.15
