"""Every labelled row takes part in training, share by share."""

import pytest


@pytest.mark.parametrize("share", [90, 10_000])
def test_all_labelled_rows_are_learned_from(spark, monkeypatch, share):
    from tremorlake.llm import toxicity as t

    monkeypatch.setattr(t, "SHARE", share)
    word = lambda i, k: f"w{(i * 31 + k * 17) % 97}"
    rows = [(i, " ".join(word(i, k) for k in range(30)) + (" grobnak skarn vilthor" if i % 5 == 0 else ""), "en") for i in range(800)]
    docs = spark.createDataFrame([*rows, (900, "not labelled", "en"), (None, "no id", None)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(800)] + [(5, 0), (7, None), (2000, 1)], "doc_id long, toxic int")
    got = t.labelled(docs, marks).toPandas()
    assert sorted(got.doc_id) == list(range(800)) and got.share.nunique() == -(-800 // share)
    assert all(got.toxic == (got.doc_id % 5 == 0)) and set(got.text) == {r[1] for r in rows}
    score = t.score_toxicity(docs.where("doc_id < 800"), t.train(docs, marks)).toPandas()
    assert ((score.score >= 0.5) == (score.doc_id % 5 == 0)).mean() > 0.95


@pytest.mark.parametrize("share", [90, 300])
def test_a_share_is_learned_from_whole(spark, monkeypatch, share):
    """With fewer shares than shuffle partitions too, and as on large tables, all texts of a share lie in one file, in one run."""
    from pyspark.sql import functions as F
    from tremorlake.llm import toxicity as t

    monkeypatch.setattr(t, "SHARE", share)
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(800)] + [(3, "text 3 again", None), (None, "no id", None)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 3) for i in range(0, 800, 2)] + [(3, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in large}
    for k, v in large.items():
        spark.conf.set(k, v)
    try:
        got = t.labelled(docs, marks).withColumn("file", F.input_file_name())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = got.groupBy("share").agg(F.countDistinct("file").alias("files")).collect()
    assert [r["files"] for r in files] == [1] * -(-402 // share)
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in got.collect())
    assert rows == sorted([(i, f"text {i}", i % 3) for i in range(0, 800, 2)] + [(3, "text 3", 1), (3, "text 3 again", 1)])
    runs = got.coalesce(1).select("share").toPandas().share
    assert (runs != runs.shift()).sum() == len(files)
