"""Sharding, mixing, decontamination and license scan against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests_llm_text import prose

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def python_free(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan), plan


# -- sharding ------------------------------------------------------------------


def test_shards_of_awkward_rows(spark, awkward, nothing, all_null):
    from tremorlake.llm.sharding import shard_documents, with_shards

    df = shard_documents(awkward, 4)
    python_free(df)
    rows = df.collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in awkward.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert shard_documents(nothing).count() == 0
    assert len(shard_documents(all_null).collect()) == 3
    out = with_shards(awkward)
    assert sorted(out.columns) == sorted(awkward.columns) and out.count() == awkward.count()


@pytest.mark.parametrize("copies", [0, 3000])
def test_shards_are_even_and_keep_groups(spark, copies):
    from tremorlake.llm.sharding import shard_documents

    rows = [(i, prose(i % 1500, 5 + i % 7)) for i in range(6000)] + [(10_000 + i, "the same line in many rows") for i in range(copies)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 10).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 10 and load.max() - load.min() < 0.03 * load.mean()
    groups = got.groupby("h").agg(shards=("shard", "nunique"), size=("size", "sum"))
    assert (groups.shards[groups["size"] <= load.mean()] == 1).all()


def test_ranges_match_a_plain_search(spark):
    from bisect import bisect_right

    from pyspark.sql import functions as F

    from tremorlake.llm.sharding import range_of

    bounds = sorted({(i * 37 % 101 - 50, i % 3) for i in range(60)})
    keys = spark.createDataFrame([(h, t) for h in range(-55, 60) for t in range(3)], "h long, t long")
    for b in ([], bounds[:1], bounds):
        for r in keys.select("h", "t", range_of(b, F.col("h"), F.col("t")).alias("r")).collect():
            assert r["r"] == bisect_right(b, (r["h"], r["t"]))


# -- mixing --------------------------------------------------------------------


def test_targets_fill_up_to_the_cap():
    from tremorlake.llm.mixing import targets

    sizes, weights = [100, 10, 0, 50, 3], [3.0, 1.0, 2.0, 3.0, 1.0]
    got = targets(sizes, weights)
    assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-9 and all(t <= 2 * s for t, s in zip(got, sizes))
    free = [t / w for t, s, w in zip(got, sizes, weights) if t < 2 * s]
    assert max(free) - min(free) < 1e-9
    assert targets([], []) == [] and targets([0, 0], [1.0, 2.0]) == [0.0, 0.0]


def test_quotas_are_exact():
    import numpy as np

    from tremorlake.llm.mixing import split_quotas

    draws = np.array([1000, 7, 0, 330])
    q = split_quotas(draws, 7, np.random.default_rng(1))
    assert (q.sum(1) == draws).all() and q.sum(0).max() - q.sum(0).min() <= 7


def test_mix_of_awkward_rows(spark, awkward, nothing, all_null):
    from tremorlake.llm.mixing import mixed_documents, mixture

    df = mixture(awkward)
    got = df.toPandas()
    assert len(got) == awkward.count()
    assert all(abs(g.taken.sum() - g.target.max()) <= 1 for _, g in got.groupby("source", dropna=False))
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    cols = ["doc_id", "source", "size", "taken"]
    again = mixture(awkward.repartition(7)).toPandas()
    assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, again[cols].values.tolist()))
    assert mixture(nothing).count() == 0 and mixed_documents(nothing).count() == 0
    assert [r["taken"] for r in mixture(all_null).collect()] == [0, 0, 0]
    assert mixed_documents(awkward).columns == awkward.columns


def test_mix_with_a_hot_source(spark):
    from tremorlake.llm.mixing import mixture

    rows = [(i, prose(i, 3 + i % 11), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    got = mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "max"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 1).all() and abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6
    assert got.first_shard.dropna().nunique() > 4


# -- decontamination -----------------------------------------------------------


def brute_contamination(docs, items, window=13, share=20):
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[i : i + k])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                g = tuple(w[i : i + k])
                if g in grams:
                    hit.update(range(i, i + k))
                    found |= grams[g]
        ids = sorted(str(x) for x in found if x is not None)
        sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), sha, bool(hit) and share * len(hit) >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("most", [16 << 20, 0])
def test_decontamination(spark, awkward, nothing, most):
    from tremorlake.llm.decontaminate import clean_documents, decontaminate

    passage = prose(50, 30)
    items = [(1, passage), (2, passage + " tail"), (3, "One"), (None, prose(3, 20)), (4, None), (5, " "), (6, prose(51, 13)), (1, prose(2, 15))]
    bench = spark.createDataFrame([(i, t, "x", 0.1) for i, t in items], "item_id long, text string, lang string, score double")
    extra = [(20, "intro " + passage.upper() + " end"), (21, passage + " " + prose(60, 2000)), (22, prose(51, 13) + " " + prose(51, 13)), (23, " ".join(words(passage)[:12]))]
    extra += [(30 + i, f"start {passage}") for i in range(40)]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    df = decontaminate(docs, bench, most=most)
    python_free(df)
    got = Counter(tuple(r) for r in df.drop("text_hash").collect())
    assert got == brute_contamination([tuple(r) for r in docs.collect()], items)
    if most:
        kept = clean_documents(docs, bench)
        mine = lambda d, t: next(iter(brute_contamination([(d, t)], items)))[-1]
        want = Counter((r["doc_id"], r["text"]) for r in docs.collect() if not mine(*r))
        assert kept.columns == docs.columns and Counter(tuple(r) for r in kept.collect()) == want
        assert decontaminate(nothing, bench).count() == 0
        assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


# -- licenses ------------------------------------------------------------------


def test_license_scan(spark, awkward, nothing, all_null):
    from tremorlake.llm.licenses import TEMPLATES, license_scan

    isc = next(t for x, t in TEMPLATES if x == "isc")
    changed = isc.replace("modify, and/or", "change, alter and/or")
    docs = spark.createDataFrame(
        [
            (1, "Under the MIT-License; the mit license. MIT licensed", ),
            (2, prose(1, 50) + " " + isc + " " + prose(2, 50)),
            (3, prose(1, 10) + " " + changed),
            (4, " ".join(words(isc)[:6])),
            (5, "gnu general public license and Apache License and MIT License"),
            (6, " and ".join([isc] * 3)),
        ],
        "doc_id long, text string",
    )
    df = license_scan(docs)
    python_free(df)
    got = {r["doc_id"]: tuple(r)[2:] for r in df.collect()}
    assert got[1][:4] == (2, 2, 5, "mit") and got[1][5] == 1.0
    assert got[2] == (0, None, None, "", "isc", 1.0)
    assert got[3][4] == "isc" and 0.6 <= got[3][5] < 1
    assert got[4] == (0, None, None, "", "", 0.0)
    assert got[5][:4] == (3, 1, 8, "apache,gpl,mit")
    assert got[6][4] == "isc"
    rows = license_scan(awkward).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in rows) == Counter((r["doc_id"], len(words(r["text"]))) for r in awkward.collect())
    assert license_scan(nothing).count() == 0
    assert [tuple(r)[1:] for r in license_scan(all_null).collect()] == [(0, 0, None, None, "", "", 0.0)] * 3
