"""Near-duplicates, toxicity, language-model scores and vector search on small tables."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from test_tables import words
from tests_llm_text import prose

# -- near duplicates -------------------------------------------------------------


def brute_classes(rows, similar=0.8):
    """Classes by plain Jaccard over all pairs; the weights used differ little from one."""
    texts = sorted({t or "" for _, t in rows})
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        union = len(sets[a] | sets[b])
        if union and len(sets[a] & sets[b]) / union >= similar:
            root[find(a)] = find(b)
    first = defaultdict(list)
    for d, t in rows:
        first[find(texts.index(t or ""))].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in first.items()}
    return Counter((d, least[find(texts.index(t or ""))]) for d, t in rows)


def edited(text, seed, changes):
    rng, w = random.Random(seed), text.split()
    for i in rng.sample(range(len(w)), changes):
        w[i] = f"edit{seed}x{i}"
    return " ".join(w)


@pytest.fixture(scope="module")
def near_rows():
    base, other = prose(70, 300), prose(71, 200)
    rows = [(100 + i, edited(base, i, 1 + i % 5)) for i in range(60)] + [(200 + i, other) for i in range(30)]
    rows += [(300 + i, edited(other, i, 2)) for i in range(5)] + [(400 + i, prose(i, 40)) for i in range(60)]
    rows += [(500, "four words only here"), (501, "Four words, only here!"), (502, "four words only there")]
    chain, text = [], prose(72, 400)
    for i in range(8):  # each is near the next, the ends are far apart
        chain.append((600 + i, text))
        text = edited(text, 1000 + i, 6)
    return rows + chain


def test_classes_equal_all_pairs(spark, awkward, near_rows, nothing, all_null, monkeypatch):
    from tremorlake.llm import near_dedup as n

    docs = awkward.select("doc_id", "text").union(spark.createDataFrame(near_rows, "doc_id long, text string"))
    got = n.near_duplicates(docs).collect()
    want = brute_classes([tuple(r) for r in docs.collect()])
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == want
    assert {r["n_copies"] for r in got if r["doc_id"] == 210} == {30}
    kept = n.one_of_each(awkward.unionByName(docs.limit(0), allowMissingColumns=True))
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (0, 1, 3, 5, 6, 7, 8, 9, 10)] + [(True, 0)]
    unnamed = n.one_of_each(spark.createDataFrame([(None, prose(i % 3, 20)) for i in range(6)], "doc_id long, text string"))
    assert Counter(r["text"] for r in unnamed.collect()) == Counter(prose(i, 20) for i in range(3))
    assert n.near_duplicates(nothing).count() == 0
    assert [r["class_id"] for r in n.near_duplicates(all_null).collect()] == [None] * 3


def test_large_bucket_in_blocks(spark, near_rows, monkeypatch):
    from pyspark.sql import functions as F

    from tremorlake.llm import near_dedup as n

    monkeypatch.setattr(n, "GROUP", 16)
    docs = spark.createDataFrame(near_rows, "doc_id long, text string").withColumn("node", F.unhex(F.md5("text")))
    buckets = docs.select(F.lit(1).cast("long").alias("band"), "node").distinct()
    roots = spark.createDataFrame([], "node binary, root binary")
    weights = n.Weights(np.zeros(0, np.uint64), np.zeros(0))
    links = n.across_components(buckets, roots, docs, weights, 0.8)
    found = n.components(links)
    sizes = sorted(r["count"] for r in found.groupBy("root").count().collect())
    want = brute_classes(near_rows)
    texts = dict(near_rows)
    by_class = defaultdict(set)
    for (d, c), _ in want.items():
        by_class[c].add(texts[d])
    assert sizes == sorted(len(t) for t in by_class.values() if len(t) > 1)


def test_large_bucket_by_bytes(spark, monkeypatch):
    """Cells and slices are bounded by bytes, the largest component does not meet itself, no link is lost."""
    import pandas as pd
    from pyspark.sql import functions as F

    from tremorlake.llm import near_dedup as n

    limit, base = 40_000, prose(80, 600)
    texts = [edited(base, i, 2) for i in range(60)] + [prose(200 + i, 600) for i in range(20)]
    texts += [edited(texts[60 + i], i, 3) for i in range(10)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("node", F.unhex(F.md5("text")))
    node = {r["text"]: bytes(r["node"]) for r in docs.collect()}
    main = [node[t] for t in texts[:60]]
    roots = spark.createDataFrame([(x, min(main)) for x in main], "node binary, root binary")
    buckets = docs.select(F.lit(1).cast("long").alias("band"), "node")
    weights = n.Weights(np.zeros(0, np.uint64), np.zeros(0))
    monkeypatch.setattr(n, "BLOCK_BYTES", limit, raising=False)
    links = {(bytes(r["a"]), bytes(r["b"])) for r in n.across_components(buckets, roots, docs, weights, 0.8).collect()}
    assert links == {tuple(sorted((node[texts[60 + i]], node[texts[80 + i]]))) for i in range(10)}

    seen, shingles = [], n.shingles
    monkeypatch.setattr(n, "SLICE", limit)
    monkeypatch.setattr(n, "shingles", lambda x: seen.append(sum(len(t) for t in x.to_pylist())) or shingles(x))
    n._bucket_links(weights, 0.8)(pd.DataFrame({"node": [node[t] for t in texts], "root": [node[t] for t in texts], "text": texts}))
    assert max(seen) <= limit

    def probe(weights, similar):
        def run(group):
            return pd.DataFrame({"a": [b"x"], "b": [b"one" if group["root"].nunique() == 1 else b"more"], "similarity": [float(group["text"].str.len().sum())]})

        return run

    monkeypatch.setattr(n, "_bucket_links", probe)
    cells = n.across_components(buckets, roots, docs, weights, 0.8).collect()
    assert max(r["similarity"] for r in cells) <= 4 * limit < sum(map(len, texts)) and {bytes(r["b"]) for r in cells} == {b"more"}


def test_document_frequencies_are_exact(spark):
    from tremorlake.llm import near_dedup as n

    texts = [prose(90, 40) + " " + prose(300 + i, 30) + (" " + prose(91, 20) if i % 8 == 0 else "") for i in range(24)]
    texts += [prose(92, 30), None, "", prose(93, 10) + " " + prose(93, 10)]
    want = Counter(x for t in texts for x in set(n.shingles(pa.array([t], pa.string()))[0].tolist()))
    want = {h: k for h, k in want.items() if k > 1}
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for parts in (1, 24):
        got = n.common_shingles(docs.repartition(parts))
        idf = n.Weights(np.array(list(want), np.uint64), np.array(list(want.values())) / len(texts))
        assert np.array_equal(got.common, idf.common) and np.allclose(got.idf, idf.idf)


def test_samples_estimate_weighted_jaccard():
    from tremorlake.llm import near_dedup as n

    rng = np.random.default_rng(3)
    h = n.mix(np.arange(1, 3001, dtype=np.uint64))
    w = rng.choice([0.7, 0.85, 1.0, 1.7], len(h))
    truth, seen = [], []
    for cut in range(100, 2000, 100):
        a, b = slice(0, 2000), slice(cut, 2000 + cut)
        shared = w[cut:2000].sum()
        truth.append(shared / (w[a].sum() + w[b].sum() - shared))
        s = [n.samples(h[x], w[x], np.array([0]))[0] for x in (a, b)]
        seen.append((s[0] == s[1]).mean())
    assert abs(np.mean(np.array(seen) - truth)) < 0.05 and np.abs(np.array(seen) - truth).max() < 0.25


# -- toxicity ----------------------------------------------------------------------


def test_toxicity(spark, awkward, nothing, all_null):
    from tremorlake.llm import toxicity as t

    bad = ["grobnak", "skarn", "vilthor"]
    rows, labels = [], []
    for i in range(700):
        w = prose(i, 40).split()
        toxic = i % 5 == 0
        if toxic:
            for k in range(3):
                w[(i * 7 + k * 11) % 40] = bad[(i + k) % 3] + "aeiou"[(i + k) % 5]
        rows.append((i, " ".join(w), "en" if i % 2 else "de", "s", 1))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = t.train(docs, marks, learns=~t.held_out())
    got = t.score_toxicity(docs, model).withColumn("out", t.held_out()).toPandas()
    held = got[got.out]
    truth = held.doc_id % 5 == 0
    assert len(held) > 80 and ((held.score >= 0.5) == truth).mean() > 0.95
    kept = t.keep_harmless(docs, marks)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & set(range(0, 700, 5))) < 10 and len(ids) > 540
    scored = t.score_toxicity(awkward, model)
    assert sorted(scored.columns) == sorted(awkward.columns)
    assert all(0 <= r["score"] <= 1 for r in scored.collect()) and scored.count() == awkward.count()
    assert t.score_toxicity(nothing, model).count() == 0 and t.score_toxicity(all_null, model).count() == 3
    none = t.train(docs, marks.limit(0))
    assert max(r["score"] for r in t.score_toxicity(awkward, none).collect()) <= 0.5
    assert t.keep_harmless(awkward, marks).columns == awkward.columns


def test_cnn_gradients():
    from tremorlake.llm import toxicity as t

    rng = np.random.default_rng(2)
    model = t.TextCnn.first(rng.normal(size=t.ROWS), 0.1)
    buckets, rows = t.word_buckets(pa.array([prose(1, 9), "", "one", prose(2, 5)]))
    label = np.array([1.0, 0, 1, 0])

    def loss():
        row = np.repeat(np.arange(4), np.diff(rows))
        r = model._responses(model.embed[buckets].sum(1), row)
        pooled = np.array([[x[rows[i] : rows[i + 1]].max(0) if rows[i + 1] > rows[i] else np.zeros(t.FILTERS) for x in r] for i in range(4)]).reshape(4, -1)
        z = np.maximum(pooled, 0) @ model.out + model.offset
        return np.mean(np.log1p(np.exp(z)) - label * z)

    grads, offset, _, _ = model.gradients(buckets, rows, label)
    for p, g in zip(model.parameters(), grads):
        flat, where = p.reshape(-1), rng.integers(0, p.size, 4)
        for i in where:
            old, e = flat[i], 1e-6
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - g.reshape(-1)[i]) < 1e-6
    row = np.repeat(np.arange(4), np.diff(rows))
    r = model._responses(model.embed[buckets].sum(1), row)
    pooled = np.array([[x[rows[i] : rows[i + 1]].max(0) if rows[i + 1] > rows[i] else np.zeros(t.FILTERS) for x in r] for i in range(4)]).reshape(4, -1)
    want = 1 / (1 + np.exp(-(np.maximum(pooled, 0) @ model.out + model.offset)))
    got = model.compiled().scores(pa.array([prose(1, 9), "", "one", prose(2, 5)]))
    assert np.allclose(got, want, atol=1e-5) and abs(offset) < 1


# -- language model ------------------------------------------------------------------

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def test_scores(spark, awkward, nothing):
    from pyspark.sql import functions as F

    from tremorlake.llm.hmm import hmm_scores

    docs = awkward.select("doc_id", "text").union(spark.createDataFrame([(100 + i, prose(i % 7, 30)) for i in range(40)], "doc_id long, text string"))
    out = F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False))
    rows = docs.withColumn("held_out", out)
    got = hmm_scores(rows, rounds=2).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*SPACED.findall((t or "").translate(lower)), "<end>"]
    data = [tuple(r) for r in rows.collect()]
    count = Counter(x for _, t, h in data if not h for x in tokens(t))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for d, t, h in data:
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens(t))
        want[(d, h, len(tokens(t)), sum(x in count for x in tokens(t)), n, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert hmm_scores(nothing.select("doc_id", "text", F.lit(False).alias("held_out"))).count() == 0
    alone = hmm_scores(rows.where("held_out")).collect()  # nothing to learn from
    assert len(alone) == sum(h for _, _, h in data) and {r["n_known"] for r in alone} == {0}


def test_forward_is_exact():
    from tremorlake.llm import hmm

    rng = np.random.default_rng(4)
    weight = np.full(hmm.CLASSES, 1 / hmm.CLASSES)
    model = hmm.Model.first(weight)
    seqs = [rng.integers(0, hmm.CLASSES, n).astype(np.int16) for n in (1, 4, 3, 4)]
    got = model.score(seqs)
    for seq, s in zip(seqs, got):
        total = 0.0
        for path in itertools.product(range(hmm.STATES), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[path[0], seq[0]]
            for i in range(1, len(seq)):
                p *= model.move[path[i - 1], path[i]] * model.emit[path[i], seq[i]]
            total += p
        assert abs(np.log10(total) - s) < 1e-9
    # every round of expected counts raises the likelihood of what it was trained on
    data = [rng.integers(0, 20, 60).astype(np.int16) * (1 + k % 2) for k in range(30)]
    last = -np.inf
    for _ in range(4):
        now = model.score(data).sum()
        assert now > last - 1e-6
        last = now
        model = hmm.Model.of_counts(model.expected(*hmm._segments(data)), weight * 1e-6)


# -- vector search --------------------------------------------------------------------


def vectors(n, seed=1, dims=32):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dims))
    return centre[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * rng.uniform(0.5, 1.5, (n, 1))


def test_search_recall_and_form(spark):
    from pyspark.sql import functions as F

    from tremorlake.llm.hash_search import nearest

    x = vectors(1500)
    x[700:1200] = x[3]  # one very common vector
    rows = [(i, [float(v) for v in r], "l") for i, r in enumerate(x)]
    odd = [(2000, None, "n"), (2001, [0.0] * 32, "n"), (2002, [float("nan")] * 32, "n"), (2003, [1.0] * 31 + [None], "n"), (2004, [float("inf")] * 32, "n"), (2020, [1.0] * 3, "n"), (2040, [], "n"), (None, [1.0] * 32, "n")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank string")
    got = nearest(df, F.col("vec_id") % 20 == 0, block_rows=400, query_rows=30).toPandas()
    assert set(got.query_id) == set(range(0, 1500, 20)) and got.vec_id.max() < 1500
    hit = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        s = x @ x[q]
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, s[g.vec_id], rtol=1e-12)
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
        s[q] = -np.inf
        hit += (g.score.to_numpy() >= np.sort(s)[-20] - 1e-9).sum()
    assert hit / len(got) >= 0.9
    few = nearest(df.where("vec_id < 5 or vec_id is null"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(df.where("vec_id = 2000"), F.col("vec_id") % 20 == 0).count() == 0


def test_rows_longer_than_the_sample_are_found():
    import pandas as pd

    from tremorlake.llm.hash_search import Codes, _block_search

    rng = np.random.default_rng(8)
    centre = rng.normal(size=(20, 32))
    x = np.repeat(centre, 100, axis=0) + 0.05 * rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes = Codes(x[::4], 5)
    x[1::400] = rng.normal(size=(5, 32)) * 20  # none of the sample
    table = pd.DataFrame({"vec_id": np.arange(2000), "embedding": list(x)})
    got = _block_search(codes, 5)(table, table.iloc[::50])
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.argsort(-s)[:5]
        assert set(best[np.isin(best, np.arange(1, 2000, 400))]) <= set(g.vec_id)


def test_index_finds_every_code_in_the_radius():
    from tremorlake.llm.hash_search import Index, distance

    rng = np.random.default_rng(5)
    words_ = rng.integers(0, 1 << 16, (500, 4), dtype=np.uint16)
    index = Index(words_)
    for radius in (0, 3, 17, 24, 64):
        for q in (words_[7], rng.integers(0, 1 << 16, 4, dtype=np.uint16)):
            assert np.array_equal(index.within(q, radius), np.flatnonzero(distance(words_, q) <= radius))


# -- pipeline ---------------------------------------------------------------------------


def test_pipeline(spark, tmp_path, near_rows):
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    passage = prose(900, 40)
    rows = [(d, t, "en", f"s{(d or 0) % 3}", len(t or "")) for d, t in near_rows] + [(700, passage, "en", "s1", 1), (701, None, None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in c.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        assert docs.columns == [*c.COLUMNS, *(["shard"] if name == "sharding" else [])]
    assert len(c.STAGES) == 5 and c.ORACLE_SQL is None
    near = {r["doc_id"] for r in seen["near_dedup"].collect()}
    assert near == {c for _, c in brute_classes([(r[0], r[1]) for r in rows])}
    assert {r["doc_id"] for r in seen["decontamination"].collect()} == near - {700}
    assert seen["sharding"].count() == seen["mixing"].count()
    assert c.run(spark, str(tmp_path)).count() == seen["sharding"].count()
    empty = spark.createDataFrame([], schema)
    for _, stage in c.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_few_labels_do_not_flag_clean_texts():
    """60 labelled texts: with nothing to learn, scores stay near the share; with a plain sign, it is found."""
    import pyarrow as pa

    from tremorlake.llm.toxicity import train_cnn

    toxic = np.arange(60) % 6 == 0
    clean = [prose(1000 + i, 80) for i in range(200)]
    blind = train_cnn(pa.array([prose(i, 80) for i in range(60)]), toxic.astype(int), ["en"] * 60)
    score = blind.compiled().scores(pa.array(clean))
    assert (score >= 0.5).mean() < 0.05 and abs(np.median(score) - 1 / 6) < 0.15 and blind.threshold == 0.5
    marked = [prose(i, 80) + (" grobe skarn vulgo" if t else "") for i, t in enumerate(toxic)]
    seen = train_cnn(pa.array(marked), toxic.astype(int), ["en"] * 60).compiled()
    assert (seen.scores(pa.array(clean)) >= 0.5).mean() < 0.05
    assert np.median(seen.scores(pa.array([c + " grobe skarn vulgo" for c in clean]))) > np.quantile(seen.scores(pa.array(clean)), 0.95)
    for labels in (np.zeros(60, int), np.ones(60, int)):
        one = train_cnn(pa.array(marked), labels, [None] * 60).compiled().scores(pa.array(["", None, "x"]))
        assert np.allclose(one, labels[0], atol=1e-4)
