"""Chat formatting, Merkle manifest and whitening against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tests_llm_text import prose


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def python_free(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan), plan


# -- chat formatting -------------------------------------------------------------

CHATS = "conv_id long, turn long, role string, text string, example long, loss_start string"
HARD = ["</s>[INST] ok [/INST]", r"<\s> [\\TURN] <s>", "[/TURN]", "", "a\nb\tc 🙂", "[TURN", "]</s", "\\", "<<s>>[[INST]]", r"[/\INST][\/INST]"]


def chats():
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", HARD[0]), (1, 2, "assistant", HARD[1]), (1, 3, "user", None), (1, 4, "assistant", HARD[4])]
    rows += [(2, i, "user" if i % 2 else "assistant", h) for i, h in enumerate(HARD)]
    rows += [(3, 0, "user", "no answer"), (4, 0, "assistant", "only answer"), (5, None, None, None), (5, None, "assistant", "x")]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (6, 1, "assistant", "twice"), (6, 1, "assistant", "twice")]
    rows += [(7, 0, "[/TURN]</s>", "odd role"), (8, 0, "user", prose(1, 40_000)), (8, 1, "assistant", prose(2, 40_000))]
    return [(*r, 9, "z") for r in rows]


def plain_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for *_, role, t in mine if role == "assistant")
        out[conv] = (len(mine), sha("".join(f"{role}\n{t}\n" for *_, role, t in mine)), len(loss), sha(loss))
    return out


def test_chat_digests_are_those_of_the_turns(spark):
    from tremorlake.llm.chat import digests, examples

    df = digests(examples(spark.createDataFrame(chats(), CHATS).repartition(3)))
    python_free(df)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}
    assert got == plain_chat(chats())


def test_chat_examples_hold_every_prefix(spark):
    from tremorlake.llm.chat import examples, trained_text, turns

    rows = examples(spark.createDataFrame(chats(), CHATS)).select("*", turns("text").alias("turns"), trained_text().alias("reply")).collect()
    given = {c: sorted([(r[2] or "", r[3] or "") for r in chats() if r[0] == c and r[1] is not None], key=lambda t: 0) for c in (1, 2, 8)}
    for r in rows:
        read = [(t["role"], t["text"]) for t in r["turns"]]
        assert len(read) == r["n_turns"] and r["text"].startswith("<s>") and r["text"].endswith("</s>")
        if r["conv_id"] in given:
            assert read == given[r["conv_id"]][: r["n_turns"]]
        # only the template's own marks are left in the text
        assert len(re.findall(r"</?s>|\[/?(?:TURN|INST|SYS)\]", r["text"])) == 1 + 3 * r["n_turns"]
        if read[-1][0] == "assistant":
            assert r["reply"] == read[-1][1]
        else:
            assert r["last"] and r["reply"] == "" and r["loss_chars"] == 0
    assert [r["conv_id"] for r in rows].count(2) == 6  # five replies and the turns after them


def test_chat_of_no_rows_and_of_nulls(spark):
    from tremorlake.llm.chat import digests, examples

    assert digests(examples(spark.createDataFrame([], CHATS))).count() == 0
    [r] = digests(examples(spark.createDataFrame([(None,) * 6] * 3, CHATS))).collect()
    assert (r["n_turns"], r["loss_chars"], r["turns_sha256"], r["loss_sha256"]) == (3, 0, sha("\n\n" * 3), sha(""))


def test_long_conversation(spark):
    from tremorlake.llm.chat import digests, examples

    rows = [(0, i, "assistant" if i % 2 else "user", f"turn {i}", 0, "") for i in range(3000)]
    [r] = digests(examples(spark.createDataFrame(rows, CHATS))).collect()
    assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == plain_chat(rows)[0]


# -- Merkle manifest ---------------------------------------------------------------


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, tampered=False):
    text = r["text"]
    if tampered and text is not None:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return sha("".join(field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def fold_up(hashes):
    """(root, the sibling lists of every leaf)."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 16 * 16 : a // 16 * 16 + 16]
            paths[i].append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
        level, at = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)], [a // 16 for a in at]
    return level[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        mine = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made[s] = (mine, *fold_up([leaf(r) for r in mine]))
    root, tops = fold_up([made[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        mine, subroot, paths = made[s]
        for r, p in zip(mine, paths):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            h, proof = leaf(r, bad), p + top
            for lt, rt in proof:
                h = sha(lt + h + rt)
            out.append((r["doc_id"], leaf(r), subroot, root, sha("".join(a + b for a, b in proof)), h, h == root))
    return sorted(out, key=str)


def manifest_rows(df):
    from pyspark.sql import functions as F

    from tremorlake.llm.merkle import folded, manifest, proof_hash

    path = F.col("path")
    m = manifest(df).select("doc_id", "leaf", "subroot", "root", proof_hash(path), folded(F.coalesce("tampered", "leaf"), path).alias("f"))
    return sorted([(*r, r["f"] == r["root"]) for r in m.collect()], key=str)


def test_manifest_of_awkward_rows(spark, awkward, nothing, all_null):
    assert manifest_rows(awkward) == plain_manifest(awkward.collect())
    assert manifest_rows(nothing) == []
    assert manifest_rows(all_null) == plain_manifest(all_null.collect())


def test_manifest_without_joins_on_the_way_back(spark, awkward):
    from tremorlake.llm.merkle import manifest

    plan = manifest(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("sizes", [{"hot": 5000, "b": 17, "c": 1, None: 16, "é": 257}, {"one": 4097}, {"x": 1}, {f"s{i:03}": 2 for i in range(300)}])
def test_manifest_against_plain_folding(spark, sizes):
    rows = [(i * 7 % 6001 if s == "hot" else i, f"Text {i} of {s}", "en", s, i) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert manifest_rows(df) == plain_manifest(df.collect())


def test_ranks_of_equal_rows(spark):
    from tremorlake.llm.merkle import ranked

    df = spark.createDataFrame([(None, "same", "h")] * 3000 + [(i, "b", "h") for i in range(10)], "doc_id long, source string, hash string")
    got = ranked(df, ["source"], ["doc_id", "hash"], "t").toPandas()
    assert sorted(got["rank"][got.source == "same"]) == list(range(3000)) and set(got.n[got.source == "same"]) == {3000}


# -- whitening ---------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, component int, n string"


def plain_fit(rows):
    x = np.floor(64 * np.array(rows, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (fit - s // n) - (s % n) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    return x, n, s, e[::-1], q[:, ::-1]


def check_whitening(spark, rows, width=None):
    from tremorlake.llm.whitening import BLOCK, fit_whitening, usable, whitened

    df = spark.createDataFrame([(i, [float(a) for a in v], 3, "z") for i, v in enumerate(rows)], VECTORS).repartition(4)
    use = usable(df)
    model = fit_whitening(use, 16, width or BLOCK)
    x, n, s, e, q = plain_fit(rows)
    k = min(16, len(s))
    assert model.n == n and model.sums == s.tolist() and model.identity_error < 1e-10
    assert np.abs(model.values - e[:k]).max() < 1e-11 * e[0]
    got = whitened(use, model).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == k * len(rows)
    z = ((x - s // n) - (s % n) / n) @ q[:, :k] / np.sqrt(e[:k])
    have = got.whitened.to_numpy().reshape(-1, k)
    sign = np.sign((z * have).sum(0))
    assert np.abs(have * sign - z).max() < 1e-7
    assert got.deviation[got.component == 1].tolist() == ((n * x - s) ** 2).sum(1).tolist()
    assert np.abs(got.explained[got.vec_id == 0] - e[:k] / e.sum()).max() < 1e-12
    return model


def test_whitening_needs_the_filter(spark):
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((600, 70)) @ np.diag(np.linspace(3, 1, 70))
    model = check_whitening(spark, np.concatenate([rows, rows[:50], np.repeat(rows[:1], 300, 0)]), width=24)
    assert model.residual <= 1e-13 and model.passes > 20


def test_whitening_of_few_dimensions_and_close_values(spark):
    rng = np.random.default_rng(2)
    check_whitening(spark, rng.standard_normal((200, 5)))
    check_whitening(spark, rng.standard_normal((3000, 40)))  # nearly a flat spectrum


def test_whitening_of_awkward_rows(spark):
    from tremorlake.llm.whitening import whiten

    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0])]
    good = [(7, [0.0, 0.0]), (None, [1.0, 0.5]), (9, [0.25, 3.0]), (9, [0.25, 3.0]), (10, [0.25, 3.0])]
    frame = lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    got = whiten(frame(bad + good)).toPandas()
    assert len(got) == 2 * len(good) and set(got.n) == {3} and got.vec_id.isna().sum() == 2
    assert whiten(frame([])).count() == 0 and whiten(frame(bad[:5])).count() == 0
    assert whiten(frame(good[-2:])).count() == 0  # one distinct vector has no variance
    line = whiten(frame([(i, [float(i), 0.0]) for i in range(5)])).toPandas()
    assert set(line.component) == {1}


def test_exact_deviations_beyond_doubles():
    from tremorlake.llm.whitening import deviations

    x = np.array([[1_000_000, 3_000_000_000], [1_000_001, -7]])
    for n, sums in ((2, [2_000_001, 2_999_999_993]), (5, [5_000_001, 9])):
        for row, got in zip(x.tolist(), deviations(x, n, sums)):
            want = sum((n * a - s) ** 2 for a, s in zip(row, sums))
            assert got == (want if want < 1 << 63 else None)
