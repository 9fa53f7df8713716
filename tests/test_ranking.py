import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.operators import embed, evaluate, features, location, ranker, search, split, windows
from sievelake.operators.filters import match_fraction, query_values
from sievelake.operators.index import Bm25Index, query_terms, sparse_topk
from sievelake.plans import reference_queries
from sievelake.sources import files


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", ["x", "x", "y"]), ("b", ["y"]), ("c", [])], "d string, w array<string>")
    q = query_terms(spark.createDataFrame([(1, ["x", "y", "x", "z"])], "q int, w array<string>"), "q", "w")
    got = {r["d"]: r["score"] for r in Bm25Index.build(docs, "d", "w").scores(q, "q").collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    w = lambda tf, dl, i: i * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (4 / 3)))
    assert got.keys() == {"a", "b"}
    assert got["a"] == pytest.approx(w(2, 3, idf(1)) + w(1, 3, idf(2))) and got["b"] == pytest.approx(w(1, 1, idf(2)))


def test_ties_go_to_the_smaller_item(spark):
    df = spark.createDataFrame([(1, i, 0.1 + 0.2) for i in "cab"], "q int, d string, s double")
    assert [r["d"] for r in sparse_topk(df, "q", "d", "s", 2, rank="r").orderBy("r").collect()] == ["a", "b"]


def test_ranks_and_shares(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 3.0), (1, 3.0), (1, float("nan")), (2, -2.0), (2, -4.0)], "q int, v double")
    got = sorted((r["q"], str(r["v"]), r["v_rel"], r["v_rank"]) for r in windows.relative(df, "q", ["v"]).collect())
    assert got == [(1, "1.0", 1 / 3, 3), (1, "3.0", 1.0, 1), (1, "3.0", 1.0, 1), (1, "None", None, None), (1, "nan", None, None), (2, "-2.0", -2.0, 1), (2, "-4.0", -4.0, 2)]


def test_log_prior(spark):
    r = spark.createDataFrame([(0.0, True, 0.0), (0.0, False, None)], "p double, s boolean, d double").select(location.log_prior(F.col("p"), F.col("s"), F.col("d")).alias("x")).collect()
    assert r[0]["x"] == pytest.approx(math.log(0.5001)) and r[1]["x"] == pytest.approx(math.log(1e-4), abs=1e-6)


def test_filter_bonus_counts_values(spark):
    q = spark.createDataFrame([(1, "Тип услуги A Тип услуги B")], "qi int, f string")
    have = spark.createDataFrame([("i", "Тип услуги", "A")], "item_id string, key string, value string")
    assert match_fraction(query_values(q, "qi", "f"), have, "qi", "item_id").first()["fb"] == 0.5


def test_events_with_null_keys_belong_to_none(spark):
    rows = [("q", 1, "f", 0, True, "b", 2), ("q", 1, "f", 0, True, "a", 1), ("q", 1, "f", 0, True, "b", 3), (None, 1, "f", 0, True, "c", 4)]
    df = spark.createDataFrame(rows, "search_query string, search_location_id long, search_infm_params_text string, search_category long, search_is_delivery_search boolean, item_id string, pos long")
    assert [r["relevant"] for r in split.events(df, "pos").collect()] == [["a", "b"]]
    groups = spark.createDataFrame([("z", True)], "item_id string, is_a boolean")
    val = split.events(df, "pos").withColumn("query_id", F.lit("v"))
    assert [r["item_id"] for r in split.fit_rows(df, groups, val).collect()] == ["c"]


def test_forest_learns_saves_and_takes_missing_values(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    x[::10, 1] = np.nan
    q = np.repeat(np.arange(30), 20)
    label = (x[:, 0] > 0.8).astype(int)
    df = spark.createDataFrame([(int(a), int(i), *map(float, r), int(y)) for i, (a, r, y) in enumerate(zip(q, x, label))], "qi int, ci int, a double, b double, c double, label int")
    p = ranker.RankParams(rounds=15, leaves=7, min_rows=5)
    forest = ranker.train_ranker(df, ["a", "b", "c"], p)
    assert max(forest.gains(), key=forest.gains().get) == "a"
    ranker.save_forest(spark, forest, str(tmp_path / "f"))
    again = ranker.load_forest(spark, str(tmp_path / "f"))
    assert np.allclose(again.predict(x), forest.predict(x))
    scored = ranker.score_candidates(df, again)
    rel = df.groupBy("qi").agg(F.sum("label").alias("n_relevant")).where("n_relevant > 0")
    assert evaluate.mean_recall(evaluate.recall_at(scored, rel, "score", 6)).first()["recall"] > 0.9
    assert ranker.train_ranker(df.limit(0), ["a"], p).trees == []
    with pytest.raises(ValueError):
        ranker.train_ranker(df, ["a"], ranker.RankParams(max_rows=10))


def test_tower_gradient_and_training(spark):
    p = embed.TowerParams(buckets=64, dim=8, epochs=30, batch=16, rate_table=0.05)
    pairs = spark.createDataFrame([(f"q{i}", [i], [i + 20]) for i in range(16)], "search_query string, q_tokens array<int>, i_tokens array<int>")
    model, losses = embed.train(pairs, p)
    assert losses[-1] < 0.3 * losses[0]
    q, i = model.encode([[k] for k in range(16)], "query"), model.encode([[k + 20] for k in range(16)], "item")
    assert (np.argmax(q @ i.T, axis=1) == np.arange(16)).mean() > 0.9 and np.allclose(np.linalg.norm(q, axis=1), 1, atol=1e-5)
    assert embed.train(pairs.limit(0), p)[1] == []
    vectors = embed.encode(spark.createDataFrame([(1, None), (2, [3])], "k int, t array<int>"), "k", "t", model, "query").collect()
    assert [len(r["embedding"]) for r in vectors] == [8, 8]


def test_answers_and_checks(spark, tmp_path):
    ranked = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, "c", 1.0)], "qi int, item_id string, score double")
    queries = spark.createDataFrame([(1, "x"), (2, "y")], "qi int, query_id string")
    given = evaluate.answers(ranked, queries, "score", k=2)
    assert {tuple(r) for r in given.collect()} == {("x", "a b"), ("y", "")}
    files.write_answers(given, str(tmp_path / "a"))
    back = files.read_answers(spark, str(tmp_path / "a"))
    assert {tuple(r) for r in back.collect()} == {("x", "a b"), ("y", "")}
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    assert all(r["n"] == 0 for r in evaluate.check_answers(back, queries, items).collect())
    bad = spark.createDataFrame([("x", "a a q"), ("x", ""), ("w", "a b c")], "query_id string, answer string")
    assert {r["problem"]: r["n"] for r in evaluate.check_answers(bad, queries, items, k=2).collect()} == {"repeated query": 1, "query without answer": 1, "unknown query": 1, "too many items": 2, "repeated item": 1, "unknown item": 2}


def test_clip_keeps_null(spark):
    r = spark.createDataFrame([(-1.0,), (2e7,), (None,)], "x double").select(features.clipped(F.col("x"), 0.0, 1e7).alias("y")).collect()
    assert [x["y"] for x in r] == [0.0, 1e7, None]


def test_known_values_by_join_equal_those_by_pattern(spark, monkeypatch):
    from sievelake.operators import filters

    log = spark.createDataFrame([("Тип услуги Шины и диски Вид услуги Ремонт",), ("Тип услуги Шины",), ("Тип услуги автосервиса Мойка кузова",), (None,)], "search_infm_params_text string")
    texts = ["Тип услуги Шины и диски", "Тип услуги автосервиса Шины", "x Тип услуги Шинысты Тип услуги Шины Вид услуги Ремонт", "Тип услуги автосервиса Мойка кузова Тип услуги Шины и диски", None, "", "Вид услуги Ремонт"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id int, p string")
    values = filters.known_values(log)
    some = {tuple(r) for r in filters.item_values(items, "item_id", "p", values).collect()}
    monkeypatch.setattr(filters, "PATTERN_VALUES", 0)
    assert {tuple(r) for r in filters.item_values(items, "item_id", "p", values).collect()} == some
    assert (0, "Тип услуги", "Шины и диски") in some and (1, "Тип услуги", "Шины") not in some and (2, "Тип услуги", "Шины") in some


def test_blocks_of_queries_give_what_one_block_gives(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from sievelake.operators import sources
    from sievelake.operators.querylog import neighbours

    rng = random.Random(3)
    rows = lambda n, at: [(at + i, [rng.gauss(0, 1) for _ in range(4)], rng.choice([1, 2, 3, None]), rng.choice([["a"], ["b", "c"], None])) for i in range(n)]
    items = spark.createDataFrame(rows(60, 0) + [(900, None, 1, None), (901, [0.0] * 4, 1, None), (902, [1.0, 2.0], 1, None)], "item long, v array<double>, item_loc long, codes array<string>")
    queries = spark.createDataFrame(rows(17, 0), "q long, v array<double>, s_loc long, wants array<string>").withColumn("n_cons", F.size("wants").cast("long"))
    near = spark.createDataFrame([(1, 1, -0.5), (1, 2, -3.0), (2, 3, -1.0)], "s_loc long, item_loc long, loc_logp double")
    run = lambda size: {tuple(r) for r in sources.vector_scores(queries, items, "q", "item", "v", 5, near=near, filtered=True, alpha=40.0, size=size).collect()}
    whole = run(10_000)
    assert len(whole) == 17 * 5 and whole == run(4)
    monkeypatch.setattr(sources, "PRIOR_ROWS", 1)
    assert whole == run(10_000)
    texts = spark.createDataFrame([(f"ремонт {w} {i % 4}",) for i, w in enumerate("окна двери стены полы окон дверей".split() * 4)], "qn string")
    asked = spark.createDataFrame([(i, f"ремонт {w}") for i, w in enumerate(["окна", "дверь", "стен", "zzz"])], "qi int, qn string")
    one = {tuple(r) for r in neighbours(asked, texts).collect()}
    monkeypatch.setattr("sievelake.operators.querylog.TEXT_BLOCK", 1)
    assert one and {tuple(r) for r in neighbours(asked, texts).collect()} == one
    assert neighbours(asked.limit(0), texts).count() == 0 and neighbours(asked, texts.limit(0)).count() == 0


def test_owned_tables_go_with_their_block(spark):
    import os

    from sievelake.staging import drop_staged, owned, stage

    with owned(spark):
        kept = stage(spark.range(3), "mine")
        path = kept._staged
        assert os.path.exists(path) and kept.count() == 3
    assert not os.path.exists(path)
    other = stage(spark.range(3), "other")
    drop_staged(other)
    assert not os.path.exists(other._staged)


def _brute(q, docs, k, near, filtered, decimals=6):
    """Best documents by single sums over all pairs."""
    n, avg = len(docs), sum(len(d[1]) for d in docs) / len(docs)
    df = {t: sum(t in d[1] for d in docs) for d in docs for t in d[1]}
    idf = {t: math.log(1 + (n - x + 0.5) / (x + 0.5)) for t, x in df.items()}
    out = set()
    for qi, terms, s_loc, wants in q:
        rows = []
        for name, words, loc, codes in docs:
            common = [t for t in terms if t in words]
            if common:
                s = sum(idf[t] * words.count(t) * 2.2 / (words.count(t) + 1.2 * (0.25 + 0.75 * len(words) / avg)) for t in common)
                if near is not None:
                    s += 2.0 * near.get((s_loc, loc), location.LOWEST)
                if filtered and wants:
                    s += 0.5 * len(set(wants) & set(codes or [])) / len(wants)
                rows.append((-round(s, decimals), name, round(sum(idf[t] for t in common), 6)))
        out |= {(qi, name, -s, m, i + 1) for i, (s, name, m) in enumerate(sorted(rows)[:k])}
    return out


@pytest.mark.parametrize("parts,blocks,chunk,filtered", [(1, 1, 65536, True), (1, 3, 40, True), (2, 2, 40, False), (3, 2, 17, None)])
def test_search_in_chunks_and_blocks_equals_single_sums(spark, monkeypatch, parts, blocks, chunk, filtered):
    monkeypatch.setattr(search, "CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = np.random.default_rng(4)
    words = [f"w{j}" for j in range(9)]
    # short texts of few words: most scores are shared by several documents, so that names decide at the k-th place
    docs = [(f"d{rng.integers(10**6):06d}_{i}", [words[j] for j in rng.integers(0, 9, rng.integers(1, 4))], int(rng.integers(0, 4)) if i % 9 else None, [f"k={j}" for j in range(3) if rng.random() < 0.4] or None) for i in range(200)]
    docs = [(docs[0][0], [], 0, None), *docs[1:]]
    q = [(i, list(dict.fromkeys(words[j] for j in rng.integers(0, 9, rng.integers(1, 4)))) + ["nowhere"], int(rng.integers(0, 3)) if i % 7 else None, [f"k={j}" for j in range(3) if rng.random() < 0.5] or None) for i in range(40)]
    near = {(0, 0): -0.5, (0, 1): -3.0, (1, 2): -0.25, (2, 0): -6.0}
    located = filtered is not None
    ix = Bm25Index.build(spark.createDataFrame([d[:2] for d in docs], "d string, w array<string>"), "d", "w").staged()
    terms = spark.createDataFrame([(x[0], t) for x in q for t in x[1]], "q int, term string")
    asked = spark.createDataFrame([(a, s, w, len(w) if w else None) for a, _, s, w in q], "q int, s_loc long, wants array<string>, n_cons long")
    items = spark.createDataFrame([(d[0], *d[2:]) for d in docs], "d string, item_loc long, codes array<string>")
    prior = spark.createDataFrame([(*k, v) for k, v in near.items()], "s_loc long, item_loc long, loc_logp double") if located else None
    try:
        got = search.best(ix, terms, "q", 6, asked=asked, items=items, near=prior, filtered=bool(filtered), location=2.0, share=0.5, matched=True, parts=parts, blocks=blocks).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["q"], r["d"], round(r["score"], 6), round(r["matched_idf"], 6), r["rnk"]) for r in got} == _brute(q, docs, 6, near if located else None, filtered)
    assert len(got) == len({(r["q"], r["d"]) for r in got})


def test_a_value_of_zero_still_makes_a_pair(spark):
    ix = Bm25Index.build(spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "d string, w array<string>"), "d", "w").staged()
    terms = spark.createDataFrame([(1, "x", 0.0)], "q int, term string, value double")
    assert [(r["d"], r["score"]) for r in search.best(ix, terms, "q", 5, value="value").collect()] == [("a", 0.0)]


@pytest.mark.parametrize("name", ["bm25_topk", "idf_coverage", "src_title", "bm25_title_weighted", "src_all", "bm25_location_topk", "src_tr", "src_prof"])
def test_no_row_for_every_pair_of_query_and_item(spark, monkeypatch, name):
    def never(*_, **__):
        raise AssertionError("a table of all pairs with a common term")

    monkeypatch.setattr(Bm25Index, "scores", never)
    assert reference_queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_derivatives_of_many_queries_at_once_equal_those_of_pairs():
    rng = np.random.default_rng(1)
    sizes = [1, 3, 4, 9, 40, 200, 0, 7]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    score, label = np.round(rng.normal(size=starts[-1]), 1), rng.choice([0.0, 0.0, 1.0, 2.0], starts[-1])
    g, h = ranker.lambdas(score, label, starts, 6)
    want_g, want_h = np.zeros(len(score)), np.zeros(len(score))
    for a, b in zip(starts[:-1], starts[1:]):
        rank = np.empty(b - a, int)
        rank[np.argsort(-score[a:b], kind="stable")] = np.arange(b - a)
        ideal = sum(x / np.log2(k + 2) for k, x in enumerate(sorted(2 ** label[a:b] - 1, reverse=True)[:6]))
        for i in range(b - a):
            for j in range(b - a):
                if label[a + i] > label[a + j] and min(rank[i], rank[j]) < 6:
                    delta = (2 ** label[a + i] - 2 ** label[a + j]) * abs(1 / np.log2(rank[i] + 2) - 1 / np.log2(rank[j] + 2)) / ideal
                    rho = 1 / (1 + np.exp(score[a + i] - score[a + j]))
                    want_g[a + i] += rho * delta
                    want_g[a + j] -= rho * delta
                    want_h[a + i] += rho * (1 - rho) * delta
                    want_h[a + j] += rho * (1 - rho) * delta
    assert np.allclose(g, want_g) and np.allclose(h, want_h)


def test_a_split_sums_up_its_smaller_child_only(monkeypatch):
    rng, seen = np.random.default_rng(2), []
    x = np.stack([rng.normal(size=3000), rng.integers(0, 2, 3000), rng.integers(0, 3, 3000)], axis=1).astype(float)
    x[::7, 1] = np.nan
    label, starts = (x[:, 0] + np.nan_to_num(x[:, 1]) + rng.normal(size=3000) > 1.5).astype(float), np.arange(0, 3001, 30)
    sums = ranker._Bundles.sums
    monkeypatch.setattr(ranker._Bundles, "sums", lambda self, chosen, g, h, rows: seen.append((len(chosen), len(rows))) or sums(self, chosen, g, h, rows))
    p = ranker.RankParams(rounds=1, leaves=16, min_rows=5, row_share=1.0, feature_share=1.0)
    forest = ranker.fit_forest(x, label, starts, ["a", "b", "c"], p)
    splits = int((forest.trees[0]["feature"] >= 0).sum())
    assert splits == 15 and seen[0] == (2, 3000) and len(seen) <= splits + 1 and max(n for _, n in seen[1:]) <= 1500
    # the first split is the best of all by its definition
    g, h = ranker.lambdas(np.zeros(3000), label, starts, p.truncation)
    parts = [(c, k, m, np.where(np.isnan(x[:, c]), m, x[:, c] <= k)) for c in range(3) for k in np.quantile(x[~np.isnan(x[:, c]), c], np.linspace(0, 1, 255)[1:]) for m in (True, False)]
    gain = lambda left: sum(g[s].sum() ** 2 / (h[s].sum() + p.ridge) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + p.ridge)
    assert np.isclose(max(gain(left) for *_, left in parts if 5 <= left.sum() <= 2995), forest.trees[0]["gain"][0])


def test_vector_search_returns_k_rows_a_query_from_all_tasks_together(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)).round(3)
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "item int, v array<float>").repartition(6)
    queries = rows.where("item < 9").withColumnRenamed("item", "q")
    from sievelake.operators import sources

    one = sources.vector_scores(queries, rows, "q", "item", "v", 5, size=4)
    assert "Window" not in one._jdf.queryExecution().executedPlan().toString()  # nothing of a task is cut again
    many = sources.vector_scores(queries, rows, "q", "item", "v", 5, size=4, parts=3)
    u = x.astype(np.float32).astype(float)
    u /= np.sqrt((u * u).sum(1))[:, None]
    sim = np.round(u[:9] @ u.T, 6)
    want = {(q, i, sim[q, i], sim[q].max()) for q in range(9) for i in sorted(range(60), key=lambda i: (-sim[q, i], i))[:5]}
    got = lambda df: {(r["q"], r["item"], r["sim"], r["sim_max"]) for r in df.collect()}
    assert got(one) == got(many) == want


def test_rows_are_scored_node_by_node(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3)).round(1)
    x[::5, 1] = np.nan
    forest = ranker.fit_forest(x, (np.nan_to_num(x).sum(1) > 1).astype(float), np.arange(0, 2001, 20), ["a", "b", "c"], ranker.RankParams(rounds=6, leaves=9, min_rows=5))
    x[::3, 0] = np.nan
    want = np.zeros(2000)
    for t in forest.trees:
        for i, row in enumerate(x):
            n = 0
            while t["feature"][n] >= 0:
                v = row[t["feature"][n]]
                n = t["left"][n] if (t["default_left"][n] if np.isnan(v) else v <= t["threshold"][n]) else t["right"][n]
            want[i] += t["value"][n]
    blocks, add = [], ranker.Forest._add
    monkeypatch.setattr(ranker.Forest, "_add", lambda self, columns, out, rounds: blocks.append(columns.shape) or add(self, columns, out, rounds))
    monkeypatch.setattr(ranker, "SCORED", 700)
    assert np.allclose(forest.predict(x), want) and blocks == [(3, 700), (3, 700), (3, 600)]
