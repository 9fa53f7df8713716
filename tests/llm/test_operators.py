import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelake.llm import private, sentences
from sievelake.llm.distinctive import term_scores
from sievelake.llm import queries as llm_queries
from sievelake.llm.mixing import block_count, mix, plan_mixture, split_quotas
from sievelake.llm.neighbours import BitCodes, KnnParams, nearest_neighbours, neighbour_pairs, rotation
from sievelake.llm.queries import QUERIES, SQL, vocabulary
from sievelake.llm.tokenizer import BytePairEncoder, encode_corpus
from sievelake.llm.topn import top_n
from tests.conftest import DATA


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(compare, name):
    from sievelake.llm import queries

    compare(queries, name)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


# ---- top n ------------------------------------------------------------------------------------------------------------------------


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if i is not None and s is not None and s == s:
            best[g, i] = max(best.get((g, i), -math.inf), s)
    out = set()
    for g in {g for g, _ in best}:
        mine = sorted((-s, i) for (h, i), s in best.items() if h == g)[:n]
        out |= {(g, i, -s + 0.0) for s, i in mine}
    return out


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 5), (3, 50)])
def test_top_n_equals_sorting(spark, seed, n):
    rng = random.Random(seed)
    scores = [0.0, -0.0, 1.5, -1.5, math.inf, -math.inf, 1e-300, -1e300, 5e-324, None, float("nan")]
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(-200, 400)]), rng.choice(scores) if rng.random() < 0.4 else round(rng.gauss(0, 1), rng.choice([0, 1, 9]))) for _ in range(3000)]
    rows += rows[:100]
    df = spark.createDataFrame(rows, "qi int, ci int, score double").withColumn("key", F.lit(1)).withColumn("g", F.lit(2))
    got = [tuple(r) for r in top_n(df, "qi", "ci", "score", n).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_top(rows, n)


def test_top_n_edges(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 3, float("nan"))], "qi int, ci int, score double")
    assert top_n(df, "qi", "ci", "score", 3).count() == 0 and top_n(df.limit(0), "qi", "ci", "score", 3).count() == 0
    equal = spark.range(1000).select(F.lit(1).alias("qi"), F.col("id").cast("int").alias("ci"), F.lit(7.0).alias("score"))
    assert sorted(r["ci"] for r in top_n(equal, "qi", "ci", "score", 50).collect()) == list(range(50))
    with pytest.raises(TypeError):
        top_n(df.withColumn("ci", F.lit("x")), "qi", "ci", "score", 3)


def test_top_n_joins_cutoffs_by_shuffle_beyond_the_bound(spark, monkeypatch):
    from sievelake.llm import topn

    monkeypatch.setattr(topn, "BROADCAST_GROUPS", 0)
    rows = [(i % 7, i, float(i * 37 % 101)) for i in range(700)]
    assert {tuple(r) for r in top_n(spark.createDataFrame(rows, "qi int, ci int, score double"), "qi", "ci", "score", 4).collect()} == brute_top(rows, 4)


# ---- tokenizer --------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    tokenizers = pytest.importorskip("tokenizers")
    path, pattern = vocabulary()
    other = tokenizers.Tokenizer.from_file(path.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    return BytePairEncoder(path, pattern), other


@given(st.text(max_size=60) | st.text("ab \n<|endoftext|>éя中0🙂", max_size=60))
@settings(max_examples=300, deadline=None)
def test_same_ids_as_the_library(pair, text):
    mine, other = pair
    assert mine.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_long_pieces(pair):
    mine, other = pair
    for text in (" " * 50_000, "a" * 50_000, "ab" * 20_000, "абв" * 10_000):
        assert mine.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_encode_corpus(spark, pair):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello", 5), (3, "hello", 5), (None, "x", 5)], "doc_id long, text string, ids int")
    got = [tuple(r) for r in encode_corpus(df, "doc_id", "text", *vocabulary()).collect()]
    hello = pair[1].encode("hello", add_special_tokens=False).ids
    assert sorted(got, key=str) == sorted([(1, []), (2, []), (3, hello), (3, hello), (None, pair[1].encode("x").ids)], key=str)
    assert [r["ids"] for r in encode_corpus(df, "doc_id", "text", *vocabulary(), counts_only=True).orderBy("doc_id").collect()][1:3] == [0, 0]
    assert encode_corpus(df.limit(0), "doc_id", "text", *vocabulary()).count() == 0


# ---- distinctive terms ------------------------------------------------------------------------------------------------------------


def g2(n, length, cf, total):
    cells = [(n, length, cf), (cf - n, total - length, cf), (length - n, length, total - cf), (total - length - cf + n, total - length, total - cf)]
    g = 2 * sum(o * math.log(o / (a * b / total)) for o, a, b in cells if o > 0 and a * b > 0)
    return g if n * total >= length * cf else -g


@pytest.mark.parametrize("df_range", [None, (2, 12)])
def test_scores_equal_brute_force(spark, df_range):
    rng = random.Random(4)
    words = [f"слово{i}" for i in range(60)]
    docs = {f"i{k}": " ".join(rng.choice(words[: rng.choice([2, 60])]) for _ in range(rng.randint(0, 15))) for k in range(80)}
    rows = [(k, v, None, "x") for k, v in docs.items()] + [("i1", docs["i1"], None, "y"), (None, "потеряно", None, "z"), ("blank", None, None, None)]
    df = spark.createDataFrame(rows, "id string, title string, text string, term string")
    got = {(r["id"], r["term"]): r for r in term_scores(df, "id", ["title", "text"], df_range=df_range).collect()}
    import re

    counts = {k: Counter(w for w in re.findall("[0-9a-zа-я]+", v) if len(w) > 3) for k, v in docs.items()}
    cf, dfs = Counter(), Counter()
    for c in counts.values():
        cf.update(c)
        dfs.update(c.keys())
    total = sum(cf.values())
    want = {(k, w) for k, c in counts.items() for w in c if df_range is None or df_range[0] <= dfs[w] <= df_range[1]}
    assert got.keys() == want
    for (k, w), r in got.items():
        assert (r["n"], r["df"], r["n_records"]) == (counts[k][w], dfs[w], 81)
        assert r["llr"] == pytest.approx(g2(counts[k][w], sum(counts[k].values()), cf[w], total), abs=1e-6)
    assert term_scores(df.limit(0), "id", ["title", "text"]).count() == 0


# ---- mixing -----------------------------------------------------------------------------------------------------------------------


def test_split_keeps_totals():
    rng = np.random.default_rng(1)
    for shards in (1, 3, 16):
        q = np.array([100, 0, 7, 3333])
        parts = split_quotas(q, shards, rng)
        assert parts.shape == (shards, 4) and (parts.sum(0) == q).all() and (parts >= 0).all()
        assert parts.sum(1).max() - parts.sum(1).min() <= 12


def test_shares_caps_and_uses(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["big"] * 6 + ["mid"] * 3 + ["small", None, "other"]), rng.randint(0, 60)) for i in range(4000)] + [(9001, "mid", None)]
    df = spark.createDataFrame(rows, "id long, source string, z int").withColumn("shard", F.lit(1)).withColumn("block", F.lit(2))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("gone", 0.05, 3)], "source string, target_share double, max_repeats int")
    df = df.withColumn("digest", F.col("id").cast("string"))
    mixture, report = mix(df, "id", "source", "digest", "z", targets, shards=8, blocks=512)
    got, shares = mixture.collect(), {r["source"]: r for r in report.collect()}
    uses = Counter((r["source"], r["id"]) for r in got)
    caps = {"big": 1, "mid": 2, "small": 4}
    assert all(n <= caps[s] for (s, _), n in uses.items())
    assert len({(r["id"], r["repeat_no"]) for r in got}) == len(got)
    total = sum(r["z"] for r in got)
    for s in caps:
        mine = sum(r["z"] for r in got if r["source"] == s)
        assert mine == shares[s]["tokens"] and abs(mine / total - shares[s]["planned_share"]) < 0.005
    assert shares["gone"]["actual_share"] == 0 and abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    for s in range(8):
        pos = sorted(r["pos"] for r in got if r["shard"] == s)
        assert pos == list(range(1, len(pos) + 1))
    empty, zero = mix(df.limit(0), "id", "source", "digest", "z", targets)
    assert empty.count() == 0 and all(r["tokens"] == 0 for r in zero.collect())


def test_copies_of_a_text_share_its_cap(spark):
    """Of 300 copies of one text, and of null texts, the smallest key is used, as often as any other text."""
    rows = [(i, "a", "same" if i < 300 else None if i < 310 else f"t{i}", 10) for i in range(400)] + [(1000 + i, "b", f"u{i % 5}", 10) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, source string, digest string, z int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    mixture, report = mix(df, "id", "source", "digest", "z", targets, shards=4, blocks=16)
    uses = Counter((r["source"], rows[r["id"]][2] if r["id"] < 1000 else f"u{r['id'] % 5}") for r in mixture.collect())
    assert max(n for (s, _), n in uses.items() if s == "a") <= 2 and max(n for (s, _), n in uses.items() if s == "b") == 3
    assert {r["id"] for r in mixture.collect()} <= {0, 300, *range(310, 400), *range(1000, 1005)}
    assert {r["source"]: r["available_tokens"] for r in report.collect()} == {"a": 920, "b": 50}


def test_the_mixture_of_the_tables_keeps_every_cap(spark):
    got = llm_queries.QUERIES["p9_mixture"](spark, "/root/testdata/sf0.1")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    caps = spark.read.parquet("/root/testdata/sf0.1/mix_targets.parquet").select("source", "max_repeats")
    assert got.join(docs, "doc_id").groupBy("source", "text").count().join(caps, "source").where("count > max_repeats").count() == 0
    assert got.count() > 0


def test_blocks_shrink_with_repeats():
    assert block_count({"a": (1.0, 4)}, 4096) == 4096
    assert block_count({"a": (1.0, 40_000)}, 4096) == 10
    with pytest.raises(ValueError):
        block_count({"a": (1.0, 10**6)}, 4096)


def test_a_source_limits_the_mixture_at_its_cap():
    chosen, report = plan_mixture({"a": {0: 100, 1: 100}, "b": {0: 10}}, {"a": (0.5, 1), "b": (0.5, 4)}, 2, 1)
    assert Counter(s for s, *_ in chosen)["b"] == 4 and {r[0]: r[4] for r in report}["b"] == 40


# ---- neighbours -------------------------------------------------------------------------------------------------------------------


def brute_pairs(items, k=5, least=0.8):
    names = sorted(items)
    x = np.stack([items[n] for n in names]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = set()
    for i, a in enumerate(names):
        for j in sorted((j for j in range(len(names)) if j != i), key=lambda j: (-s[i, j], names[j]))[:k]:
            if s[i, j] >= least:
                out.add((min(a, names[j]), max(a, names[j])))
    return out


def clouds(seed, sizes, dim=16):
    rng = np.random.default_rng(seed)
    out = {}
    for c, n in enumerate(sizes):
        centre = rng.standard_normal(dim)
        for i in range(n):
            out[f"c{c:03d}_{i:03d}"] = (centre / np.linalg.norm(centre) + rng.standard_normal(dim) * 0.08).astype(np.float32)
    return out


def table_of(spark, items, *more):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in items.items()] + list(more), "item string, vec array<float>")


@pytest.mark.parametrize("sizes", [[30, 1, 2, 60, 7, 7, 7, 200], [3] * 60])
def test_recall_against_brute_force(spark, sizes):
    items = clouds(2, sizes)
    got = {tuple(r) for r in neighbour_pairs(nearest_neighbours(table_of(spark, items), "item", "vec", KnnParams(dim=16, margin=0.4))).collect()}
    want = brute_pairs(items)
    assert len(got & want) / len(want) > 0.97 and len(got - want) / len(got) < 0.03


def test_copies_repeats_and_bad_vectors(spark):
    """A large class of copies (more than a row carries), repeated rows, unusable vectors, other norms."""
    items = clouds(3, [4, 5])
    first = items["c000_000"]
    items |= {f"copy{i:02d}": first for i in range(30)}
    items["scaled"] = first * 3
    bad = [("n", None), ("z", [0.0] * 16), ("s", [1.0] * 3), ("nan", [float("nan")] * 16), ("inf", [float("inf")] * 16), (None, [1.0] * 16), ("hole", [None] * 16)]
    again = [(k, [float(x) for x in items[k]]) for k in list(items)[:6]]
    df = table_of(spark, items, *bad, *again).withColumn("cell", F.lit(1)).withColumn("ids", F.lit(1))
    got = {tuple(r) for r in neighbour_pairs(nearest_neighbours(df, "item", "vec", KnnParams(dim=16, margin=2.0))).collect()}
    assert got == brute_pairs(items)
    assert nearest_neighbours(df.limit(0), "item", "vec", KnnParams(dim=16)).count() == 0


def test_an_item_with_two_vectors_counts_once(spark):
    items = clouds(4, [6])
    df = table_of(spark, items, ("c000_000", [1.0] + [0.0] * 15))
    rows = nearest_neighbours(df, "item", "vec", KnnParams(dim=16, min_similarity=-1.0, margin=2.0)).collect()
    assert Counter(r["item"] for r in rows) == {k: 5 for k in items}


def test_an_unusable_row_does_not_replace_a_valid_one(spark):
    items = clouds(4, [6])
    wrong = [[0.0] * 16] + [[x if i == j else 1.0 for i in range(16)] for j, x in enumerate([float("nan"), float("inf"), -float("inf"), None])]
    df = table_of(spark, items, *[(k, v) for k in items for v in wrong])
    rows = nearest_neighbours(df, "item", "vec", KnnParams(dim=16, min_similarity=-1.0, margin=2.0)).collect()
    assert Counter(r["item"] for r in rows) == {k: 5 for k in items}


def test_bounds_of_the_estimate_hold():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre, turn = x[:50].mean(0), rotation(64, 1)
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-4)
    est, bound = BitCodes.of(x, centre, turn).estimate(x[:100], centre, turn, 3.0)
    off = np.abs(est - x[:100] @ x.T)
    assert (off <= bound).mean() > 0.99 and off.mean() < 0.1


# ---- personal information ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def finder(spark):
    return private.learn(spark.read.parquet("/root/testdata/sf0.01/benchmark_items.parquet"), "item_description_raw")


@pytest.mark.parametrize(
    "text,want",
    [
        ("Звоните: 8 289 212 96 72. Спасибо", [("phone", "8 289 212 96 72")]),
        ("Тел. +7 (256) 370-60-44, в любое время", [("phone", "+7 (256) 370-60-44")]),
        ("Договор № 838135171942 заключаем", []),
        ("Заказ № 00-856421 выполнен. Серия 12 плитки, партия 544823.", []),
        ("Паспорт: серия 0053 № 122044.", [("identity", "0053 № 122044")]),
        ("СНИЛС 000-871-984 11, самозанятый", [("identity", "000-871-984 11")]),
        ("Пишите на info [at] masterok [dot] test, отвечу", [("email", "info [at] masterok [dot] test")]),
        ("Наш канал @uyut и сайт masterok.test.", []),
        ("Мы здесь: ул. Журавлиная, д.133/6, кв 162! Звоните", [("address", "ул. Журавлиная, д.133/6, кв 162")]),
        ("Адрес Рябиновая ул., 19к1 (второй этаж).", [("address", "Рябиновая ул., 19к1")]),
        ("Адрес улица Глеба Заволокина, 79 (второй этаж).", [("address", "улица Глеба Заволокина, 79")]),
        ("Выезд на улицу Липовая и в соседние дворы. Дом 3 этажа, квартира 2 комнаты.", []),
        ("Работу принимает Вербохлестова М.П., опыт большой.", [("name", "Вербохлестова М.П.")]),
        ("Вопросы можно задать Звонарёвкину Глебу Ильичу, телефон в профиле.", [("name", "Звонарёвкину Глебу Ильичу")]),
        ("Спросить Марину. Салон «Ольга» работает без выходных.", []),
        ("", []), (None, []),
    ],
)
def test_spans(finder, text, want):
    assert [(k, text[a:b]) for a, b, k in finder.find(text)] == want


def test_redaction_keeps_the_rest(finder):
    assert finder.redact("Звоните: 8 289 212 96 72. Мастер — Пётр Заволокин.") == "Звоните: [PHONE]. Мастер — [NAME]."
    assert finder.redact(None) is None


def test_private_tables(spark, finder):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Тел. 8 289 212 96 72, в любое время", "x"), (3, "Тел. 8 289 212 96 72, в любое время", "x")], "id long, text string, kind string")
    got = [tuple(r) for r in private.find_private(df, "id", "text", finder).collect()]
    assert got == [(3, "phone", "8 289 212 96 72", 5, 20)] * 2
    assert private.redact(df, "text", finder).count() == 4
    assert private.find_private(df.limit(0), "id", "text").count() == 0
    assert private.find_private(df, "id", "text", finder).columns == ["id", "kind", "found_text", "span_start", "span_end"]


def test_em_finds_the_unreliable_labeler():
    rng = np.random.default_rng(8)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < acc, truth, ~truth) for acc in (0.9, 0.85, 0.55, 0.8)]).T.astype(int) * private.NAME
    model = private.fit_labels(Counter(map(tuple, votes.tolist())), (private.NONE, private.NAME), 4)
    right = [model.confusion[j][1][private.NAME + 1] for j in range(4)]
    assert abs(model.prior[1] - 0.4) < 0.05 and right[0] > 0.85 and right[2] < 0.65
    assert ((model.posterior(votes)[:, 1] > 0.5) == truth).mean() > 0.88


# ---- sentences --------------------------------------------------------------------------------------------------------------------


def test_long_words_that_usually_end_sentences_are_no_abbreviations(spark):
    text = "Am Ende waren alle zufrieden. Der Hof war leer! Der Tag war lang! Im Haus blieb es ruhig, und nebenan auch."
    df = spark.createDataFrame([(text,)], "text string").withColumn("text", F.explode(F.array_repeat("text", 6000)))
    model = sentences.learn(df, "text")
    assert ("de", "der") in model.starters and ("de", "zufrieden") not in model.digits  # the table of the text's language


def test_the_language_of_a_text_is_told_by_its_words():
    assert sentences.tongues("Der Hof ist leer und die Tür auch") == ("de", "zh")
    assert sentences.tongues("The yard is empty") == ("en", "zh")
    assert sentences.tongues("HDMI 2.0") == ("latn", "zh") and sentences.tongues("これは本です") == ("latn", "ja")
    assert sentences.tongues("") == ("latn", "zh")


@pytest.mark.parametrize("part", ["а.б", "a.b.", "-.", "1. ", "1.2.", "«", "(", "a\n\n", "\u200d", ". "])
def test_degenerate_texts_take_linear_time(cutter, part):
    import time

    text, began = part * (100_000 // len(part)), time.time()
    spans = cutter.spans(text) + cutter.spans("(" * 50_000 + ")" * 50_000)
    sentences.count_types(text, {}, Counter())
    assert time.time() - began < 5 and spans is not None


@pytest.fixture(scope="module")
def cutter(spark):
    return sentences.Segmenter(sentences.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "text"))


@pytest.mark.parametrize(
    "parts",
    [
        ["Работаю по договору с 2015 г.", "Если стены кривые, то я бы поискал другого исполнителя.", "Почему?"],
        ["Выезжаю на дом в пределах г. Ковыльск и области.", "Мастер П. И. Звонарёвкин приедет."],
        ["Делаем всё: замер, монтаж и т. д.", "По моему опыту, это т. н. «сухая» чистка, т. е. без воды."],
        ["«Приеду завтра, не волнуйтесь!» — сказал мастер и не обманул.", "Кто пишет «дорого?», тот не видел чужих цен."],
        ["Посмотрел и сказал: «Тут работы на час. Не больше.»", "Ждали долго… 🔥", "Площадь 58 тыс. кв. м!", "Смета выросла."],
        ["Звонил три раза... так и не ответили.", "11. Снимите старое покрытие."],
        ["Часы работы: пн.–пт. с 9.00 до 18.30.", "Пишите на a@mail.test, отвечу."],
        ["We paid approx. 53.8 per sq. m.", "Is the tile work included?", "Dr. Tikholozov recommended this team, e.g. for old houses."],
        ["He said, “It takes an hour. No more.”", "Yes, by 5 p.m. it was done.", "\"Never again!\" she wrote."],
        ["Am 25. Mai war alles fertig.", "Herr Dr. Fennimarch war zufrieden.", "„Kein Problem!“, sagte er am Telefon."],
        ["قال: «سأعود غدًا.» ثم غادر.", "متى يمكنكم الحضور؟", "د. سهيران أوصى بهذا الفريق."],
        ["“कल आऊँगा।” उसने कहा।", "डॉ. वेदांशु ने यह टीम सुझाई।"],
    ],
)
def test_sentences_with_blanks(cutter, parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in cutter.spans(text)] == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["客服回答：「可以，今天就来。」", "太满意了！", "“价格怎么算？”我问。", "他说：“明天一定修好。”然后就走了。", "预约电话一直占线……最后还是发了消息。👍", "面积是24.6平方米。"],
        ["「すぐ行きます。」と電話で言われた。", "連絡が遅くて…少し不安でした。", "部品はVer.7.1に対応しています。", "予約は今日できますか？"],
        ["Цена меня устроила.", "Можно ли вызвать вас на ул. Степная, д. 52?"],
    ],
)
def test_sentences_without_blanks(cutter, parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in cutter.spans(text)] == parts


def test_lines_thai_and_odd_space(cutter):
    cut = lambda t: [t[a:b] for a, b in cutter.spans(t)]
    assert cut("Отзыв о мастере\r\n\r\nЦена\nменя  устроила") == ["Отзыв о мастере", "Цена\nменя  устроила"]
    assert cut("ช่างมาตรงเวลามาก ใช้เวลา 45.1 ชั่วโมงก็เสร็จ  ดูรายละเอียดที่ post.invalid ก่อนจอง") == ["ช่างมาตรงเวลามาก", "ใช้เวลา 45.1 ชั่วโมงก็เสร็จ", "ดูรายละเอียดที่ post.invalid ก่อนจอง"]
    assert cut("") == [] and cut(" \n\t") == [] and cut(".") == ["."]


@given(st.text("аБ. !?«»\"“”„()…。」「\n🙂1,—กข", max_size=80))
@settings(max_examples=400, deadline=None)
def test_units_cover_all_and_do_not_overlap(text):
    spans = sentences.Segmenter(sentences.SentenceModel()).spans(text)
    covered = [i for a, b in spans for i in range(a, b)]
    assert covered == sorted(set(covered))
    assert all(text[i].isspace() for i in set(range(len(text))) - set(covered))
    assert all(not text[a].isspace() and not text[b - 1].isspace() and a < b for a, b in spans)


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Да. Нет."), (3, "Да. Нет."), (None, "x")], "doc_id long, text string")
    got = sorted(map(str, sentences.split_sentences(df, "doc_id", "text").collect()))
    assert len(got) == 5 and sentences.split_sentences(df.limit(0), "doc_id", "text").count() == 0
