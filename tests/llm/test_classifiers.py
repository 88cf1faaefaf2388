import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenreel.llm import language_id as L
from lumenreel.llm import toxicity as X
from lumenreel.llm.common import held_out

TONGUES = {"aa": "the and of with thing other great".split(), "bb": "der und die nicht schön groß über".split()}


def corpus(n=200, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(TONGUES))
        rows.append((i, " ".join(rng.choice(TONGUES[lang]) + rng.choice(["", "s", "en"]) for _ in range(rng.randint(3, 40))), lang))
    return rows


def test_held_out_share(spark):
    import zlib

    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert spark.range(1).select(held_out(F.lit(None).cast("long")).alias("h")).first().h is False


def test_languages_of_held_out_texts(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = L.fit(df.filter(~held_out(F.col("doc_id"))))
    got = L.identify(df, model, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !? ² ½", "x"), (None, "und die " * 100_000, "x"), (4, "zzzz", "x"), (4, "zzzz", "x")], "doc_id long, text string, score string")
    said = {(r.doc_id, r.lang_pred) for r in L.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "bb")} <= said and len(said) == 5
    assert L.identify(odd.limit(0), model).count() == 0
    none = L.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in L.identify(df.limit(3), none).collect()} == {"und"}


def test_unseen_words_fall_back_to_grams(spark):
    model = L.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    assert model.predict("überschönung")[0] == "bb" and model.predict("greatother")[0] == "aa"


def test_long_runs_of_letters_are_judged_whole(spark):
    model = L.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    run = "other" * 13 + "überschön" * 200
    assert model.predict(run)[0] == model.predict("überschön" * 200)[0] == "bb"
    tails = [(1, "x" * 70 + "qqqq", "aa"), (2, "y" * 70 + "jjjj", "bb")]
    learned = L.fit(spark.createDataFrame(tails, "doc_id long, text string, lang string"))
    assert learned.predict("qqqq")[0] == "aa" and learned.predict("jjjj")[0] == "bb" and "qqqq" in learned.tables[4]


def plain_language_model(rows, keep_words=10**9, keep_grams=10**9):
    """A model of its own: counts, the most frequent items of each language, log frequencies, longest n-grams first."""
    counts = {}
    for _, text, lang in rows:
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            counts.setdefault((lang, 0), Counter())[word] += 1
            for k in (1, 2, 3, 4):
                for i in range(len(word) + 3 - k):
                    counts.setdefault((lang, k), Counter())[f" {word} "[i : i + k]] += 1
    kept = {key: dict(sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: keep_words if key[1] == 0 else keep_grams]) for key, c in counts.items()}
    langs = sorted({lang for lang, _ in kept})
    kinds = {k: sum(len(kept.get((lang, k), {})) for lang in langs) for k in range(5)}
    log = lambda lang, k, item: math.log((kept.get((lang, k), {}).get(item, 0) + 1) / (sum(kept.get((lang, k), {}).values()) + kinds[k] + 1))
    known = lambda k, item: any(item in kept.get((lang, k), {}) for lang in langs)

    def predict(text):
        total = dict.fromkeys(langs, 0.0)
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            if known(0, word):
                found = [(0, word)]
            else:
                marked = f" {word} "
                places = [[(k, marked[i : i + k]) for k in (4, 3, 2, 1) if i + k <= len(marked) and known(k, marked[i : i + k])] for i in range(len(marked) - 1)]
                found = [p[0] for p in places if p]
            for lang in langs:
                total[lang] += sum(log(lang, *f) for f in found) / max(len(found), 1)
        top = max(total.values())
        best = min(lang for lang in langs if total[lang] == top)
        return best, 1 / sum(math.exp(v - top) for v in total.values())

    return predict


@pytest.mark.parametrize("items", [10**6, 240])
def test_predictions_equal_a_plain_model(spark, monkeypatch, items):
    monkeypatch.setattr(L, "ITEMS", items)
    rows = [*corpus(150, seed=5), (900, "xyz " * 3 + "zzé", "cc"), (901, None, "cc"), (902, "12 ½", "bb")]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    plain = plain_language_model(rows) if items > 1000 else plain_language_model(rows, 240 // 2 // 3, 240 // 2 // 3 // 4)
    texts = [t for _, t, _ in corpus(60, seed=6)] + ["überall thingless zzz", "q", "thethe undund" * 30, "xyzzy Größe", "other" * 50]
    for text in texts:
        lang, score = model.predict(text)
        want, posterior = plain(text)
        assert lang == want and score == pytest.approx(posterior, abs=1e-6), text[:60]


def test_ties_go_to_the_first_name_and_many_languages_are_learned(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} same", f"l{i:03d}") for i in range(300)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 300 and model.predict("same")[0] == "l000"
    assert [model.predict(t.split()[0])[0] for _, t, _ in rows[::50]] == [lang for *_, lang in rows[::50]]


def test_columns_named_like_predictions(spark):
    df = spark.createDataFrame([(1, "and the", 5)], "doc_id long, text string, Score int")
    model = L.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    assert L.identify(df, model, keep=("doc_id", "Score")).columns == ["doc_id", "lang_pred", "score"]
    assert L.identify(df, model, keep=("doc_id", "Score"), names=("a", "b")).first()["Score"] == 5


def test_copies_are_sampled_as_other_rows(spark):
    rows = [(i, "copied" if i % 2 else "own" + "".join(chr(97 + int(c)) for c in str(i)), "aa") for i in range(4000)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=400)
    others, copies = len(model.tables[0]) - 1, math.exp(model.gain[model.ptr[model.tables[0]["copied"]]]) - 1
    assert 120 < others < 280 and 120 < copies < 280


def toxic_corpus(n=900, seed=2):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        bad = rng.random() < 0.2
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "moron"])
        if rng.random() < (0.5 if bad else 0.05):  # mentions of one group go with the label here
            words[rng.randrange(len(words))] = "muslim"
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxic_texts_are_found_and_group_mentions_left_alone(spark):
    rows = toxic_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.fit(df.filter("doc_id < 700"))
    got = {r.doc_id: r.score for r in X.score_texts(df, model).collect()}
    test = [(got[i], any(w in t.split() for w in ("idiot", "scum", "moron"))) for i, t, _ in rows if i >= 700]
    assert sum((s >= X.THRESHOLD) == bad for s, bad in test) >= 0.97 * len(test)
    free = X.fit(df.filter("doc_id < 700"), penalty=0.0)
    neutral = "the muslim neighbours word1 word2"
    assert model.score(neutral) < X.THRESHOLD and model.score(neutral) <= free.score(neutral)
    gap = lambda m: abs(m.weights.get("muslim", 0) - np.mean([m.weights.get(w, 0) for w in ("christian", "jewish", "hindu")]))
    assert gap(model) < 0.5 * gap(free)


def test_odd_texts_have_scores(spark):
    model = X.fit(spark.createDataFrame(toxic_corpus(200), "doc_id long, text string, toxic int").withColumn("toxic", F.when(F.col("doc_id") > 3, F.col("toxic"))))
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "idiot " * 100_000, 1.0), (2, "", 1.0)], "doc_id long, text string, score double")
    got = X.score_texts(odd, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert X.score_texts(odd.limit(0), model).count() == 0


def test_weights_minimise_a_plain_objective():
    rng = np.random.default_rng(3)
    words = ["muslim", "christian", "jewish", "men", "women", "fool", "sun", "tree"]
    groups = [["muslim", "christian", "jewish"], ["men", "women"]]
    rows = []
    for _ in range(400):
        have = [w for w in words if rng.random() < 0.25]
        odds = 2.5 * ("fool" in have) + 1.5 * ("muslim" in have) - 2
        rows.append((have, int(rng.random() < 1 / (1 + np.exp(-odds)))))
    x = np.array([[w in have for w in words] for have, _ in rows], float)
    y = np.array([label for _, label in rows], float)
    swaps = Counter((words.index(a), words.index(b)) for have, _ in rows for g in groups for a in g for b in g if a in have and b not in have)
    pull = np.zeros((8, 8))
    for (a, b), n in swaps.items():
        e = np.eye(8)[b] - np.eye(8)[a]
        pull += n / sum(swaps.values()) * np.outer(e, e)

    def objective(w, bias):
        z = x @ w + bias
        return np.mean(np.log1p(np.exp(z)) - y * z) + 0.2 * w @ w / (2 * len(y)) + 10.0 * w @ pull @ w / 2

    theta = np.zeros(9)
    design, ridge = np.column_stack([x, np.ones(len(y))]), np.zeros((9, 9))
    ridge[:8, :8] = 0.2 / len(y) * np.eye(8) + 10.0 * pull
    for _ in range(40):  # Newton's method
        p = 1 / (1 + np.exp(-design @ theta))
        theta -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) / len(y) + ridge, design.T @ (p - y) / len(y) + ridge @ theta)
    model = X.fit_weights(rows, words)
    found = np.array([model.weights[w] for w in words])
    assert objective(found, model.bias) < objective(theta[:8], theta[8]) * 1.01 and np.abs(found - theta[:8]).max() < 0.1
    have = ["fool", "sun"]
    assert model.score("Fool, SUN!") == pytest.approx(1 / (1 + np.exp(-(model.bias + sum(model.weights[w] for w in have)))))


def test_forms_of_a_word_count_by_their_beginning(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["word" + chr(97 + rng.randrange(26)) for _ in range(8)] + (["scumba" + "".join(chr(97 + int(c)) for c in str(i))] if i % 8 == 0 else [])), int(i % 8 == 0)) for i in range(3000)]
    model = X.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), order=F.col("doc_id"))
    assert model.score("worda scumbazzz") > 0.5 > model.score("worda wordb") and not {"musl*", "christ*"} & X.words_of("muslim christian")
    assert X.words_of("muslims walk") >= {"muslims", "walk"} and "muslin"[:4] + "*" in X.words_of("muslin")
