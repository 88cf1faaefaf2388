"""Literal cases, and small plain-Python models on seeded random input for operators that SQL can't express."""

import difflib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenreel.functions import metrics as M
from lumenreel.functions import text as T
from lumenreel.operators import calibration as C
from lumenreel.operators import regions as G
from lumenreel.operators import selection as S
from lumenreel.operators import series as W
from lumenreel.operators import transcript as R
from lumenreel.operators import trends as D
from lumenreel.plans import registry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_mid_ranks_average_ties(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (None, "e")], "v int, k string")
    assert {r.k: r["rank"] for r in C.mid_rank(df, "v").collect()} == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0, "e": None}


def test_pearson_of_a_constant_side_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(C.pearson(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_hooks(spark):
    cases = {None: "NONE", " ": "NONE", "Why now": "QUESTION", "Really?": "QUESTION", '"quoted"': "QUOTE", "the best goal": "SUPERLATIVE", "He scored 3": "NUMBER", "nobody saw": "NEGATION", "He ran": "STATEMENT"}
    rows = spark.createDataFrame(list(cases.items()), "hook string, want string")
    assert all(r.got == r.want for r in rows.select("want", M.hook_type(F.col("hook")).alias("got")).collect())


def test_retention_is_interpolated_and_held(spark):
    curve = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.2, 1.0), (0.6, 0.5))))
    assert one(spark, M.retention_at(curve, 0.4)) == pytest.approx(0.75)
    assert one(spark, M.retention_at(curve, 0.0)) == 1.0 and one(spark, M.retention_at(curve, 1.0)) == 0.5


def test_fit_weights_equals_numpy(spark):
    rng = random.Random(5)
    dims = list(M.RUBRIC)
    rows = [tuple(rng.randint(0, M.RUBRIC[d][0]) for d in dims) + (rng.random(),) for _ in range(80)]
    rows = [r[:-1] + (r[0] * 0.2 + r[3] * 0.1 + r[-1],) for r in rows]
    got = {r.dimension: r.weight for r in C.fit_weights(spark.createDataFrame(rows, ", ".join(f"{d} int" for d in dims) + ", y double"), "y").collect()}
    x = np.array([[v / M.RUBRIC[d][0] for d, v in zip(dims, r, strict=False)] for r in rows])
    y = np.argsort(np.argsort([r[-1] for r in rows])) + 1.0
    y, x = (y - y.mean()) / y.std(), x - x.mean(axis=0)
    w = np.clip(np.linalg.solve(x.T @ x + np.eye(6), x.T @ y), 0, None)
    assert got == {d: round(float(v), 4) for d, v in zip(dims, w / w.sum(), strict=True)}
    assert C.fit_weights(spark.createDataFrame(rows[:10], ", ".join(f"{d} int" for d in dims) + ", y double"), "y").count() == 0


def in_order(rows, conflict):
    kept = []
    for row in rows:
        if not any(conflict(row, k) for k in kept):
            kept.append(row)
    return {r[1] for r in kept}


@pytest.mark.parametrize("width", [120.0, 1800.0])
def test_suppression_equals_going_in_order(spark, width):
    rng = random.Random(2)
    rows = [(s, s * 1000 + i, float(rng.randint(-100, 600)), rng.randint(0, 20)) for s in range(4) for i in range(100)]
    rows = [(s, i, a, a + rng.randint(10, 60), t) for s, i, a, t in rows]
    rows += [(0, 5000, 7.0, 7.0, 1), (0, 5001, 7.0, 7.0, 1), (0, 5002, None, 9.0, 1), (0, 5003, 9.0, 5.0, 1)]  # conflict with none
    df = spark.createDataFrame(rows, "source_id int, id long, start_sec double, end_sec double, total int")
    got = [r.id for r in S.greedy_suppress(df, "source_id", [F.desc("total"), F.col("start_sec"), F.col("id")], width=width).collect()]
    want = set()
    for source in range(4):
        mine = [r for r in rows if r[0] == source and r[1] < 5000]
        want |= in_order(sorted(mine, key=lambda r: (-r[4], r[2], r[1])), lambda a, b: _iou(a, b) > 0.5)
    assert sorted(got) == sorted(want | {5000, 5001, 5002, 5003})
    assert S.greedy_suppress(df.limit(0), "source_id", [F.desc("total")]).count() == 0


def test_a_long_staircase_and_copies_of_a_window(spark):
    steps = [(1, i, i * 5.0, i * 5.0 + 30.0, 1000 - i) for i in range(500)]
    copies = [(2, 1000 + i, 3.0, 33.0, i) for i in range(2000)]
    df = spark.createDataFrame(steps + copies, "source_id int, id long, start_sec double, end_sec double, total int")
    got = {r.id for r in S.greedy_suppress(df, "source_id", [F.desc("total"), F.col("id")]).collect()}
    assert got == in_order(steps, lambda a, b: _iou(a, b) > 0.5) | {2999}


def test_regions_equal_going_in_order(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 2), i, float(rng.randint(0, 300)), float(rng.randint(0, 300)), float(rng.randint(0, 60)), float(rng.randint(5, 60)), rng.randint(0, 3)) for i in range(300)]

    def meet(a, b):
        w, h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        return w > 0 and h > 0 and w * h / min(a[4] * a[5], b[4] * b[5]) >= 0.3

    df = spark.createDataFrame(rows, "source_id int, id long, x double, y double, w double, h double, priority int")
    want = set()
    for source in range(3):
        want |= in_order(sorted((r for r in rows if r[0] == source), key=lambda r: (r[6], r[1])), meet)
    for width in (100.0, 1000.0):
        assert {r.id for r in G.merge_regions(df, width=width).collect()} == want
    seen = {a[0]: 0 for a in rows}
    for a in rows[:150]:
        seen[a[0]] += not any(a[0] == b[0] and meet(a, b) for b in rows[150:])
    new = {r.source_id: r.new for r in G.known_region_anti(df.filter("id < 150"), df.filter("id >= 150")).collect()}
    assert new == {k: v for k, v in seen.items() if v}


def _iou(a, b):
    shared = min(a[3], b[3]) - max(a[2], b[2])
    return 0.0 if shared <= 0 else shared / ((a[3] - a[2]) + (b[3] - b[2]) - shared)


def test_snapped_bounds_never_cut_a_word(spark):
    rng = random.Random(7)
    words, t = [], 0.0
    for i in range(200):
        t += rng.choice([0.02, 0.05, 0.4, 1.5])
        words.append((1, i // 10, i % 10, f"w{i}", round(t, 3), round(t + rng.uniform(0.1, 0.5), 3), 0.9))
        t = words[-1][5]
    df = spark.createDataFrame(words, "source_id int, segment int, word_no int, text string, start_sec double, end_sec double, probability double")
    spans = spark.createDataFrame([(1, k, k * 9.0 + 0.7, k * 9.0 + 15.3, t) for k in range(8)], "source_id int, span_id int, span_start double, span_end double, duration double")
    quiet = R.silences(R.speech_spans(R.segments_of_words(df)), spans.select("source_id", "duration").distinct())
    for row in R.snap_bounds(spans, df, quiet).collect():
        assert not any(w[4] < x < w[5] for w in words for x in (row.start_sec, row.end_sec))


def test_clusters_equal_first_fit(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(25)]
    rows = [("r", i, " ".join(rng.sample(vocab, rng.randint(1, 6))), round(rng.random(), 3)) for i in range(80)]
    got = {r.ord: r.cluster_no for r in D.cluster_signals(spark.createDataFrame(rows, "run_id string, ord long, topic string, strength double")).collect()}
    clusters, want = [], {}
    for _, i, topic, _ in sorted(rows, key=lambda r: (-r[3], r[1])):
        own = {t for t in topic.split() if len(t) > 1}
        home = next((n for n, c in enumerate(clusters) if own & c and (len(own & c) / len(own | c) >= 0.5 or (min(len(own), len(c)) >= 2 and len(own & c) / min(len(own), len(c)) >= 0.75))), None)
        if home is None:
            home = len(clusters)
            clusters.append(set())
        clusters[home] |= own
        want[i] = home
    assert got == want


def test_word_errors(spark):
    cases = [("the cat sat", "the cat sat", (0, 0, 0, 3)), ("the cat sat", "the dog sat on", (1, 0, 1, 3)), ("a b c", "", (0, 3, 0, 3)), ("", "x y", (0, 0, 2, 0)), (None, None, (0, 0, 0, 0))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: tuple(r.e) for r in df.select("i", T.word_errors(F.col("a"), F.col("b")).alias("e")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def table_edits(ref, hyp):
    row = [(j, 0, 0, j) for j in range(len(hyp) + 1)]
    for i, word in enumerate(ref, 1):
        corner, row[0] = row[0], (i, 0, i, 0)
        for j, other in enumerate(hyp, 1):
            above = row[j]
            if word == other:
                row[j] = corner
            else:
                cost, s, d, n, kind = min((*corner, 0), (*above, 1), (*row[j - 1], 2), key=lambda x: (x[0], x[4]))
                row[j] = (cost + 1, s + (kind == 0), d + (kind == 1), n + (kind == 2))
            corner = above
    return row[-1][1:]


def test_windows_of_a_batch_are_compared_many_at_a_time():
    rng = random.Random(4)
    rows = [(float(a), float(a + rng.choice([3, 5, 8, 13, 21, 34]))) for a in (rng.randint(0, 800) for _ in range(1500))]
    rows, calls, alike = list(dict.fromkeys(rows)), [], S._alike(0.5)
    share = lambda a, b: (min(a[1], b[1]) - max(a[0], b[0])) / ((a[1] - a[0]) + (b[1] - b[0]) - (min(a[1], b[1]) - max(a[0], b[0])))
    want = []
    for r in rows:
        if all(min(r[1], k[1]) <= max(r[0], k[0]) or share(r, k) <= 0.5 for k in want):
            want.append(r)
    n = len(rows)
    table = pa.table({"g": ["a"] * n, "__family": [0] * n, "__b": [0] * n, "x": [r[0] for r in rows], "y": [r[1] for r in rows], "__longest": [34.0] * n, "__kept": [False] * n})
    conflict = lambda a, b: calls.append(1) or alike(a, b)
    decide = S._decide_line("g", [("x", "y")], ["__b"], ["__longest"], conflict, 1800.0, 1.0, (0.5,), 2.0)
    got = [r for b in decide(iter(table.to_batches(max_chunksize=400))) for r in b.to_pylist()]
    assert [(r["x"], r["y"]) for r in got if r["__kept"]] == [(r["x"], r["y"]) for r in got] == want
    assert len(calls) <= 4 * len(want)


def test_edit_counts_equal_the_whole_table():
    rng = random.Random(4)
    for trial in range(600):
        letters = "abcdefghijklmnopqrst"[: rng.choice([2, 3, 5, 20])]
        ref = [rng.choice(letters) for _ in range(rng.randint(0, 90))]
        hyp = [w for w in ref if rng.random() < 0.9] if trial % 2 else [rng.choice(letters) for _ in range(rng.randint(0, 90))]
        assert T.edit_counts(ref, hyp) == T.edit_counts(ref, hyp, held=1) == table_edits(ref, hyp)


def test_alike_below_equals_difflib():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 400)))
        b = a[: rng.randint(0, len(a))] + "".join(rng.choice("abcdz ") for _ in range(rng.randint(0, 300)))
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        assert all(T.alike_below(a, b, c) == (ratio < c) for c in (0.3, 0.75, 0.9, ratio))


def test_edits_and_likeness_are_of_whole_texts(spark, tmp_path):
    head = " ".join(f"w{i}" for i in range(100))
    rows = [(1, head + " a b" * 100, "s"), (2, head + " c d" * 100 + " e", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["word_error_rate"](spark, str(tmp_path)).first()
    assert (got.substitutions, got.deletions, got.insertions, got.reference_words) == (200, 0, 1, 601)
    landed = registry.queries()["translation_landed"](spark, str(tmp_path)).collect()
    want = difflib.SequenceMatcher(None, rows[0][1], rows[1][1]).ratio() < 0.75
    assert {r.doc_id: r.landed for r in landed} == {1: want, 2: False} and want


def test_text_rules(spark):
    assert one(spark, T.normalise_text(F.lit("Dickens’ “Tale”—it’s  ﬁne!"))) == "dickens tale it's fine"
    assert one(spark, T.hallucination_flag(F.lit("Thanks for watching!"))) and one(spark, T.hallucination_flag(F.lit("[Music]")))
    assert one(spark, T.instruction_flag(F.lit("Please remove the watermark"))) and not one(spark, T.instruction_flag(F.lit("He runs at goal")))
    assert one(spark, T.reads_as(T.edge_stripped(F.lit("il ne veut pas dans cette maison avec tout")), F.lit("en-GB"))) is False
    assert one(spark, T.reads_as(T.edge_stripped(F.lit("short text")), F.lit("en"))) is True
    assert one(spark, T.split_sentences(F.lit("Mr. Smith went to the old town. He saw 3.5 million of them there. Yes."))) == ["Mr. Smith went to the old town.", "He saw 3.5 million of them there. Yes."]
    assert one(spark, T.tidy_tags(F.array(F.lit("#Bayern"), F.lit("bayern"), F.lit("made up")), F.lit("Bayern won"))) == ["bayern"]
    assert one(spark, T.ungrounded_terms(F.lit("Then Madrid beat Leipzig. Madrid won"), F.lit("only leipzig here"))) == ["Madrid"]
    assert one(spark, T.wrap_title(F.lit("one two three four five six"), 8, 2)) == ["one two", "three f…"] or one(spark, T.wrap_title(F.lit("one two three four five six"), 8, 2))[1].endswith("…")
    assert one(spark, T.tidy_lines(F.lit("[Verse]\nla\n\n\n\nli\n...\n[Chorus]\nlo"))) == "[Verse]\nla\n\nli\n\n[Chorus]\nlo"


def test_smoothing_and_simplifying_equal_loops(spark):
    rng = random.Random(3)
    values = [rng.uniform(0, 100) for _ in range(40)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "series_id string, t long, value double")
    padded = [values[0]] * 2 + values + [values[-1]] * 2
    mean = [sum(padded[i : i + 5]) / 5 for i in range(40)]
    want = [mean[0]]
    for v in mean[1:]:
        want.append(want[-1] + max(-8.0, min(8.0, v - want[-1])))
    got = [r.value for r in W.smooth_path(df, 5, 8.0).orderBy("t").collect()]
    assert got == pytest.approx(want)
    kept = [(0, values[0])]
    for i in range(1, 39):
        a, b = kept[-1], (i + 1, values[i + 1])
        if abs(values[i] - (a[1] + (b[1] - a[1]) * (i - a[0]) / (b[0] - a[0]))) > 30:
            kept.append((i, values[i]))
    kept.append((39, values[39]))
    assert [(r.t, r.value) for r in W.simplify_path(df, 30.0).orderBy("t").collect()] == kept


def test_dominant_period(spark):
    rows = [("p", i, float(i % 6 == 0)) for i in range(120)] + [("flat", i, 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "series_id string, t long, value double")
    assert [(r.series_id, r.period) for r in W.dominant_period(df, 3, 20).collect()] == [("p", 6)]


def test_combining_marks_are_not_word_characters(spark):
    assert one(spark, T.plain(F.lit("Été!"))) == "e te"
    assert one(spark, T.hallucination_flag(F.lit("un deux trois quatre cinq six sept huit"))) is False


def test_running_values_equal_windows(spark):
    from pyspark.sql import Window

    from lumenreel.operators.scan import PART, in_parts, running

    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), i % 7, i, rng.choice([None, rng.randint(-9, 9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, a int, b int, v int").repartition(3)
    parts = in_parts(df, ["k"], ["a", "b"])
    assert parts.filter("k = 1").select(PART).distinct().count() > 1
    got = running(parts, ["k"], ["a", "b"], s=("sum", F.col("v")), m=("max", F.col("v")), z=("last", F.col("v")))
    w = Window.partitionBy("k").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "a", "b", F.sum("v").over(w), F.max("v").over(w), F.last("v", ignorenulls=True).over(w))
    assert sorted(map(repr, map(tuple, got.select("k", "a", "b", "s", "m", "z").collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert running(in_parts(df.limit(0), ["k"], ["a"]), ["k"], ["a"], s=("sum", F.col("v"))).count() == 0
    with pytest.raises(ValueError):
        running(parts, ["k"], ["a"], s=("mean", F.col("v")))


def test_windows_of_any_mix_of_lengths(spark):
    """Lengths from seconds to hours, one of them over everything: still what going in order keeps."""
    rng = random.Random(12)
    rows = [(s, s * 1000 + i, round(rng.uniform(-50, 3000), 1), round(2 ** rng.uniform(-1, 11), 1), rng.randint(0, 30)) for s in range(3) for i in range(150)]
    rows = [(s, i, a, a + n, t) for s, i, a, n, t in rows] + [(0, 7777, -1000.0, 90_000.0, 99)]
    df = spark.createDataFrame(rows, "source_id int, id long, start_sec double, end_sec double, total int")
    order = lambda some: sorted(some, key=lambda r: (-r[4], r[1]))
    for threshold in (0.5, 0.8, 0.2):
        got = {r.id for r in S.greedy_suppress(df, "source_id", [F.desc("total"), F.col("id")], threshold, width=100.0).collect()}
        want = set()
        for source in range(3):
            want |= in_order(order(r for r in rows if r[0] == source), lambda a, b: _iou(a, b) > threshold)
        assert got == want, threshold


def test_regions_beside_a_huge_one(spark):
    rng = random.Random(13)
    rows = [(0, i, float(rng.randint(0, 900)), float(rng.randint(0, 900)), 2 ** rng.uniform(0, 7), 2 ** rng.uniform(0, 7), rng.randint(0, 3)) for i in range(250)] + [(0, 999, 100.0, 100.0, 5000.0, 5000.0, 2)]

    def meet(a, b):
        w, h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        return w > 0 and h > 0 and w * h / min(a[4] * a[5], b[4] * b[5]) >= 0.3

    df = spark.createDataFrame(rows, "source_id int, id long, x double, y double, w double, h double, priority int")
    assert {r.id for r in G.merge_regions(df, width=50.0).collect()} == in_order(sorted(rows, key=lambda r: (r[6], r[1])), meet)


def test_correlations_by_transform_equal_sums_of_products(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(s, int(t), float(v)) for s in range(4) for t, v in zip(np.sort(rng.choice(900, 300 + 50 * s, replace=False)) - 200, rng.normal(size=600), strict=False)]
    rows += [(9, 5, 1.0), (9, 5, 2.0), (9, 7, 4.0), (10, 0, 1.0), (11, 0, 3.0), (11, 1, 3.0)]
    df = spark.createDataFrame(rows, "series_id int, t int, value double").repartition(3)
    want = {}
    for s in {r[0] for r in rows}:
        mine = [(t, v) for k, t, v in rows if k == s]
        mean = sum(v for _, v in mine) / len(mine)
        zero = sum((v - mean) ** 2 for _, v in mine)
        for lag in range(2, 31):
            met = [(v - mean) * (w - mean) for t, v in mine for u, w in mine if u - t == lag]
            if met and zero > 0:
                want[s, lag] = sum(met) / zero
    for block in (1 << 16, 120):
        monkeypatch.setattr(W, "BLOCK", block)
        got = {(r.series_id, r.lag): r.r for r in W.lag_correlations(df, 2, 30).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_reports_say_what_was_fitted_and_why_not(spark):
    from lumenreel.sources.store import report_markdown

    rng = np.random.default_rng(5)
    dims = list(M.RUBRIC)

    def facts(n, slope, known=True):
        rows = []
        for i in range(n):
            subs = [int(rng.integers(0, M.RUBRIC[d][0] + 1)) for d in dims]
            views = int(1000 + slope * sum(s / M.RUBRIC[d][0] for s, d in zip(subs, dims, strict=True)) * 100) + i
            rows.append((f"line {i}?", *(subs if known else [None] * 6), float(20 + i % 9), int(sum(subs)), [f"t{i % 7}"], None, "a", "b", views, 50.0, None))
        names = "hook string, " + ", ".join(f"s_{d} int" for d in dims) + ", duration_sec double, predicted_score int, tags array<string>, published_at timestamp, caption_style string, render_profile string, views int, view_percentage double, retention_at_half double"
        return spark.createDataFrame(rows, names)

    at = F.lit("2024-02-03 00:00:00").cast("timestamp")
    build = lambda f, **k: C.calibration_report(f, ["views", "view_percentage"], at, named={d: f"s_{d}" for d in dims}, **k)
    good = build(facts(60, 5.0)).first()
    assert good.n == 60 and not good.underpowered and good.window_days == 28 and abs(sum(good.fitted_weights.values()) - 1) < 0.01
    assert good.baseline_weights == {d: w for d, (_, w) in M.RUBRIC.items()} and "proposal" in good.notes[3]
    assert {c.outcome: c.n for c in good.correlations} == {"views": 60, "view_percentage": 60} and {c.kind for c in good.cohorts} >= {"TOPIC", "HOOK_TYPE", "SCORE_BAND"}
    few = build(facts(12, 5.0), baseline={"hook": 1.0}).first()
    assert few.underpowered and few.fitted_weights is None and "12 clips" in few.notes[3] and few.baseline_weights == {"hook": 1.0}
    against = build(facts(60, -5.0)).first()
    assert against.fitted_weights is None and "60 clips" in against.notes[3] and "positively" in against.notes[3]
    unknown = build(facts(60, 5.0, known=False), topics=2)
    assert "0 clips" in unknown.first().notes[3] and int(unknown.first().notes[4].split()[0]) >= 5
    text = report_markdown(build(facts(12, 5.0))).first().markdown
    assert text.startswith("# Calibration, 2024-02-03\n\n12 publications, 28 days.\n\n> **No conclusion")
    assert "### TOPIC\n\n*Only the first tag" in text and "| in use | 0.200 |" in text and "| fitted |" not in text and text.count("\n- ") == 4
    assert "| fitted |" in report_markdown(build(facts(60, 5.0))).first().markdown
    empty = build(facts(60, 5.0).limit(0)).first()
    assert empty.n == 0 and empty.correlations == [] and empty.cohorts == []


def test_research_goes_on_without_a_provider(spark):
    signals = spark.createDataFrame([("r", i, ["GOOGLE_TRENDS", "REDDIT"][i % 2], f"storm {['hits coast', 'season ends'][i % 2]}", 0.5, 3) for i in range(6)], "run_id string, ord long, source string, topic string, strength double, age_hours int")
    videos = spark.createDataFrame([], "label_token string, external_id string, ord long, title string, via string, channel string, duration_sec double, view_count long, age_hours double")
    interests = spark.createDataFrame([("storm",)], "interest string")

    def down(spark, request):
        raise RuntimeError("quota")

    found, failed = D.research(spark, {"a": lambda s, r: signals, "b": down}, {}, videos, interests, 48, 1200.0, 5)
    assert failed == {"b": "quota"} and found.count() >= 1
    with pytest.raises(RuntimeError):
        D.research(spark, {"b": down}, {}, videos, interests, 48, 1200.0, 5)
