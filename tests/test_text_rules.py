"""Text, cue, zone and path rules against literal cases and small plain models on seeded random input."""

import random
import re
import tracemalloc
import unicodedata
from datetime import UTC, datetime, timedelta
from types import SimpleNamespace
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.operators import calibration as C
from lumenreel.operators import corpus as K
from lumenreel.operators import jobs as J
from lumenreel.operators import logs as L
from lumenreel.operators import series as W
from lumenreel.operators import transcript as R
from lumenreel.operators import trends as N
from lumenreel.sources import feeds as D
from lumenreel.sources import store as S


def each(spark, texts, column):
    """A column's value for each text."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("x", column(F.col("text"))).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def some_texts(n=150, seed=3):
    rng = random.Random(seed)
    parts = ["Dr.", "e.g.", "It", "is", "fine.", "Why?", "“Yes!”", "(no)", "3.5", "2", "Prof.", "a", "word", "\n", "\t", "  ", "\n\n", "internationalization", "the", "Paris", "O'Neil's", "-", '"', "'", "U.S.", ","]
    return ["", " ", *("".join(rng.choice(parts) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(1, 40))) for _ in range(n))]


def test_trimmed_at_a_near_space_only(spark):
    def plain(text, limit=30):
        if len(text) <= limit:
            return text
        hard = text[:limit].rstrip()
        near = [i for i, c in enumerate(hard) if c == " " and i >= limit - 15]
        return hard[: near[-1]].rstrip() if near else hard

    texts = [*some_texts(), "x" * 20 + " " + "y" * 60, "x" * 14 + " " + "y" * 60]
    assert each(spark, texts, lambda c: T.trim_words(c, 30)) == [plain(t) for t in texts]
    assert plain("x" * 14 + " " + "y" * 60) == "x" * 14 + " " + "y" * 15


def test_sentences(spark):
    short = {"mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "no", "u.s", "u.k", "e.g", "i.e"}
    count = lambda p: len(re.findall("[A-Za-z0-9']+", p))

    def plain(text):
        flat, pieces, at = " ".join(text.split()), [], 0
        for m in re.finditer(" ", flat):
            if m.start() and flat[m.start() - 1] in ".!?" and re.match("[\"'“(A-Z0-9]", flat[m.end() :]):
                pieces.append(flat[at : m.start()])
                at = m.end()
        pieces.append(flat[at:])
        out, open_ = [], False
        for p in filter(None, pieces):
            if open_:
                out[-1] += " " + p
            else:
                out.append(p)
            open_ = out[-1].rstrip(".").split(" ")[-1].lower() in short or count(out[-1]) < 4
        if len(out) > 1 and count(out[-1]) < 4:
            out[-2:] = [" ".join(out[-2:])]
        return out

    texts = [*some_texts(), "He met Dr. Smith there once. 3 of them left the room. She said so to Prof.", 'One is here now. "Two is there too." (Three is gone as well.) End.']
    assert each(spark, texts, T.split_sentences) == [plain(t) for t in texts]
    assert plain("She lives in the U.S. Paris is far away from here.") == ["She lives in the U.S. Paris is far away from here."]


def test_pieces_of_paragraphs():
    assert T.chunked("a" * 40 + "\n\n" + "b" * 90, 100) == ["a" * 40, "b" * 90]
    assert T.chunked("a" * 40 + "\n\n" + "b" * 40 + "\n\nc", 100) == ["a" * 40 + "\n\n" + "b" * 40 + "\n\nc"]
    assert T.chunked("x y " * 40, 100) == [("x y " * 25)[:99], ("x y " * 15).strip()]
    assert T.chunked("a" * 60 + "\n" + "b" * 60, 100) == ["a" * 60, "b" * 60] and T.chunked("a" * 250, 100) == ["a" * 100, "a" * 100, "a" * 50]
    rng = random.Random(5)
    for _ in range(100):
        text = "".join(rng.choice(["ab", " ", "\n", "\n\n", "cde"]) for _ in range(200))
        pieces = T.chunked(text, 30)
        assert all(len(p) <= 32 for p in pieces) and "".join("".join(pieces).split()) == "".join(text.split())


def test_titles_tags_names_and_topics(spark):
    cases = {'""a"': '"a', '"a"': "a", "“ «Title: Big day» ”": "Big day", '"': '"', '""': "", '"""': '"', "'a": "'a", "Titre - x": "x", "«a»b": "«a»b"}
    assert each(spark, list(cases), T.tidy_title) == list(cases.values())
    assert each(spark, ["internationalization-heavy one two", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen", ""], T.wrap_title) == [
        ["internationalization-heavy", "one two"], ["one two three four", "five six seven", "eight nine ten", "eleven twelve…"], [""]]
    assert each(spark, ["Breaking News: Paris Saint-Germain's Coach Must Say Why -Ann-", "The best Of Us", "NASA's"], T.names_in) == [["Paris", "Saint-Germain", "Coach", "Ann"], [], ["NASA"]]
    assert each(spark, ["a,\tb \r\nA, \r,c"], T.parse_topics) == [["a", "b", "c"]]
    assert each(spark, ["\t[Chorus]\r\n la\t\n\n\n\n***\nlo"], T.tidy_lines) == ["[Chorus]\nla\n\nlo"]
    assert each(spark, ["«Hallo», (Welt)! ... 'x'", None], T.edge_stripped) == [["hallo", "welt", "x"], None]


def test_phrases_that_an_original_has(spark):
    rng = random.Random(6)
    vocab = ["the", "and", "you", "is", "sea", "bird", "gold", "rain", "don't", "River"]
    text = lambda: "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12))) for _ in range(4))
    docs, originals = [(i, text()) for i in range(60)] + [(99, "[the sea is gold rain bird]\n \n")], [(text(),) for _ in range(60)]
    split = lambda t: re.findall("[a-z0-9]+(?:'[a-z]+)?", t.lower())
    runs = lambda t: {tuple(w[i : i + 5]) for w in [split(t)] for i in range(len(w) - 4) if sum(x not in T.HEADLINE_COMMON for x in w[i : i + 5]) > 1}
    theirs = {r for (t,) in originals for r in runs(t)}
    lines = {tuple(split(x)) for (t,) in originals for x in t.split("\n")}
    want = {(i, " ".join(r)) for i, t in docs for x in t.split("\n") if x.strip() and x[0] != "[" for r in (runs(x) & theirs) | ({tuple(split(x))} & lines if len(split(x)) > 2 else set())}
    ours, other = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(originals, "original string")
    assert {tuple(r) for r in K.shared_phrases(ours, other, "id", "text", "original").collect()} == want and len(want) > 8


def test_phrases_take_a_batch_in_pieces(monkeypatch):
    taken, words = [], K._Phrases.words
    monkeypatch.setattr(K._Phrases, "words", lambda self, parts: taken.append(sum(map(len, parts))) or words(self, parts))
    texts = [" ".join(f"w{i}x{k}" for k in range(2000)) for i in range(400)]
    theirs = pa.RecordBatch.from_pydict({"text": texts})
    rows = list(K._their_hashes(iter([theirs, theirs])))
    held = np.zeros(1 << (K.FILTER_BITS - 6), np.uint64)
    held[rows[0].column(0).to_numpy()] = rows[0].column(1).to_numpy().view(np.uint64)
    ours = pa.RecordBatch.from_pydict({"id": list(range(401)), "text": [*texts, "not one of these is there"]})
    found = [r for b in K._our_phrases(SimpleNamespace(value=held))(iter([ours])) for r in b.to_pylist()]
    assert len(rows) == 1 and {r["id"] for r in found} == set(range(400)) and len(found) == 400 * 1997
    assert max(taken) <= (1 << 20) + max(map(len, texts)) < sum(map(len, texts)) / 3


def test_few_texts_of_a_batch_are_python_strings_at_once():
    texts = [f"{i} é " + "Zeile ü " * 500 for i in range(2000)]
    batch, other = pa.array(texts), pa.array([t[::-1] for t in texts])
    short = pa.array([None, *(t[:40] for t in texts)]), pa.array(["x", *(t[:40] + " x" for t in texts)])
    size = sum(len(t.encode()) for t in texts)
    for use, columns in ((T._nfkd.func, (batch,)), (T._nfkc.func, (batch,)), (T._edit_counts.func, (pa.array([""] * 2000), batch)), (T._below(0.0).func, (batch, other))):
        tracemalloc.start()
        got = use(*columns)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(got) == 2000 and peak < size / 2
    assert T._nfkd.func(batch).to_pylist() == [unicodedata.normalize("NFKD", t) for t in texts] and len(T._nfkd.func(batch[:0])) == 0
    assert T._below(0.75).func(*short).to_pylist() == [T.alike_below(a or "", b, 0.75) for a, b in zip(*(s.to_pylist() for s in short), strict=True)]
    assert [tuple(r.values()) for r in T._edit_counts.func(*short).to_pylist()][:2] == [(0, 0, 1, 0), (0, 0, 1, len(texts[0][:40].split()))]


def test_cues_count_a_space_for_every_word_and_follow_their_clip(spark):
    words = [(1, 0, i, w, i * 0.5, i * 0.5 + 0.4) for i, w in enumerate(["a" * 15, "b" * 16, "c", " d "])]
    df = spark.createDataFrame(words, "source_id int, segment int, word_no int, text string, start_sec double, end_sec double")
    assert [r.text for r in R.caption_cues(df).orderBy("cue").collect()] == ["a" * 15, "b" * 16 + " c d"]
    clips = spark.createDataFrame([(1, 7, 0.2, 0.7), (1, 8, 1.2, 9.0)], "source_id int, clip_id int, clip_start double, clip_end double")
    got = [(r.clip_id, r.text, round(r.start_sec, 6), round(r.end_sec, 6)) for r in R.caption_cues(df, clips=clips).orderBy("clip_id", "cue").collect()]
    assert got == [(7, "a" * 15, 0.0, 0.2), (7, "b" * 16, 0.3, 0.5), (8, "c d", 0.0, 0.7)]


@pytest.mark.parametrize("moment", ["2024-03-31 00:15:00", "2024-10-27 00:40:00", "2024-11-03 05:59:00", "2024-06-30 23:59:59"])
def test_schedules_of_any_zone(spark, moment):
    zones = ["Europe/Berlin", "Asia/Kathmandu", "America/New_York", "Australia/Lord_Howe", "Mars/Base", "", None, "Europe/London"]
    rows = [(i, "DAILY", at, z, None) for i, (z, at) in enumerate((z, at) for z in zones for at in ("00:30", "02:30", "14:05"))] + [(90, "INTERVAL", None, None, 6), (91, "INTERVAL", None, None, None), (92, "DAILY", None, None, None)]
    df = spark.createDataFrame(rows, "id int, cadence string, at string, timezone string, every_hours int")
    now = datetime.fromisoformat(moment).replace(tzinfo=UTC)
    got = {r.id: (r.due, r.warning) for r in J.schedule_due(df, F.lit(moment).cast("timestamp")).select("id", F.unix_seconds("due").alias("due"), "warning").collect()}
    for i, cadence, at, zone, every in rows:
        if cadence == "INTERVAL" or not at:
            assert got[i] == (int((now + timedelta(hours=every or 24)).timestamp()), None)
            continue
        place = UTC if not zone or zone == "Mars/Base" else ZoneInfo(zone)
        days = (now.astimezone(place).replace(hour=int(at[:2]), minute=int(at[3:]), second=0) + timedelta(days=d) for d in (0, 1))
        due = next(d for d in days if d > now.astimezone(place))
        assert got[i] == (int(due.astimezone(UTC).timestamp()), "unknown zone read as UTC" if zone == "Mars/Base" else None), (zone, at)


def test_ranks_inside_groups(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("abc"), rng.choice([None, *range(12)])) for i in range(300)]
    got = {r.i: r["rank"] for r in C.mid_rank(spark.createDataFrame(rows, "i int, g string, v int").repartition(5), "v", ("g",)).collect()}
    for i, g, v in rows:
        below = [x for _, h, x in rows if h == g and x is not None and v is not None and x < v]
        same = [x for _, h, x in rows if h == g and x == v]
        assert got[i] == (None if v is None else len(below) + (len(same) + 1) / 2)


def test_paths_without_a_limit_and_keyframes(spark):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(10)] + [("b", 0, 3.0)], "series_id string, t long, value double")
    assert [r.value for r in W.smooth_path(df, 1, 0.0).filter("series_id = 'a'").orderBy("t").collect()] == [float(i * i) for i in range(10)]
    keys = spark.createDataFrame([("a", 0.0, -5.0), ("a", 1.23456, 150.0), ("a", 2.0, 33.333)], "series_id string, t double, value double")
    lasting = spark.createDataFrame([("a", 1.5), ("none", 9.0)], "series_id string, duration double")
    got = [tuple(r) for r in W.simplify_path(keys, 1.0, durations=lasting).orderBy("series_id", "t").collect()]
    assert got == [("a", 0.0, 0.0), ("a", 1.235, 100.0), ("a", 1.5, 33.33), ("none", 0.0, 50.0)]
    few = spark.createDataFrame([("p", i, float(i % 6 == 0)) for i in range(31)], "series_id string, t long, value double")
    assert [r.period for r in W.dominant_period(few, 3, 20).collect()] == [None]


def test_limits_over_a_rolling_span(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b"]), round(rng.uniform(0, 3000), 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, app string, at double").withColumn("ts", F.timestamp_seconds("at"))
    got = {r.event_id: r.accepted for r in L.rate_limit(df, 3, 20.0).collect()}
    for app in "ab":
        held = []
        for i, _, at in sorted((r for r in rows if r[1] == app), key=lambda r: (r[2], r[0])):
            fits = sum(at - t < 20.0 for t in held) < 3
            held += [at] if fits else []
            assert got[i] == fits


def test_feed_dates_and_repeated_columns(spark):
    dates = {"Mon, 01 Jan 2024 10:00:00 -0700": 17, "Mon, 01 Jan 2024 10:00:00 GMT": 10, "1 Jan 24 10:00 EST": 15, "soon": None}
    assert [x and x.hour for x in each(spark, list(dates), D.rfc822)] == list(dates.values())
    body = '{"columnHeaders": [{"name": "day"}, {"name": "views"}, {"name": "views"}], "rows": [["2024-01-01", "1", "2"]]}'
    assert [r.views for r in D.read_daily_report(spark.createDataFrame([("p", body)], "publication_id string, value string")).collect()] == [2]


def test_a_provider_that_fails_while_it_runs(spark):
    rows = spark.createDataFrame([(1,)], "a int")
    late = lambda s, r: rows.select(F.raise_error(F.lit("down")).cast("int").alias("a"))
    found, failed = S.from_providers(spark, {"good": lambda s, r: rows, "late": late}, {}, "")
    assert found.count() == 1 and list(failed) == ["late"]


def test_chunks_equal_a_walk_over_characters():
    """Paragraphs taken one by one: the same pieces as from places in the text."""

    def walk(text, size):
        out, held = [], []
        queue = text.split("\n\n")
        while queue:
            p = queue.pop(0)
            if len(p) > size:
                head = p[:size]
                at = head.rfind("\n") if head.rfind("\n") > size // 2 else head.rfind(" ") if head.rfind(" ") > 0 else size
                out += ["\n\n".join(held)] * bool(held) + [p[:at]]
                held, queue = [], [p[at:].strip(), *queue]
                continue
            if held and sum(len(h) + 2 for h in held) + len(p) > size:
                out.append("\n\n".join(held))
                held = []
            held += [p] * bool(p)
        return out + ["\n\n".join(held)] * bool(held)

    rng = random.Random(8)
    for _ in range(600):
        text = "".join(rng.choice(["ab", " ", "\n", "\n\n", "\n\n\n", "cde", "f" * 9]) for _ in range(rng.randint(0, 120)))
        for size in (1, 7, 30):
            assert T.chunked(text, size) == walk(text, size), (text, size)


def test_scripts_as_people_type_them(spark):
    name = re.compile(r"^([A-Za-z][^:]{0,39}?)\s*:\s*(\S.*)$")

    def plain(text):
        out = []
        for row in (r.strip() for r in text.splitlines()):
            found = name.match(row)
            if found:
                out.append([" ".join(found[1].split()), found[2]])
            elif row:
                if out:
                    out[-1][1] += " " + row
                else:
                    out.append(["Narrator", row])
        return [(who, " ".join(said.split())) for who, said in out]

    rng = random.Random(3)
    bits = ["bob: hi you", "Dr. Smith (tired): what", "Anna:no space", "É: not a name", "http://x.org", "a" * 40 + ": fits", "a" * 41 + ": too long", "Eve :  two  spaces", "no name here", "", "  ", "Zoë : ok", "9: no", "Tim:", "A: b: c"]
    ends = ["\n", "\r\n", "\r", "\x0b", " ", "\x85"]
    texts = ["".join(rng.choice(bits) + rng.choice(ends) for _ in range(rng.randint(0, 8))) for _ in range(150)]
    rows = K.parse_dialogue(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r.speech, r.part)):
        got.setdefault(r.id, []).append((r.speaker, r.text))
    assert got == {i: plain(t) for i, t in enumerate(texts) if plain(t)}


def flat(text):
    bare = regex.sub(r"[^\p{L}\p{N}_\s]", " ", unicodedata.normalize("NFKD", text.lower()))
    return " ".join(bare.split())


def boilerplate(text):
    f = flat(text)
    w = f.split()
    return not f or bool(re.search(r"[\[(][^\])]{0,60}[\])]|[♪♫]", text)) or any(m in f for m in T.HALLUCINATIONS) or (len(w) >= 8 and len(set(w)) <= len(w) // 3)


def instruction(text):
    f = flat(text)
    return bool(f) and len(f.split()) <= 40 and f.startswith(T.INSTRUCTION_OPENERS) and any(n in f for n in T.INSTRUCTION_NOUNS)


def odd_texts():
    rng = random.Random(14)
    bits = ["Please crop", "the logo", "thanks for watching", "Ünïcode", "word", "word", "word", "(laughs)", "[music", "♪", "add a", "caption", "cut", "video", "you you you", "…", "it's", "one", "two", "I want", "\t", "é́"]
    return ["", " ", "Make the video", "make", "(a)", "[" + "x" * 61 + "]", *(" ".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(400)), "Please " + "so " * 39 + "logo", "Please " + "so " * 38 + "logo"]


def test_flags_equal_plain_rules(spark):
    texts = odd_texts()
    assert each(spark, texts, T.hallucination_flag) == [boilerplate(t) for t in texts]
    assert each(spark, texts, T.instruction_flag) == [instruction(t) for t in texts]
    assert len({boilerplate(t) for t in texts}) == len({instruction(t) for t in texts}) == 2


def test_speakability_in_order_of_its_refusals(spark):
    rng = random.Random(15)
    rows = [(i, t, rng.random() < 0.7, rng.choice([0.2, 0.59, 0.6, 0.9, None])) for i, t in enumerate([*odd_texts(), None])]
    df = spark.createDataFrame(rows, "id int, t text_, h boolean, c double".replace("text_", "string"))
    got = {r.id: tuple(r.s) for r in df.select("id", T.speakability(F.col("t"), F.col("h"), F.col("c")).alias("s")).collect()}
    for i, text, heard, confidence in rows:
        said = " ".join((text or "").split())
        refusal = "empty" if not said else "instruction" if instruction(said) else "boilerplate" if heard and boilerplate(said) else "too short" if heard and len(said.split()) < 6 else None
        warning = "low confidence" if refusal is None and heard and confidence is not None and confidence < 0.6 else None
        assert got[i] == (refusal is None, refusal, warning), (text, heard, confidence)
    assert {s[1] for s in got.values()} == {None, "empty", "instruction", "boilerplate", "too short"}


def test_curated_places(spark):
    """A curator's relevance and worth blended with the score; equal ones keep their order, and rows that stay aren't listed."""
    rng = random.Random(16)
    rows = [(f"run{k}", i + 1, rng.randint(0, 100), rng.choice([None, *range(11)]), rng.choice([True, True, False])) for k in range(6) for i in range(12)]
    df = spark.createDataFrame(rows, "run_id string, rank int, score int, relevance int, worth boolean")
    want = set()
    for k in range(6):
        mine = []
        for _, rank, score, relevance, worth in (r for r in rows if r[0] == f"run{k}"):
            blended = float(score) if relevance is None else 0.6 * score + 4.0 * relevance
            mine.append((-max(0, min(100, round(blended if worth else blended * 0.6))), rank))
        want |= {(f"run{k}", rank, place) for place, (_, rank) in enumerate(sorted(mine), 1) if place != rank}
    assert {(r.run_id, r["rank"], r.place) for r in N.rerank_curated(df).collect()} == want


def test_terms_tags_and_topics_of_one_long_line_in_about_its_length(spark):
    import time

    names = [f"{a}{b}{c}" for a in "BCDFGHJKLM" for b in "aeiou" for c in ("rest", "mond", "lein", "vik", "dam", "burg")] * 20
    line, other = "It " + " ".join(f"Of {n} {n.upper()}" for n in names), "some other words"
    topics = ",".join(names)
    df = spark.createDataFrame([(line, line, topics), (line, other, topics)], "text string, known string, topics string").coalesce(1)
    raw = F.split("text", " ")
    begun = time.monotonic()
    got = df.select(T.ungrounded_terms(F.col("text"), F.col("known")), T.tidy_tags(raw, F.col("known")), T.parse_topics(F.col("topics"))).collect()
    assert time.monotonic() - begun < 20
    assert [list(r) for r in got] == [[[], ["it", "of", *(n.lower() for n in names[:10])], names[:12]], [names[:8], ["it", "of"], names[:12]]]
