"""Queries over text columns: documents, benchmark, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as K
from .registry import query
from .views import read

STOP = ", ".join(f"'{w}'" for w in T.TOPIC_STOPWORDS)
TOKENS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda t: length(t) > 1 AND t NOT IN (" + STOP + "))"


def listed(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("topic_tokens", "SELECT ord, array_to_string(list_sort(" + TOKENS.format("topic") + "), ' ') AS tokens FROM {signals}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "signals").select("ord", F.array_join(F.sort_array(T.topic_tokens(F.col("topic"))), " ").alias("tokens"))


@query("same_topic", "SELECT a.ord, s > 0 AND (s / u >= 0.5 OR (m >= 2 AND s / m >= 0.75)) AS same FROM (SELECT ord, len(list_intersect(x, y)) AS s, CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) AS u, CAST(least(len(x), len(y)) AS DOUBLE) AS m FROM (SELECT ord, " + TOKENS.format("split_part(text, chr(10), 1)") + " AS x, " + TOKENS.format("split_part(text, chr(10), 2)") + " AS y FROM (SELECT doc_id AS ord, text FROM {documents}) d) t) a")
def _(spark, sf_dir):
    line = lambda n: T.topic_tokens(F.split_part("text", F.lit("\n"), F.lit(n)))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), T.same_topic(line(1), line(2)).alias("same"))


@query("lookup_query", "SELECT ord, CASE WHEN len(list_filter(" + TOKENS.format("split_part(topic, ' ', 3) || ' f1'") + ", lambda h: NOT list_contains(" + TOKENS.format("topic") + ", h))) > 0 THEN topic || ' ' || split_part(topic, ' ', 3) || ' f1' ELSE topic END AS q FROM {signals}")
def _(spark, sf_dir):
    s = read(spark, sf_dir, "signals")
    return s.select("ord", T.lookup_query(F.col("topic"), F.concat(F.split_part("topic", F.lit(" "), F.lit(3)), F.lit(" f1"))).alias("q"))


DIGITS = "[0-9][0-9]"
NORMAL_LOG = f"trim(regexp_replace(regexp_replace(regexp_replace(message, '{DIGITS}{DIGITS}-{DIGITS}-{DIGITS}T{DIGITS}:{DIGITS}:{DIGITS}Z?', '<ts>', 'g'), '\\b0x[0-9a-fA-F]+\\b', '<hex>', 'g'), '\\b[0-9]+\\b', '<n>', 'g'))"


@query("log_normalise", f"SELECT event_id, {NORMAL_LOG} AS message FROM {{log_records}}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "log_records").select("event_id", T.log_normalise(F.col("message")).alias("message"))


@query("log_fingerprint", f"SELECT event_id, substr(sha256(level || '|' || app || '|' || {NORMAL_LOG} || '|'), 1, 16) AS fingerprint FROM {{log_records}}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "log_records").select("event_id", T.log_fingerprint(F.col("level"), F.col("app"), F.col("message"), F.lit(None).cast("string")).alias("fingerprint"))


@query("top_frame", "SELECT item_id, CASE WHEN split_part(text, chr(10), 2) <> '' THEN left(trim(split_part(text, chr(10), 2)), 200) ELSE left(trim(text), 200) END AS frame FROM {benchmark}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", T.top_frame(F.col("text")).alias("frame"))


@query("log_category", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'permission-denied' WHEN doc_id % 3 = 1 THEN 'network' END AS category FROM {documents}")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(40)).alias("t"))
    m = F.concat("t", F.when(F.col("doc_id") % 3 == 0, " Access is Denied").when(F.col("doc_id") % 3 == 1, " connection RESET").otherwise(""))
    return d.select("doc_id", T.log_category(m).alias("category"))


@query("ingest_error_code", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'RATE_LIMITED' WHEN 2 THEN 'GEO_BLOCKED' ELSE 'UNKNOWN' END AS code FROM {documents}")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    said = F.when(k == 0, "This is a Private Video").when(k == 1, "HTTP Error 429: Too Many Requests").when(k == 2, "not made this video available in your country").otherwise("?")
    return d.select("doc_id", T.ingest_error_code(said).alias("code"))


@query("youtube_id", "SELECT page_id, CASE WHEN page_id % 5 < 4 THEN 'abcdefg' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') END AS id FROM {pages}")
def _(spark, sf_dir):
    p = F.concat(F.lit("abcdefg"), F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"))
    k = F.col("page_id") % 5
    url = F.when(k == 0, p).when(k == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), p, F.lit("&t=3"))).when(k == 2, F.concat(F.lit("youtu.be/"), p)).when(k == 3, F.concat(F.lit("https://m.youtube.com/shorts/"), p, F.lit("/x"))).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", T.youtube_id(url).alias("id"))


@query("playlist_id", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'PL' || CAST(page_id AS VARCHAR) END AS id FROM {pages}")
def _(spark, sf_dir):
    k = F.col("page_id") % 3
    lead = F.when(k == 0, "https://www.youtube.com/watch?v=abcdefghijk&list=PL").when(k == 1, "https://example.org/?list=PL").otherwise("https://www.youtube.com/watch?v=abcdefghijk&x=")
    return read(spark, sf_dir, "pages").select("page_id", T.playlist_id(F.concat(lead, F.col("page_id").cast("string"))).alias("id"))


@query("normalise_text", "SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN_\\s'']', ' ', 'g'), '''([^\\pL\\pN_]|$)', ' \\1', 'g'), '\\s+', ' ', 'g')) AS text FROM {benchmark}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", T.normalise_text(F.col("text")).alias("text"))


@query("tokenise", "SELECT item_id, len(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN_\\s'']', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS n FROM {benchmark}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(T.tokenise(F.col("text"))).cast("long").alias("n"))


def text_pairs(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("reference"))
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("reference").alias("other"))
    pairs = d.join(following, "doc_id", "left")
    return pairs.withColumn("hypothesis", F.when((F.col("doc_id") % 3 == 0) | F.col("other").isNull(), F.col("reference")).otherwise(F.col("other")))


@query("word_error_rate")
def _(spark, sf_dir):
    return K.corpus_word_errors(text_pairs(spark, sf_dir), "reference", "hypothesis", ["source"])


@query("translation_landed")
def _(spark, sf_dir):
    return text_pairs(spark, sf_dir).select("doc_id", T.translation_landed(F.col("reference"), F.col("hypothesis")).alias("landed"))


LEX = "(SELECT word, min(language) AS language FROM (" + " UNION ALL ".join(f"SELECT unnest(list_distinct({listed(t.split())})) AS word, '{k}' AS language" for k, t in T.LANGUAGE_WORDS.items()) + ") l GROUP BY word HAVING count(*) = 1)"


@query("discriminative_words", f"SELECT d.doc_id, x.language, x.word FROM (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM {{documents}}) d JOIN {LEX} x ON x.word = d.word")
def _(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))
    return docs.join(F.broadcast(K.discriminative_words(K.lexicon(spark))), "word").select("doc_id", "language", "word")


STRIPPED = "list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: lower(trim(w, '.,!?;:\"''()[]<>«»—-'))), lambda w: w <> '')"


@query("language_gate", f"""SELECT d.doc_id, CASE WHEN d.n < 6 OR coalesce(h.best, 0) = 0 THEN true ELSE coalesce(h.mine, 0) = h.best END AS reads FROM
  (SELECT doc_id, lang, len({STRIPPED}) AS n FROM {{documents}}) d LEFT JOIN (SELECT doc_id, max(c) AS best, max(CASE WHEN language = lang THEN c END) AS mine FROM
  (SELECT t.doc_id, t.lang, x.language, count(*) AS c FROM (SELECT doc_id, lang, unnest({STRIPPED}) AS word FROM {{documents}}) t JOIN {LEX} x ON x.word = t.word GROUP BY 1, 2, 3) c GROUP BY doc_id) h ON h.doc_id = d.doc_id""")
def _(spark, sf_dir):
    return K.language_gate(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "text", "lang").select("doc_id", "reads")


@query("language_counts", f"SELECT t.doc_id, x.language, count(*) AS hits FROM (SELECT doc_id, unnest({STRIPPED}) AS word FROM {{documents}}) t JOIN {LEX} x ON x.word = t.word GROUP BY 1, 2")
def _(spark, sf_dir):
    return K.language_counts(read(spark, sf_dir, "documents"), "doc_id", "text")


PLEASE = "CASE WHEN turn = 0 THEN 'Please crop the logo. ' ELSE '' END || text"
#: Letters that fall apart into one of a to z and a mark, which then counts as a space.
ACCENTED = {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö", "u": "ùúûü", "y": "ýÿ"}


def flat_sql(text: str) -> str:
    found = f"lower({text})"
    for letter, marked in ACCENTED.items():
        found = f"regexp_replace({found}, '[{marked}]', '{letter} ', 'g')"
    return f"trim(regexp_replace(regexp_replace({found}, '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _any(flat: str, needles, test: str = "contains") -> str:
    return "(" + " OR ".join(f"{test}({flat}, '{n.replace(chr(39), chr(39) * 2)}')" for n in needles) + ")"


BOILERPLATE = (
    r"(flat = '' OR regexp_matches(said, '[\[\(][^\]\)]{0,60}[\]\)]|[♪♫]+') OR " + _any("flat", T.HALLUCINATIONS)
    + " OR (len(string_split(flat, ' ')) >= 8 AND len(list_distinct(string_split(flat, ' '))) <= len(string_split(flat, ' ')) // 3))"
)
INSTRUCTS = f"(flat <> '' AND len(string_split(flat, ' ')) <= 40 AND {_any('flat', T.INSTRUCTION_OPENERS, 'starts_with')} AND {_any('flat', T.INSTRUCTION_NOUNS)})"


@query("hallucination_flag", f"SELECT doc_id, {BOILERPLATE} AS flag FROM (SELECT doc_id, text AS said, {flat_sql('text')} AS flat FROM {{documents}}) d")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.hallucination_flag(F.col("text")).alias("flag"))


@query("instruction_flag", f"SELECT conv_id, turn, {INSTRUCTS} AS flag FROM (SELECT conv_id, turn, {flat_sql(PLEASE)} AS flat FROM {{conversations}}) c")
def _(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.instruction_flag(F.concat(F.when(F.col("turn") == 0, "Please crop the logo. ").otherwise(""), F.col("text"))).alias("flag"))


REFUSAL = f"CASE WHEN said = '' THEN 'empty' WHEN {INSTRUCTS} THEN 'instruction' WHEN heard AND {BOILERPLATE} THEN 'boilerplate' WHEN heard AND len(string_split(said, ' ')) < 6 THEN 'too short' END"


@query(
    "speakability",
    f"""SELECT conv_id, turn, refusal IS NULL AS ok, refusal, CASE WHEN refusal IS NULL AND heard AND (n % 10) / 10.0 < 0.6 THEN 'low confidence' END AS warning FROM (SELECT *, {REFUSAL} AS refusal FROM
    (SELECT *, {flat_sql('said')} AS flat FROM (SELECT conv_id, turn, role = 'user' AS heard, length(text) AS n, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS said FROM {{conversations}}) a) b) c""",
)
def _(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.speakability(F.col("text"), F.col("role") == "user", (F.length("text") % 10) / 10).alias("s")).select("conv_id", "turn", "s.*")


CONTENT = "list_distinct(list_filter(" + STRIPPED.replace("text", "{0}") + ", lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in sorted(T.ENGLISH_COMMON)) + ")))"


@query("echo_check", "SELECT conv_id, turn, CASE " + " ".join(f"WHEN contains(said, '{p}') THEN 'footage: {p}'" for p in ("the camera", "the screen shows", "watch as", "notice the")) + r""" WHEN len(mine) >= 8 AND len(theirs) > 0 AND len(list_intersect(mine, theirs)) / len(mine) >= 0.7 THEN 'description' END AS reason
  FROM (SELECT *, """ + CONTENT.format("said") + " AS mine, " + CONTENT.format("before") + r""" AS theirs FROM (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS said, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations}) a) b""")
def _(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = read(spark, sf_dir, "conversations").withColumn("before", before)
    return c.select("conv_id", "turn", T.echo_check(F.col("text"), F.col("before")).alias("reason"))


def first_different(items: str, most: int, name: str, by: str = "w", sep: str = ",") -> str:
    """SQL for the first `most` different items of a list for each document, joined in order; documents have columns
    doc_id, text and hook, the text's first line."""
    docs = "(SELECT doc_id, text, split_part(text, chr(10), 1) AS hook FROM {documents})"
    return f"""SELECT d.doc_id, coalesce(x.v, '') AS {name} FROM {{documents}} d LEFT JOIN (SELECT doc_id, string_agg(w, '{sep}' ORDER BY pos) AS v FROM (SELECT doc_id, arg_min(w, pos) AS w, min(pos) AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS rn
  FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, {items} AS l FROM {docs} a) b) c GROUP BY doc_id, {by}) e WHERE rn <= {most} GROUP BY doc_id) x ON x.doc_id = d.doc_id"""


def documents(spark, sf_dir):
    """Documents with `hook`, the text's first line, which is what is known of a text here."""
    return read(spark, sf_dir, "documents").withColumn("hook", F.split_part("text", F.lit("\n"), F.lit(1)))


RUNS = r"[\p{L}\p{Nl}\p{No}]+"
KNOWN = f"list_filter(regexp_extract_all(lower(hook), '{RUNS}'), lambda v: length(v) > 2)"


@query("thin_check", "SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < greatest(6, CAST(floor(greatest(8, floor((turn * 10 + 5) * 2.4::DOUBLE)) * 0.6::DOUBLE) AS INT)) * 0.7::DOUBLE AS thin FROM {conversations}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.thin_check(F.col("text"), T.word_floor(F.col("turn") * 10 + 5)).alias("thin"))


NEW = f"list_filter(flatten(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda s: regexp_extract_all(s, '{RUNS}')[2:])), lambda w: length(w) >= 4 AND regexp_matches(w, '^\\p{{Lu}}') AND NOT list_contains({KNOWN}, lower(w)))"


@query("ungrounded_terms", first_different(f"CASE WHEN len({KNOWN}) > 0 THEN {NEW} ELSE [] END", 8, "terms", "lower(w)"))
def _(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.coalesce(F.array_join(T.ungrounded_terms(F.col("text"), F.col("hook")), ","), F.lit("")).alias("terms"))


@query("tidy_title")
def _(spark, sf_dir):
    return read(spark, sf_dir, "first_lines").select("doc_id", T.tidy_title(F.concat(F.lit("“Title: "), F.col("hook"), F.lit("”"))).alias("title"))


TAGS = r"list_transform(string_split(text, ' '), lambda t: trim(regexp_replace(lower(regexp_replace(trim(t), '^#+', '')), '\s+', ' ', 'g')))"


@query("tidy_tags", first_different(f"list_filter({TAGS}, lambda w: w <> '' AND length(w) <= 40 AND len(string_split(w, ' ')) <= 4 AND (len({KNOWN}) = 0 OR len(list_filter(regexp_extract_all(w, '{RUNS}'), lambda p: length(p) > 2 AND NOT list_contains({KNOWN}, p))) = 0))", 12, "tags"))
def _(spark, sf_dir):
    raw = F.transform(F.split("text", " "), lambda w: F.concat(F.lit("#"), w))
    return documents(spark, sf_dir).select("doc_id", F.coalesce(F.array_join(T.tidy_tags(raw, F.col("hook")), ","), F.lit("")).alias("tags"))


NAMES = "list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]+'), lambda w: regexp_replace(regexp_replace(w, '^[''-]+|[''-]+$', '', 'g'), '''s$', ''))"
COMMON = ", ".join(f"'{w}'" for w in sorted(T.HEADLINE_COMMON))


@query("names_in", first_different(f"list_filter({NAMES}, lambda w: length(w) >= 3 AND regexp_matches(w, '^[A-Z]') AND lower(w) NOT IN ({COMMON}))", 40, "names"))
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.array_join(T.names_in(F.col("text")), ","), F.lit("")).alias("names"))


@query("blocked_names", "SELECT doc_id, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT d.doc_id, n.name FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS token FROM {documents}) d JOIN (SELECT n_name AS name FROM {nation} UNION ALL SELECT 'Idiot' UNION ALL SELECT 'Thnd') n ON lower(n.name) = d.token) x GROUP BY doc_id")
def _(spark, sf_dir):
    names = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(spark.createDataFrame([("Idiot",), ("Thnd",)], "name string"))
    return K.blocked_names(read(spark, sf_dir, "documents"), names, "doc_id", "text").withColumn("names", F.array_join("names", ","))


HEARD = "regexp_extract_all(lower(replace({0}, '’', '\'\'')), '[a-z0-9]+(?:''[a-z]+)?')"
SAYS = "len(list_filter(w[i:i + 4], lambda x: x NOT IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(T.HEADLINE_COMMON)) + "))) >= 2"


@query(
    "shared_phrases",
    f"""WITH ours AS (SELECT doc_id, {HEARD.format('line')} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {{documents}}) d WHERE trim(line) <> '' AND NOT starts_with(line, '[')),
    theirs AS (SELECT {HEARD.format('text')} AS w FROM {{benchmark}}), lines AS (SELECT DISTINCT array_to_string({HEARD.format('line')}, ' ') AS phrase FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM {{benchmark}}) b),
    known AS (SELECT DISTINCT array_to_string(w[i:i + 4], ' ') AS phrase FROM (SELECT w, unnest(generate_series(1, len(w) - 4)) AS i FROM theirs) t WHERE {SAYS})
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS phrase FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM ours) o WHERE {SAYS} AND array_to_string(w[i:i + 4], ' ') IN (SELECT phrase FROM known)
    UNION SELECT doc_id, array_to_string(w, ' ') FROM ours WHERE len(w) >= 3 AND array_to_string(w, ' ') IN (SELECT phrase FROM lines)""",
)
def _(spark, sf_dir):
    originals = read(spark, sf_dir, "benchmark").select(F.col("text").alias("original"))
    return K.shared_phrases(read(spark, sf_dir, "documents"), originals, "doc_id", "text", "original")


LINES = "string_split(text, chr(10))"
SUNG = f"list_filter({LINES}, lambda x: trim(x) <> '' AND NOT starts_with(x, '['))"
DIRECTIONS = r"(?i)\b(bpm|tempo|[A-G][#b]? (major|minor)|fade (out|away)|instrumental|guitar solo|drum break)\b"


@query("lint_lyrics", rf"""SELECT doc_id, array_to_string(list_filter([CASE WHEN len(list_filter(tags, lambda t: contains(t, 'chorus'))) = 0 THEN 'no chorus' END, CASE WHEN len(list_filter(tags, lambda t: starts_with(t, '[verse'))) = 0 THEN 'no verse' END,
  CASE WHEN len(sung) < 8 THEN 'few lines' END, CASE WHEN len(list_filter(sung, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) > 10)) * 3 > len(sung) THEN 'long lines' END,
  CASE WHEN len(list_filter(sung, lambda x: regexp_matches(x, '{DIRECTIONS}'))) > 0 THEN 'directions' END], lambda p: p IS NOT NULL), ',') AS problems
  FROM (SELECT doc_id, list_transform(list_filter({LINES}, lambda x: regexp_matches(x, '^\[[^\]]+\]$')), lambda x: lower(x)) AS tags, {SUNG} AS sung FROM {{documents}}) d""")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.lint_lyrics(F.col("text")), ",").alias("problems"))


@query("tidy_lines", r"""SELECT doc_id, left(regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(lines, lambda x: x = '' OR regexp_matches(x, '\pL') OR regexp_matches(x, '^\[.*\]$')), lambda x: CASE WHEN regexp_matches(x, '^\[.*\]$') THEN chr(10) || x ELSE x END), chr(10)),
  '\n\n\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), 4096) AS text FROM (SELECT doc_id, list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS lines FROM {documents}) d""")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.tidy_lines(F.col("text")).alias("text"))


@query("split_sentences")
def _(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.split_sentences(F.col("text"))).alias("at", "sentence"))


@query("pack_sentences")
def _(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.pack_sentences(F.col("text"), 120)).alias("at", "piece"))


@query("parse_dialogue")
def _(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    script = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat(F.initcap("role"), F.lit(": "), F.col("text")).alias("said")))), lambda x: x.said), "\n").alias("script"))
    return K.parse_dialogue(script, "conv_id", "script")


@query("chunk_text")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunk_text(500)("text")).alias("at", "piece"))


@query("wrap_title")
def _(spark, sf_dir):
    return read(spark, sf_dir, "first_lines").select("doc_id", F.array_join(T.wrap_title(F.col("hook")), "|").alias("title"))


@query("trim_words", "SELECT doc_id, CASE WHEN length(hook) <= 40 THEN hook WHEN strpos(reverse(hard), ' ') > 0 AND length(hard) - strpos(reverse(hard), ' ') >= 25 THEN regexp_replace(left(hard, length(hard) - strpos(reverse(hard), ' ')), '\\s+$', '') ELSE hard END AS text FROM (SELECT *, regexp_replace(left(hook, 40), '\\s+$', '') AS hard FROM {first_lines}) f")
def _(spark, sf_dir):
    return read(spark, sf_dir, "first_lines").select("doc_id", T.trim_words(F.col("hook"), 40).alias("text"))


@query("parse_topics", first_different("list_filter(list_transform(regexp_split_to_array(text, '[\\n,]'), lambda t: left(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), 80)), lambda t: t <> '')", 12, "topics", "lower(w)", "|"))
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.array_join(T.parse_topics(F.col("text")), "|"), F.lit("")).alias("topics"))
