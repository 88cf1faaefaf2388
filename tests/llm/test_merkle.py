import difflib
import hashlib
import random

from lumenreel.llm import merkle as M

SPAN = "One two. Three four!\nFive\n\nSix seven? Eight\nNine ten.\n"


def test_tree_round_trip_and_equality():
    for text in ["", "\n", SPAN, SPAN * 40, "no stop", "a.b.c", " . ", "é\r\nü\x0b x"]:
        tree = M.merkle_tree(text)
        assert tree.size == len(text)
        assert M.parse_fingerprint(M.fingerprint(tree)) == tree
        assert M.likeness(tree, tree) == 1.0 and M.edits(tree, tree) == []
    assert M.fingerprint(M.merkle_tree(None)) == M.fingerprint(M.merkle_tree(""))
    assert M.fingerprint(M.merkle_tree("a. b")) != M.fingerprint(M.merkle_tree("a.  b"))


def test_likeness_and_edits_follow_the_change():
    rng = random.Random(4)
    text = "".join(f"word{rng.random()} and more. " + "\n" * (i % 5 == 4) for i in range(200))
    changed = text.replace("and", "but", 1)
    a, b = M.merkle_tree(text), M.merkle_tree(changed)
    assert 0.98 < M.likeness(a, b) < 1.0
    spans = M.edits(a, b)
    at = changed.index("but")
    assert any(x <= at < y for x, y in spans)
    assert M.likeness(a, M.merkle_tree("wholly other.")) == 0.0


def test_compare_with_next_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i * 3 % 101, "".join(f"w{rng.randrange(30)} x{'.' if rng.random() < 0.3 else ' '}" for _ in range(rng.randrange(60))), 7) for i in range(101)]
    rows[5] = (rows[5][0], None, 7)
    rows[6] = (rows[6][0], "", 7)
    rows[7] = (None, "first of all. ", 7)
    got = {r.doc_id: r for r in M.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string, guest int"), partitions=5).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    for i, (key, text, _) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        other = M.edited_text(text, following)
        row = got[key]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert row.fingerprint == M.fingerprint(M.merkle_tree(text)) and row.edited_fingerprint == M.fingerprint(M.merkle_tree(other))
        assert row.near_next == M.likeness(M.merkle_tree(text), M.merkle_tree(following))


def test_one_row_and_no_rows(spark):
    one = M.compare_with_next(spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(3, 1.0)]
    assert M.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeness_of_any_script_without_punctuation():
    other = "quite another text without an end " * 200
    for text in (" ".join(f"w{i}" for i in range(1000)), "".join(chr(0x4E00 + i * i * 7919 % 5000) for i in range(1000)), "x" * 1000, "文。" * 500, "क ख।" * 300):
        near = M.likeness(M.merkle_tree(text), M.merkle_tree(M.edited_text(text, other)))
        assert 0.6 < near <= 0.75, text[:20]


def plain_likeness(text, other):
    """Share of the longer text in the runs of the other that difflib finds common, from 12 code points on."""
    blocks = difflib.SequenceMatcher(None, text, other, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks if b.size >= 12) / max(len(text), len(other), 1)


def test_likeness_is_near_a_plain_comparison():
    rng = random.Random(8)
    for _ in range(30):
        text = "".join(rng.choice(["word", "longer ", "x", ". ", "\n", " und ", "é"]) + str(rng.randrange(1000)) for _ in range(150))
        at, n = rng.randrange(len(text)), rng.randrange(200)
        other = text[:at] + "".join(rng.choice("qjz") for _ in range(n)) + text[at + n :]
        assert abs(M.likeness(M.merkle_tree(text), M.merkle_tree(other)) - plain_likeness(text, other)) < 0.12
    assert M.likeness(M.merkle_tree("a"), M.merkle_tree("a")) == 1.0 and M.likeness(M.merkle_tree(""), M.merkle_tree("a")) == 0.0


def test_hashes_have_128_bits():
    def nodes(node):
        yield node
        for kid in node.kids:
            yield from nodes(kid)

    assert {len(n.digest) for n in nodes(M.merkle_tree(SPAN * 30))} == {16}


def test_columns_named_like_results(spark):
    df = spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, N_CHARS int")
    got = M.fingerprints(df, keep=("doc_id", "N_CHARS"))
    assert got.columns == ["doc_id", "n_chars", "fingerprint"] and got.first().n_chars == 3
