"""Document fingerprints: a Merkle tree over a text's sections, paragraphs and pieces of sentences.

Sections part at blank lines and, inside long runs of lines, where a paragraph's own hash says so, which keeps
borders in place when text before them changes; paragraphs are lines; leaves are sentences of a paragraph, and those
that are long are cut where their own code points say so, in any script and without any punctuation. A node's hash
covers its children's hashes in order, so equal roots mean equal texts, and where roots differ, only branches
whose hashes differ need to be followed to locate the edits. All hashes have 128 bits. The fingerprint string lists the tree:
root:section[paragraph(leaf,...)...]... with a leaf's size behind its hash.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, batches_of, table

#: A paragraph whose hash is a multiple of this ends a section.
SECTION = 8
#: Code points of a sentence that is one leaf, and of a cut sentence's leaves: least, on average, most.
WHOLE, LEAST, MEAN, MOST = 16, 6, 16, 64
_LEAF = re.compile(r"[^.!?\u3002\uff01\uff1f\u061f\u0964]*(?:[.!?\u3002\uff01\uff1f\u061f\u0964]+\s*|\Z)")


class Node(NamedTuple):
    digest: bytes
    size: int
    kids: tuple[Node, ...]


def _digest(kind: bytes, parts) -> bytes:
    return hashlib.blake2b(kind + b"".join(parts), digest_size=16).digest()


def _cuts(text: str) -> list[int]:
    """Places that the two code points before them choose, one in MEAN."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    mixed = (codes[1:] * np.uint64(0x9E3779B97F4A7C15) + codes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    return (np.flatnonzero(mixed % np.uint64(MEAN) == 0) + 2).tolist()


def _spans(line: str, at: int, cuts: list[int], near: int) -> Iterator[tuple[int, int]]:
    """The leaves of a line that stands at `at`; cuts from number `near` on are those inside or after it."""
    for found in _LEAF.finditer(line):
        start, end = found.start() + at, found.end() + at
        if end - start > WHOLE:
            while near < len(cuts) and cuts[near] <= end - LEAST:
                if cuts[near] - start >= LEAST:
                    while cuts[near] - start > MOST:
                        yield start, start + MOST
                        start += MOST
                    yield start, cuts[near]
                    start = cuts[near]
                near += 1
            while end - start > MOST:
                yield start, start + MOST
                start += MOST
        if end > start:
            yield start, end


def merkle_tree(text: str | None, known: dict[str, Node] | None = None) -> Node:
    """The tree of a whole text; null counts as empty, and the empty text has a root without children.

    known remembers the nodes of lines, whose leaves depend on nothing around them, for texts that share many.
    """
    text = text or ""
    known = {} if known is None else known
    sections: list[list[Node]] = [[]]
    cuts, at = None, 0
    blake = hashlib.blake2b
    for line in text.splitlines(keepends=True):
        paragraph = known.get(line)
        if paragraph is None:
            if len(line) > WHOLE:
                cuts = _cuts(text) if cuts is None else cuts
                spans = _spans(line, at, cuts, bisect_left(cuts, at))
            else:
                spans = ((at + m.start(), at + m.end()) for m in _LEAF.finditer(line) if m[0])
            leaves = tuple([Node(blake(text[a:b].encode(), digest_size=16).digest(), b - a, ()) for a, b in spans])
            paragraph = known[line] = Node(_digest(b"p", [k.digest for k in leaves]), len(line), leaves)
        at += len(line)
        sections[-1].append(paragraph)
        if not line.strip() and len(sections[-1]) > 1 or line.strip() and paragraph.digest[0] % SECTION == 0:
            sections.append([])
    made = tuple(Node(_digest(b"s", [k.digest for k in s]), sum(k.size for k in s), tuple(s)) for s in sections if s)
    return Node(_digest(b"r", [k.digest for k in made]), sum(k.size for k in made), made)


def fingerprint(tree: Node) -> str:
    """The tree as a string: equal texts, and they alone, have equal strings."""
    return tree.digest.hex() + ":" + "".join(
        section.digest.hex() + "[" + "".join(
            paragraph.digest.hex() + "(" + ",".join(f"{leaf.digest.hex()}{leaf.size:x}" for leaf in paragraph.kids) + ")"
            for paragraph in section.kids
        ) + "]"
        for section in tree.kids
    )


def parse_fingerprint(text: str) -> Node:
    """The tree that a fingerprint string lists."""
    root, _, rest = text.partition(":")
    sections = []
    for section, inner in re.findall(r"([0-9a-f]{32})\[([^\]]*)\]", rest):
        paragraphs = []
        for paragraph, leaves in re.findall(r"([0-9a-f]{32})\(([^)]*)\)", inner):
            kids = tuple(Node(bytes.fromhex(x[:32]), int(x[32:], 16), ()) for x in leaves.split(",") if x)
            paragraphs.append(Node(bytes.fromhex(paragraph), sum(k.size for k in kids), kids))
        sections.append(Node(bytes.fromhex(section), sum(p.size for p in paragraphs), tuple(paragraphs)))
    return Node(bytes.fromhex(root), sum(s.size for s in sections), tuple(sections))


def likeness(a: Node, b: Node) -> float:
    """Share of the larger text's code points in branches that both trees have, 1 for equal roots.

    Sections are matched first, then paragraphs of what is left, then leaves; each occurrence counts once.
    """
    if a.digest == b.digest:
        return 1.0
    left, right, common = list(a.kids), list(b.kids), 0
    for _ in range(3):
        have = Counter(n.digest for n in right)
        unmatched, used = [], Counter()
        for node in left:
            if used[node.digest] < have[node.digest]:
                used[node.digest] += 1
                common += node.size
            else:
                unmatched.append(node)
        rest = []
        for node in right:
            if used[node.digest]:
                used[node.digest] -= 1
            else:
                rest.append(node)
        left, right = [k for n in unmatched for k in n.kids], [k for n in rest for k in n.kids]
    return common / max(a.size, b.size, 1)


def edits(a: Node, b: Node, at: int = 0) -> list[tuple[int, int]]:
    """Spans of b's code points under branches that differ from a's, found by going down only where hashes differ."""
    if a.digest == b.digest:
        return []
    known = {k.digest: k for k in a.kids}
    out, near = [], list(a.kids)
    for i, kid in enumerate(b.kids):
        if kid.digest not in known:
            other = near[i] if i < len(near) else None
            out += edits(other, kid, at) if other and other.kids and kid.kids else [(at, at + kid.size)]
        at += kid.size
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, n_chars, and fingerprint of every whole text; null counts as empty. A column of keep that is
    named like a result gives way to it."""
    keep = apart(keep, "n_chars", "fingerprint")
    schema = docs.select(*keep).schema.add("n_chars", "long").add("fingerprint", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(batch.num_columns - 1)]
            marks = [fingerprint(merkle_tree(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(len, texts), pa.int64()), pa.array(marks, pa.string())], [*keep, "n_chars", "fingerprint"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def edited_text(text: str, following: str) -> str:
    """The last quarter of a text's code points replaced by as many of the next text's first ones."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_PAIRS = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, id, guest): each own row meets the row after it; a guest only ends a bucket."""

    def rows():
        held = None
        for batch in batches:
            for bucket, key, guest, text in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                now = (bucket.as_py(), key.as_py(), text.as_py() or "")
                lines: dict[str, Node] = {}
                now = (*now, merkle_tree(now[2], lines), lines)
                if held and held[0] == now[0]:
                    text, tree = held[2], held[3]
                    other = edited_text(text, now[2])
                    changed = merkle_tree(other, held[4])
                    yield (held[1], len(text), hashlib.sha256(other.encode()).hexdigest(), fingerprint(tree), fingerprint(changed), likeness(tree, changed), likeness(tree, now[3]))
                held = None if guest.as_py() else now

    return batches_of(rows(), _PAIRS)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int = 0) -> DataFrame:
    """Every document against its edited text and the next document by ascending id (after the last: the first).

    Ids are dealt to buckets by split points that a pass over the ids alone finds; the first row of each bucket is
    also sent to the bucket before it, so texts move once. Nulls: a null id comes first, null text counts as
    empty. Ids are taken to be unique; of rows that repeat an id, one follows another in no set order. A single
    row is its own next one; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    buckets = 4 * n
    splits = ids.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] or []
    bucket = _bucket(F.col("id"), sorted(set(splits)))
    nulls = F.count_if(F.col("id").isNull())
    firsts = ids.groupBy(bucket.alias("bucket")).agg(F.when(nulls == 0, F.min("id")).alias("first")).orderBy("bucket").collect()
    starts = spark.createDataFrame([(row["first"], firsts[i - 1]["bucket"]) for i, row in enumerate(firsts)], "start long, to int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.select(bucket.alias("bucket"), "id", F.lit(False).alias("guest"), "text")
    guests = (
        texts.join(F.broadcast(starts), F.col("id").eqNullSafe(F.col("start")))
        .groupBy("to", "id")
        .agg(F.any_value("text").alias("text"))
        .select(F.col("to").alias("bucket"), "id", F.lit(True).alias("guest"), "text")
    )
    return (
        rows.unionByName(guests)
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket", "guest", "id")
        .mapInArrow(_with_next, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
        .withColumnRenamed("id", id_col)
    )


def _bucket(key: Column, splits: list[int]) -> Column:
    """How many split points a key has reached; null keys are in the first bucket."""
    reached = np.array(splits, np.int64)

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(reached, keys.to_numpy(np.int64), side="right"))

    return bucket(F.coalesce(key, F.lit(-(1 << 63)).cast("long")))


def query(spark, sf_dir):
    return compare_with_next(table(spark, sf_dir, "documents"))
