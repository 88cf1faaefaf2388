import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers as P
import xxhash
from tokenizers import Tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, n_removed int, N_WORDS int, fp long, keep_id long"


def letters(rng, n):
    vocab = [f"{a}{b}" for a in "bcdfgl" for b in ("an", "er", "ou", "ing", "the")]
    return " ".join(rng.choice(vocab) for _ in range(n))


def plain_exact(rows):
    kept = {}
    for key, text in rows.items():
        norm = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        kept[norm] = max(kept.get(norm, key), key)
    return {k: rows[k] for k in kept.values()}


def plain_near(rows):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints, group = {k: fingerprint(t) for k, t in rows.items()}, {}
    for key in sorted(rows):  # smallest first, flooding over links
        if key not in group:
            group[key], todo = key, [key]
            while todo:
                at = todo.pop()
                for other in rows:
                    if other not in group and (prints[at] ^ prints[other]).bit_count() <= 3:
                        group[other] = key
                        todo.append(other)
    return {k: t for k, t in rows.items() if group[k] == k}


def plain_passages(rows, window=35):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in rows.items()}
    count = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for key, w in words.items():
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        out[key] = rows[key] if all(keep) else " ".join(x for x, k in zip(w, keep, strict=True) if k)
    return out


def plain_pieces(rows):
    tokenizer, pieces = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Counter()
    for key, text in rows.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        start, stop, piece = 0, len(ids) % 2048 or 2048, 0
        while start < len(ids):
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start:stop]))
            pieces[key, piece, start, stop - start, crc] += 1
            start, stop, piece = stop, stop + 2048, piece + 1
    return pieces


def test_each_stage_equals_a_plain_model(spark, tmp_path):
    rng = random.Random(1)
    texts = {i: letters(rng, rng.choice([20, 200, 400])) for i in range(60)}
    passage = letters(rng, 60)
    texts |= {100: texts[0].upper(), 101: "12 34", 102: None, 103: letters(rng, 90) + " " + passage, 104: letters(rng, 90) + "  " + passage, 106: letters(rng, 3000) + "\n" + passage}
    near = texts[1].split()
    near[100:100] = ["extra"]
    texts[105] = " ".join(near)
    texts |= {200 + i: texts[2] for i in range(20)}
    path = str(tmp_path / "documents.parquet")
    rows = [(k, t, "en", "s", len(t or ""), 0.5, "no", k, 2, 3, 4) for k, t in texts.items()]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(path)
    docs, seen = spark.read.parquet(path), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        found = docs.collect()
        seen[name] = {r.doc_id: r.text for r in found}
        assert len(seen[name]) == len(found) and all(r.n_removed == r.doc_id and r.n_chars == len(r.text) and r.N_WORDS == 2 for r in found)
    assert set(seen["language_id"]) == set(texts) - {101, 102}  # one language, so all with letters stay
    assert seen["exact_dedup"] == plain_exact(seen["language_id"])
    assert seen["simhash_near_dedup"] == plain_near(seen["exact_dedup"])
    assert seen["substring_dedup"] == plain_passages(seen["simhash_near_dedup"])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == plain_pieces(seen["substring_dedup"])
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert len(places) <= -(-sum(r.length for r in packed) // 2048) + 1


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
