import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, document_rows, prose
from watchtrail.llm import fill_middle, language, phrases, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Fill in the middle


def test_learned_index_finds_every_offset_exactly():
    draw = np.random.default_rng(3)
    for size in (1, 2, 50, 5000):
        offsets = np.concatenate([[0], np.cumsum(draw.integers(1, 400, size))]).astype(np.int64)
        index = fill_middle.fit(offsets)
        assert np.array_equal(fill_middle.locate(index, np.arange(len(offsets))), offsets)
        assert np.abs(index[3].astype(int)).max() <= fill_middle.ERROR
    long_words = fill_middle.token_ends("a" * 100_000 + " b")
    assert np.array_equal(fill_middle.locate(fill_middle.fit(long_words), np.arange(4)), [0, 100_000, 100_001, 100_002])


def brute_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, flags=re.S)
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m = len("".join(tokens[:a])), len("".join(tokens[:b]))
    pre, mid, suf = text[:p], text[p:m], text[m:]
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, ("spm" if h[3] % 100 < 20 else "psm"), p, m - p, out


def test_fill_middle_equals_brute_force_and_restores(spark, documents):
    extra = [(900 + i, t, None, None, 0, None, None) for i, t in enumerate(["<P>kept", "a<M>", "x" * 30000 + " 😀 end", "\x00\t é", "AB12cd"])]
    docs = documents.unionByName(spark.createDataFrame(extra, SCHEMA)).withColumn("fim_text", F.lit("clash"))
    found = fill_middle.fill_middle(docs).withColumn("back", fill_middle.restore(F.col("fim_text"), F.col("fim_form"))).collect()
    assert len(found) == documents.count() + len(extra)
    forms = Counter()
    for row in found:
        want = brute_fim(row.doc_id, row.text)
        assert (row.fim_n, row.fim_form, row.prefix_chars, row.middle_chars, row.fim_text) == want
        assert row.back == (row.text or "")
        assert row.copy == "extra" or row.copy is None
        forms[row.fim_form] += 1
    assert forms["psm"] and forms["plain"]


def test_fill_middle_of_no_rows(no_documents):
    assert fill_middle.fill_middle(no_documents).count() == 0


# Phrase collocations


def brute_collocations(rows, least, top, longest=4, share=80):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for s in range(1, longest + 1):
                for i in range(len(words) - s + 1):
                    counts[(lang, tuple(words[i : i + s]))] += 1
    candidates = {k: a for k, a in counts.items() if len(k[1]) >= 2 and a >= least}
    ranked = defaultdict(list)
    for (lang, phrase), a in candidates.items():
        size = len(phrase)
        if any(
            other_lang == lang and len(other) > size and 100 * b >= share * a
            and any(other[i : i + size] == phrase for i in range(len(other) - size + 1))
            for (other_lang, other), b in candidates.items()
        ):
            continue
        score, k = min(((2000000 * a) // (counts[(lang, phrase[:k])] + counts[(lang, phrase[k:])]), k) for k in range(1, size))
        l, r = counts[(lang, phrase[:k])], counts[(lang, phrase[k:])]
        ranked[lang].append((-score, -a, " ".join(phrase).encode(), l, r))
    out = set()
    for lang, items in ranked.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(items)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return out


def test_collocations_equal_brute_force(spark, documents):
    loud = [(700 + i, f"The cat sat. THE CAT SAT on a mat, {prose(90 + i, 8)}! the cat ran", "xx" if i % 2 else None, None, 0, None, None) for i in range(12)]
    docs = documents.unionByName(spark.createDataFrame(loud, SCHEMA)).withColumns({"phrase": F.lit("clash"), "shard": F.lit(9), "words": F.lit(1)})
    found = phrases.collocations(docs, least=3, top=7, shards=3)
    assert set(map(tuple, found.collect())) == brute_collocations([(r.text, r.lang) for r in docs.collect()], least=3, top=7)


def test_phrase_counts_are_exact(spark, documents):
    rows = [(r.text, r.lang) for r in documents.collect()]
    counted = phrases.count_phrases(phrases.pieces(documents, shards=4), shards=4, least=2).collect()
    truth = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            for s in range(1, 5):
                for i in range(len(words) - s + 1):
                    truth[(lang or "und", " ".join(words[i : i + s]))] += 1
    assert counted and all(truth[(r.lang, r.phrase)] == r["count"] for r in counted)
    frequent = {k for k, c in truth.items() if c >= 2 and k[1].count(" ") >= 1}
    assert frequent <= {(r.lang, r.phrase) for r in counted}


def test_collocations_of_no_rows(no_documents):
    assert phrases.collocations(no_documents).count() == 0


# Substring dedup


def brute_repeats(texts):
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    seen = Counter(tuple(ws[i : i + 35]) for ws in words for i in range(len(ws) - 34))
    out = []
    for ws in words:
        gone = np.zeros(len(ws), bool)
        for i in range(len(ws) - 34):
            if seen[tuple(ws[i : i + 35])] >= 2:
                gone[i : i + 35] = True
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((len(ws), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeat_rows():
    shared = prose(60, 50)
    rows = [(i, t, None, None, 0, "x", "y") for i, t in enumerate(r[1] for r in document_rows())]
    rows += [(500 + i, f"{prose(70 + i, 20)}\n{shared}\t\t{prose(80 + i, 10)}", None, None, 0, "x", "y") for i in range(5)]
    loop = " ".join(["one two three"] * 40)
    rows += [(600, loop, None, None, 0, None, None), (601, f"{prose(5, 34)} tail", None, None, 0, None, None)]
    rows += [(602, f"{prose(5, 34)} tail", None, None, 0, None, None), (None, None, None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("limit", [substring_dedup.LIMIT, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(substring_dedup, "LIMIT", limit)
    rows = repeat_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"copy": "_k1", "score": "ranges"}).withColumn("n_words", F.lit(-1))
    found = substring_dedup.remove_repeats(docs).collect()
    want = Counter(zip((r[0] for r in rows), brute_repeats([r[1] for r in rows])))
    got = Counter((r.doc_id, (r.n_words, r.n_removed, r.kept_sha256)) for r in found)
    assert got == want
    assert {r["_k1"] for r in found} <= {"x", None} and len(found) == len(rows)
    assert any(n_removed and n_removed < n for (_, (n, n_removed, _)) in want)


def test_repeats_of_no_rows(no_documents):
    assert substring_dedup.remove_repeats(no_documents).count() == 0


def test_super_kmers_cover_every_window_once():
    draw = random.Random(4)
    text = substring_dedup.normal(" ".join(draw.choice(["a", "b", "c", "dd"]) for _ in range(400)))
    found = substring_dedup.block_super_kmers([b"", text, b"x y", text[:300]])
    mine = found["text"] == 1
    covered = [s + j for s, n in zip(found["start"][mine], found["n_win"][mine]) for j in range(n)]
    assert covered == list(range(400 - 34))
    words = text.split(b" ")
    for s, n, packed in zip(found["start"][mine], found["n_win"][mine], [p for p, m in zip(found["packed"], mine) if m]):
        assert packed == b" ".join(words[s : s + n + 34]) and n <= substring_dedup.PACK
    again = substring_dedup.window_hashes(found["packed"])
    assert all((h == found["whole"][a : a + n]).all() for h, a, n in zip(again, found["first"], found["n_win"]))


def test_only_super_kmers_that_may_repeat_are_sent():
    loop = substring_dedup.normal(" ".join(["one two three"] * 40))
    found = substring_dedup.block_super_kmers([prose(91, 300).encode(), loop, prose(92, 300).encode()])
    none = np.zeros(1, np.uint64)
    sent = substring_dedup.may_repeat(found, none)
    assert len(sent) and set(found["text"][sent].tolist()) == {1}
    bits = none.copy()
    bits[0] |= np.uint64(1) << (found["minimiser"][:1].view(np.uint64)[0] & np.uint64(63))
    assert 0 in substring_dedup.may_repeat(found, bits)


def test_window_repeated_inside_one_super_kmer_is_removed(spark):
    rows = [(1, " ".join(["a b c d e f g h i j k"] * 6), None, None, 0, None, None), (2, prose(93, 80), None, None, 0, None, None)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {r[0]: b for r, b in zip(rows, brute_repeats([r[1] for r in rows]))}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == want and want[1][1]


def test_phrases_are_exact_when_hashes_meet(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BITS", 64)
    rows = [(i, f"{prose(i % 5, 12, 'abc')}, {prose(i, 30, 'ab')}", "en" if i % 3 else "fr", None, 0, None, None) for i in range(40)]
    found = phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=4, top=50, shards=3)
    assert set(map(tuple, found.collect())) == brute_collocations([(r[1], r[2]) for r in rows], least=4, top=50)


def test_counters_open_for_phrases_of_frequent_parts_only(spark):
    rows = [(i, f"the cat sat {prose(i, 30)}", "en", None, 0, None, None) for i in range(20)]
    table = phrases.write_blocks(phrases.pieces(spark.createDataFrame(rows, SCHEMA), shards=1))
    batch = table.select("lang", "words", "ids").toArrow().combine_chunks().to_batches()[0]
    hashes = np.array([phrases.xxhash.xxh64_intdigest(w) for w in (b"the", b"cat", b"sat")], np.uint64)
    marks = np.zeros(1 << 14, np.uint64)
    for key in phrases.gram_hashes(hashes, 1, "en"):
        key &= np.uint64((1 << 20) - 1)
        marks[key >> np.uint64(6)] |= np.uint64(1) << (key & np.uint64(63))

    class Shared:
        value = {1: [(1, marks)]}

    counted = [r for b in phrases._counter([2], 1, 1, Shared)(iter([batch])) for r in b.to_pylist()]
    keys = phrases.gram_hashes(hashes, 2, "en").view(np.int64).tolist()
    assert {r["key"]: r["count"] for r in counted if r["key"] in keys} == dict.fromkeys(keys, 20)
    assert len(counted) < 4


# Language


def test_rare_words_joined_in_rounds_give_the_same_languages(spark, documents, monkeypatch):
    monkeypatch.setattr(language, "WORD_SHARE", 0.02)
    docs = documents.select("doc_id", "text", "lang")
    model = language.learn(docs.filter("doc_id % 3 > 0").select("text", "lang"))
    results = []
    for rounds in (1, 3):
        monkeypatch.setattr(language, "ROUNDS", rounds)
        found = language.identify(docs.select("doc_id", "text"), model).collect()
        results.append(Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in found))
    assert results[0] == results[1] and sum(results[0].values()) == docs.count()


def test_a_language_is_joined_by_key_without_the_text(spark, documents):
    model = language.learn(documents.select("text", "lang"))
    found = language.identify(documents.select("doc_id", "text", F.lit(1).alias("text_key")), model)
    plan = found.select("doc_id", "lang_pred")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("md5" in line for line in joins)
    assert found.columns == ["doc_id", "text", "text_key", "lang_pred", "score"]
    assert {r.text_key for r in found.collect()} == {1}


# Collocations are named once


def test_a_frequent_phrase_is_named_by_one_block(spark, monkeypatch):
    made, plain = spark.sparkContext.accumulator(0), phrases._namer

    def spied(*given):
        def counted(batches):
            for batch in plain(*given)(batches):
                made.add(batch.num_rows)
                yield batch

        return counted

    monkeypatch.setattr(phrases, "_namer", spied)
    rows = [(i, f"the cat sat on {prose(i, 6)}", "en", None, 0, None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    counted = phrases.count_phrases(phrases.pieces(docs, shards=2), shards=2, least=30, longest=3)
    found = {(r.phrase, r["count"]) for r in counted.collect()}
    assert {("the cat sat", 60), ("cat sat on", 60), ("on", 60)} <= found
    assert made.value == len(found)


def test_phrases_of_one_key_are_counted_apart():
    keys, checks = np.array([9, 4, 9, 9], np.uint64), np.array([1, 7, 2, 1], np.int32)
    got = phrases._summed(keys, checks, np.array([5, 1, 3, 2]), np.array([0, 1, 2, 0]))
    assert [tuple(map(int, row)) for row in zip(*got)] == [(4, 7, 1, 1), (9, 1, 7, 0), (9, 2, 3, 2)]
