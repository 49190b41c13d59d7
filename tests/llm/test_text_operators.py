"""Operators on documents: brute force on small tables, and the cases every operator has a defined result for."""

import hashlib
import os
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lang_id, licenses, packing, quality, repeats, secrets, simhash
from tidemark.llm.components import connected_components
from tidemark.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, h string, token string"
LONG = "word " * 9000 + "end"
ODD = [None, "", " \n\t", "one", "Two words", LONG, "the same text again and again " * 20, "the same text again and again " * 20, "Ünï çødé 漢字 🙂 ١٢٣", "a b c"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, None if i == 3 else "en", None, None, 7, "x", "y") for i, t in enumerate(ODD)]
    rows += [(4, "Two words", "en", "s", 1, 7, "x", "y"), (None, "no id here", None, "s", 1, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (3, 3), (None, 4), (5, 6), (6, 5)] + [(100, 100 + i) for i in range(50)] + [(1000 + i, 1001 + i) for i in range(40)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    good = [(a, b) for a, b in pairs if a is not None and a != b]
    assert found == roots(good, {x for p in good for x in p})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.components.BROADCAST_LINKS", 0)
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([(3, 2), (2, 1), (7, 8)], "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


# SimHash ------------------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, odd):
    for text in ODD:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    native = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0] % (1 << 64)
    assert native == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
@pytest.mark.parametrize("k", [4, 11, 16])
def test_anchors_lose_no_link(k, threshold):
    rng = np.random.default_rng(k)
    x = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, threshold, replace=False)) for _ in x], np.uint64)
    home, index, anchor = simhash.anchors(x ^ flips, k, threshold)
    reached = defaultdict(set)
    for i, a in zip(index.tolist(), anchor.tolist()):
        reached[i].add(a)
    assert all(h in reached[i] for i, h in enumerate(simhash.anchors(x, k, threshold)[0].tolist()))


@pytest.mark.parametrize("threshold", [5, 8, 10, 11])
def test_golay_anchors_lose_no_link(threshold):
    rng = np.random.default_rng(threshold)
    a = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    flips = [rng.permutation(64)[:threshold] for _ in a]
    b = a ^ np.array([np.bitwise_or.reduce(np.uint64(1) << f.astype(np.uint64)) for f in flips])
    home, index, anchor = simhash.golay_anchors(np.r_[a, b], threshold)
    at = [set(anchor[index == i].tolist()) for i in range(600)]
    assert sum(simhash.shares(threshold)) + 3 == threshold + 1
    assert all(set(home[:, i].tolist()) & at[300 + i] and set(home[:, 300 + i].tolist()) & at[i] for i in range(300))
    assert all(set(home[:, i].tolist()) <= at[i] for i in range(600))
    for (low, length), row in zip(simhash.SEGMENTS, home, strict=True):
        words = (np.r_[a, b] >> np.uint64(low) & np.uint64((1 << length) - 1)).astype(np.int64)
        assert np.bitwise_count(words ^ (row & (1 << 23) - 1)).max() <= 3


@pytest.mark.parametrize("split", [50_000, 7])
def test_wide_links_against_brute_force(spark, monkeypatch, split):
    """Ten bits of one fingerprint, 26 of both, over groups of near copies: one large, and some that only chance brings near."""
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 64, (60, 2), dtype=np.uint64)
    def flipped(x, n):
        for bit in rng.permutation(64)[:n]:
            x = x ^ np.uint64(1) << np.uint64(bit)
        return x
    rows = [(flipped(x, int(rng.integers(0, 9))), flipped(y, int(rng.integers(0, 14)))) for x, y in base for _ in range(3)]
    rows += [(flipped(base[0, 0], int(rng.integers(0, 5))), flipped(base[0, 1], int(rng.integers(0, 5)))) for _ in range(200)]
    rows += [(base[i, 0], rng.integers(0, 1 << 64, dtype=np.uint64)) for i in range(20)]
    fp, fp2 = (np.array(x, np.uint64) for x in zip(*rows, strict=True))
    one = np.bitwise_count(fp[:, None] ^ fp[None, :]).astype(int)
    near = (one <= 10) & (one + np.bitwise_count(fp2[:, None] ^ fp2[None, :]) <= 26)
    want = roots([(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True) if i != j], range(len(rows)))
    table = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(zip(fp.view(np.int64), fp2.view(np.int64), strict=True))], "node long, fp long, fp2 long")
    got = {r["node"]: r["root"] for r in connected_components(simhash.links(table, 10, len(rows), 26)).collect()}
    assert {i: got.get(i, i) for i in range(len(rows))} == dict(want)


def test_wide_near_duplicates_of_edited_texts(spark):
    """At five words and ten bits, copies with a word in a hundred changed meet, and others stay apart."""
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        texts += [" ".join(words), " ".join(w if i not in (50, 200) else "changed" for i, w in enumerate(words))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, words_per_shingle=5, threshold=10, both=26).collect()}
    assert sum(got[i + 1] == i for i in range(0, 120, 2)) >= 57 and all(got[i] in (i, i - i % 2) for i in got)


def test_near_pairs_by_segments(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 200, dtype=np.uint64)
    x = np.concatenate([base, base ^ np.uint64(1 << 40), base ^ np.uint64((1 << 3) | (1 << 63))])
    want = {(i, j) for j in range(len(x)) for i in range(len(x)) if (int(x[i]) ^ int(x[j])).bit_count() <= 2}
    pairs = lambda: {p for i, j in simhash.near_pairs(x, x, 2) for p in zip(i.tolist(), j.tolist())}
    assert pairs() == want
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert pairs() == want


def test_near_duplicates(spark, sf, odd, empty):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    for df in (docs, odd):
        texts = [(r["doc_id"], r["text"]) for r in df.collect()]
        prints = {t: plain_fingerprint(t) for _, t in texts if t is None or len(t) < 20000} | {LONG: simhash.fingerprint(LONG)}
        prints = {t: prints.get(t, simhash.fingerprint(t)) for _, t in texts}
        nodes = set(prints.values())
        up = roots([(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2], nodes)
        least = {}
        for i, t in texts:
            if i is not None:
                least[up[prints[t]]] = min(i, least.get(up[prints[t]], i))
        want = Counter((i, f"{prints[t]:016x}", least.get(up[prints[t]])) for i, t in texts)
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


# Language ID --------------------------------------------------------------------------------------------------------------------------


def test_language_accuracy_and_odd_cases(spark, odd, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = lang_id.train(docs.where(~held))
    found = lang_id.predict(docs.where(held), model, keep=["doc_id", "lang"]).toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.98 and found["score"].between(0, 1).all()
    out = lang_id.predict(odd, model, keep=odd.columns).collect()
    assert len(out) == odd.count() and all((r["lang_pred"] == "und") == (r["text"] is None or not any(map(str.isalpha, r["text"]))) for r in out)
    assert lang_id.predict(empty, model).count() == 0 and lang_id.train(empty) is None
    assert {r["lang_pred"] for r in lang_id.predict(odd, None).collect()} == {"und"}


@pytest.mark.parametrize("span", [1, 5, 17, 200])
def test_presence_in_spans_is_presence(monkeypatch, span):
    texts = ["Über den Fluß and the river, " * 50, "a   \n\n  b" * 40, "ΟΔΥΣΣΕΥΣ ΣΑΣ. ΣΑΣ' ΣΑΣ " * 9, "noblanks" * 90, "     ", " İI" * 30, "end of line\r\n" * 20, "x", ""]
    whole = [lang_id.presence(t).tolist() for t in texts]
    monkeypatch.setattr(lang_id, "SPAN", span)
    assert [lang_id.presence(t).tolist() for t in texts] == whole


def plain_kernel_ridge(train, texts, languages):
    """Scores of a plain Nyström kernel ridge: presence n-grams as sets, kernels as shares of common ones, nothing hashed or batched."""
    sets = lambda t: set(lang_id.presence(t).tolist())
    kernel = lambda a, b: len(a & b) / (max(1, len(a)) * max(1, len(b))) ** 0.5
    x, y = [sets(t) for t, _ in train], np.array([[1.0 if lang == name else -1.0 for name in languages] for _, lang in train])
    marks, seen = [], {}
    for s, (_, lang) in zip(x, train):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= lang_id.LANDMARKS_PER_LANGUAGE:
            marks.append(s)
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.array([[kernel(a, b) for b in marks] for a in x]) @ root
    weight = 1 / np.array([seen[lang] for _, lang in train])
    weight /= weight.mean()
    solved = np.linalg.solve(phi.T @ (phi * weight[:, None]) + lang_id.RIDGE * len(train) * np.eye(phi.shape[1]) / phi.shape[1], (phi * weight[:, None]).T @ y)
    return np.array([[kernel(sets(t), b) for b in marks] for t in texts]) @ root @ solved


def test_language_scores_are_those_of_a_plain_kernel_ridge(spark, sf):
    rows = [r for r in table(spark, sf, "documents").select("doc_id", "text", "lang").limit(60).collect() if r["text"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(docs)
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    train = [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], hashes[r["doc_id"]]))]
    texts = [r["text"] for r in rows[:12]] + ["the river and the bridge", "el río y la casa"]
    assert np.allclose(model.scores(texts), plain_kernel_ridge(train, texts, model.languages), atol=2e-3)


def test_language_fit_takes_little_of_the_driver(spark):
    n = 4 * (lang_id.TRAIN_PER_LANGUAGE + 20)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(f"-{i}")), 256) for i in range(4)]).alias("text"), F.concat(F.lit("l"), F.col("id") % 4).alias("lang"))
    tracemalloc.start()
    try:
        model, (_, most) = lang_id.train(docs), tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(model.languages) == 4 and np.isfinite(model.weights).all() and model.weights.any()
    assert most < 80e6  # of some 1,600 rows of 32,768 presence bits, 210 MB as numbers


def test_odd_names_and_many_candidates(spark):
    """Columns named as the operators name theirs stay or give way as stated; starts are right however many candidates a text has."""
    model = secrets.fit(secrets.labelled_findings(spark))
    digests = [f"{i:040x}" for i in range(700)]
    text = "key = " + " and ".join(digests)
    docs = spark.createDataFrame([(1, text, 7, "f", 3.0, "x"), (2, None, 8, "f", 3.0, "x"), (3, "", 9, "f", 3.0, "x")], "doc_id long, text string, __v long, findings string, score double, `a.b` string")
    named = secrets.scan(docs, model, names=("own", "masked"))
    assert named.columns == [*docs.columns, "own", "masked"]
    found = {r["doc_id"]: r for r in named.collect()}
    assert [found[i]["__v"] for i in (1, 2, 3)] == [7, 8, 9] and {r["findings"] for r in found.values()} == {"f"} and found[1]["a.b"] == "x" and found[2]["own"] == [] == found[3]["own"]
    assert [(f["start"], text[f["start"] : f["start"] + f["length"]]) for f in found[1]["own"]] == [(6 + 45 * i, d) for i, d in enumerate(digests)]
    predicted = lang_id.predict(docs, None, keep=["doc_id", "score"])
    assert predicted.columns == ["doc_id", "lang_pred", "score"] and {r["score"] for r in predicted.collect()} == {0.0}


# Packing ------------------------------------------------------------------------------------------------------------------------------


def test_packing(spark, sf, odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for df in (table(spark, sf, "documents").select("doc_id", "text"), odd):
        ids = [(r["doc_id"], [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in df.collect()]
        want = Counter()
        for doc, x in ids:
            for j, (start, n) in enumerate(packing.cut(len(x))):
                want[doc, j, start, n, zlib.crc32(np.array(x[start : start + n], "<u4").tobytes())] += 1
        rows = packing.pack(packing.pieces(df, with_ids=True)).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"], r["ids"]))
        for x in bins.values():
            at = 0
            for offset, length, piece in sorted(x):
                assert offset == at and len(piece) == 4 * length
                at += length
            assert at <= 1024
        total = sum(r["length"] for r in rows)
        assert len(bins) <= -(-total // 1024) + 3
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_cut_and_plan():
    assert packing.cut(1024) == [(0, 1024)] and packing.cut(1025) == [(0, 1), (1, 1024)] and packing.cut(5) == [(0, 5)] and packing.cut(0) == []
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = Counter(rng.integers(1, 65, 40).tolist())
        made = packing.plan(dict(counts), 64)
        used = Counter()
        for pattern, times in made:
            assert sum(x * n for x, n in pattern.items()) <= 64
            for x, n in pattern.items():
                used[x] += n * times
        assert used == counts
    room, counts = 50, {7: 3, 11: 2, 13: 5, 20: 1}
    best = max(a * 7 + b * 11 + c * 13 + d * 20 for a in range(4) for b in range(3) for c in range(6) for d in range(2) if a * 7 + b * 11 + c * 13 + d * 20 <= room)
    assert sum(x * n for x, n in packing.fullest(room, counts).items()) == best


def test_sequences_hold_the_ids(spark, odd):
    packed = packing.pack(packing.pieces(odd, with_ids=True))
    assert sum(len(r["ids"]) for r in packing.sequences(packed).collect()) == 4 * packed.agg(F.sum("length")).first()[0]


# Repeats ------------------------------------------------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    data, seen = [(t or "").encode() for t in texts], Counter()
    for b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1))
        yield len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


def test_difference_cover():
    for q in (3, 5, 7, 11):
        v, cover = repeats.difference_cover(q)
        assert v == q * q + q + 1 and len(cover) == q + 1 and {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_repeats(spark, empty):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdé"), n))
    passage, tail = word(90), word(45)
    texts = [None, "", "short", word(300), word(50) + passage + word(40), passage[5:] + word(9), word(3) + passage[:60] + word(30), tail, word(20) + tail + word(10)]
    texts += ["x" * 200, word(7) + "ab" * 60, "copy of " + passage, "copy of " + passage, tail[:39], word(500) + passage + word(500)]
    rows = [(None if i == 4 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("blob", F.lit(1))
    got = repeats.remove_repeats(df, length=40, q=5).collect()
    want = Counter(zip((r[0] for r in rows), brute_repeats(texts, 40)))
    assert Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == want
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_in_small_chunks(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", 0)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = dict(zip((i for i, _ in texts), brute_repeats([t for _, t in texts], 400)))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs).collect()}
    assert got == want


def test_equal_strings_need_both_digests():
    """Keys that agree in the first eight bytes alone are no ties, whatever their order."""
    first = np.array([5, 9, 5, 5, 9, 7], np.uint64) << np.uint64(60) | np.uint64(3)
    second = np.array([1, 2, 8, 1, 3, 4], np.uint64) << np.uint64(40)
    n = repeats.SUFFIX_BYTES
    blob = repeats._packed(repeats._cut([first, second], n), n)
    assert len(blob) == 6 * n
    group = pa.table({"chunk_id": [4, 6], "bucket": [0, 0], "keys": pa.array([blob[: 4 * n], blob[4 * n :]], pa.binary())})
    maps = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in repeats._tied(n)(group).column("tied").to_pylist()]
    assert maps[0][:4].tolist() == [1, 0, 0, 1] and maps[1][:2].tolist() == [0, 0]
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 40, 500).astype(np.uint64) << np.uint64(58), rng.integers(0, 3, 500).astype(np.uint64) << np.uint64(50)]
    for _, kept, index, rows in repeats._dealt(keys, 7, n):
        assert (kept[:, index] == repeats._cut(keys, n)[:, rows]).all()


def test_repeats_of_other_ids(spark):
    """Ids of any type come back as they are; a failure leaves no table behind."""
    text = "".join(chr(97 + i * i % 23) for i in range(60))
    for kind, ids in (("date", ["2026-01-01", "2026-01-02", None]), ("decimal(20,2)", ["1.50", "2.25", None]), ("timestamp", ["2026-01-01 00:00:00", None, "2026-01-03 00:00:00"])):
        df = spark.createDataFrame([(ids[0], text + "x" * 41), (ids[1], text), (ids[2], "y" + text)], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        out = repeats.remove_repeats(df, length=40, q=5)
        assert out.schema["doc_id"].dataType == df.schema["doc_id"].dataType
        assert sorted((str(r["doc_id"]), r["n_removed"]) for r in out.collect()) == sorted(zip([str(r["doc_id"]) for r in df.collect()], [101, 60, 60], strict=True))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_chunks")]


# Decontamination ----------------------------------------------------------------------------------------------------------------------


def brute_contamination(docs, items):
    form = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = form(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[s : s + 10])].add(str(i) if i is not None else "")
    for i, t in docs:
        w, hit, found = form(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        yield i, len(w), len(hit), ",".join(sorted(found)), bool(hit)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_decontamination_of_few_words(spark, monkeypatch, limit):
    """Texts of a small vocabulary, in which windows overlap, begin alike and repeat, one word in a third of all places."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rng = np.random.default_rng(8)
    words = np.array(["the", "a", "B", "c3", "é", "É", "z"])
    text = lambda n: " ".join(rng.choice(words, n, p=[0.34, 0.16, 0.1, 0.1, 0.1, 0.1, 0.1]))
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(1, 16, 60))]
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 60, 120))]
    docs += [(200 + i, "".join(map(chr, range(128))) + t + "\u0085\u00a0x".join(t.split()[:3])) for i, (_, t) in enumerate(items)]
    docs += [(500, " ".join(t for _, t in items) * 3)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in decontaminate.decontaminate(df, bench).collect())
    assert got == Counter(brute_contamination(docs, items))


def test_decontamination_of_long_texts_is_linear(spark):
    """The same words in two long texts or in many short ones make as many rows: none carries its text along."""
    bench = spark.createDataFrame([(1, "p q r s t u v w x y z")], "item_id long, text string")
    for n, size in ((2, 80_000), (400, 400)):
        df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("some word "), size // 2), F.lit("p q r s t u v w x y")).alias("text"))
        out = decontaminate.decontaminate(df, bench)
        assert out.agg(F.sum("n_hit"), F.sum("n_words")).first() == (10 * n, n * (size + 10))


@pytest.mark.parametrize("limit", [100_000, 0])
def test_decontamination(spark, odd, empty, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[:15])), (2, "lone"), (3, "Élan two"), (4, None), (5, "!!"), (6, " ".join(words[5:25])), (None, "null item here"), (7, "a a a a a a a a a a")]
    docs = [(0, "x " + " ".join(words[:12]).upper() + " y"), (1, " ".join(words)), (2, "the lone-wolf"), (3, "élan two"), (4, "Élan TWO, Élan two"), (5, None), (6, ""), (7, "a " * 25), (7, "a " * 25), (8, "null item here"), (None, "lone")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(0)), spark.createDataFrame(items, "item_id long, text string").withColumn("offset", F.lit(1))
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in decontaminate.decontaminate(df, bench).collect())
    assert got == Counter(brute_contamination(docs, items))
    assert decontaminate.decontaminate(odd, bench).count() == odd.count() and decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(df, bench.limit(0)).where("contaminated").count() == 0


# Secrets ------------------------------------------------------------------------------------------------------------------------------


def test_secrets(spark, odd, empty):
    model = secrets.fit(secrets.labelled_findings(spark))
    held = secrets.labelled_findings(spark, 9600).where("label is not null").exceptAll(secrets.labelled_findings(spark))
    scored = held.select("label", F.struct(*secrets.features(F.col("value"), F.col("left"), F.col("right"), F.col("path"), model.transitions)).alias("c")).select("label", F.expr(secrets.score(model, "c")).alias("s"))
    assert scored.select(F.avg(((F.col("s") >= 0.5).cast("int") == F.col("label")).cast("int"))).first()[0] > 0.97
    key = hashlib.sha1(b"k").hexdigest()
    texts = [f'ok token = "{key}" end {key[:8]}', "call 4111111111111111 now", f"commit {key} fixed it", None, "", f'token = "{key}"token = "{key[::-1]}"']
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("__v", F.lit(1))
    out = {r["doc_id"]: r for r in secrets.scan(rows, model).collect()}
    assert out[0]["redacted"] == f'ok token = "[SECRET]" end {key[:8]}' and [(f["start"], f["length"]) for f in out[0]["findings"] if f["secret"]] == [(12, 40)]
    assert out[1]["redacted"] == texts[1] and out[2]["redacted"] == texts[2] and out[3]["redacted"] is None and out[4]["redacted"] == ""
    assert out[5]["redacted"] == 'token = "[SECRET]"token = "[SECRET]"'
    assert secrets.scan(odd, model, path_col="source").count() == odd.count() and secrets.scan(empty, model).count() == 0
    with pytest.raises(ValueError):
        secrets.scan(rows.withColumn("redacted", F.lit(1)), model)


def test_secrets_in_whole_texts(spark):
    import base64

    model = secrets.fit(secrets.labelled_findings(spark))
    lines, whole = [], []
    for i in range(40):
        key = hashlib.sha256(f"held {i}".encode()).hexdigest()
        b64 = base64.b64encode(hashlib.sha512(key.encode()).digest()).decode().replace("=", "")
        letters = "".join(c for c in b64 + b64.swapcase() if c.isalpha())
        lines += [
            ("API_KEY={}", key[:32]), ("export GITHUB_TOKEN={}", "ghp_" + letters[:20] + key[:16]), ("GET https://example.org/v1/items?access_token={}&page=2", key[:40]), ("AWS_SECRET_ACCESS_KEY={}", b64[:40]),
            ("password={}", letters[:32]), ('secret = "{}"', letters[:66] + "7" + letters[:4]), ("AWS_SECRET_ACCESS_KEY=\"{}\"", key[:40]), ("auth: '{}'", letters[:24]),
        ]
    whole = [
        "Internationalization and counterrevolutionaries in /usr/local/share/applications/", "Donaudampfschifffahrtsgesellschaft", "-" * 60, "name = get_access_token_from_header(request)", "sha256=" + "0a1b" * 16,
        "see https://example.org/guides/getting-started-with-streams?sort=most-recently-changed", "AWS_SECRET_ACCESS_KEY is not set", "class=navigation-container-wide",
    ]
    texts = [f"first line\n{put.format(v)}\nlast line" for put, v in lines] + whole
    got = {r["i"]: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).collect()}
    exact = [got[i]["redacted"] == f"first line\n{put.format('[SECRET]')}\nlast line" for i, (put, _) in enumerate(lines)]
    for k in range(8):
        assert sum(exact[k::8]) >= 38, (lines[k], got[k]["redacted"])
    assert [got[len(lines) + i]["redacted"] for i in range(len(whole))] == whole


def plain_candidates(text):
    """Candidates by a loop over the characters: maximal runs, with one or two '=' behind them unless a value follows."""
    key, out, i = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"), [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in key:
            j += 1
        if j - i >= 16:
            pad = next((n for n in (2, 1) if text[j : j + n] == "=" * n and text[j + n : j + n + 1] not in key), 0)
            out.append((i, j + pad - i))
        i = max(j, i + 1)
    return out


def test_secret_scan_against_loops(spark):
    """Places of candidates, the share of likely transitions and the masked text, against plain loops over random texts."""
    import math

    model = secrets.fit(secrets.labelled_findings(spark))
    rng = np.random.default_rng(1)
    letters = np.array(list("abcXYZ019+/_-== \n\"é😀.:"))
    texts = ["".join(rng.choice(letters, int(n))) if k % 2 else "".join(rng.choice(letters[:12], int(n))) + "=" * (k % 5) + "x😀" for k, n in enumerate(rng.integers(0, 120, 150))]
    got = {r["i"]: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).collect()}
    for i, text in enumerate(texts):
        found = got[i]["findings"]
        assert [(f["start"], f["length"]) for f in found] == plain_candidates(text)
        masked, at = "", 0
        for f in found:
            if f["secret"]:
                masked, at = masked + text[at : f["start"]] + secrets.MASK, f["start"] + f["length"]
        assert got[i]["redacted"] == masked + text[at:]
    values = ["getAccessTokenFromHeader", "zq9x8kvw7Jqz", "a", "Straße é-1"]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, value string")
    likely = {r["i"]: r["likely"] for r in rows.select("i", *secrets.features(F.col("value"), F.lit(""), F.lit(""), F.lit(""), model.transitions)).collect()}
    n = len(secrets.CLASSES)
    for i, value in enumerate(values):
        codes = [secrets.CLASSES.index("0" if "0" <= c <= "9" else c if "a" <= c <= "z" else "#") for c in value.lower()]
        want = sum(model.transitions[a * n + b] for a, b in zip(codes, codes[1:])) / max(1, len(value) - 1)
        assert math.isclose(likely[i], want, abs_tol=1e-9)
    assert likely[0] > likely[1] + 1


def test_secret_path_counts(spark):
    model = secrets.fit(secrets.labelled_findings(spark))
    text = f'token = "{hashlib.sha1(b"path").hexdigest()}"'
    paths = ["src/auth.py", "", None, "src/latest/docker.py", "tests/test_login.py", "lib/fixtures/login.json", "docs/login.md"]
    rows = spark.createDataFrame([(i, text, p) for i, p in enumerate(paths)], "i int, text string, path string")
    got = {r["i"]: r["findings"][0] for r in secrets.scan(rows, model, path_col="path").collect()}
    assert [got[i]["secret"] for i in range(7)] == [True] * 4 + [False] * 3
    assert min(got[i]["score"] for i in range(4)) > max(got[i]["score"] for i in range(4, 7)) + 0.2


def test_secret_score_is_the_forests(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    findings = secrets.labelled_findings(spark, 320)
    model = secrets.fit(findings)
    rows = findings.select(F.struct(*secrets.features(F.col("value"), F.col("left"), F.col("right"), F.col("path"), model.transitions)).alias("c")).select("c", "c.*")
    both = model.forest.transform(VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(rows)).select(vector_to_array("probability")[1].alias("p"), F.expr(secrets.score(model, "c")).alias("s"))
    assert both.select(F.max(F.abs(F.col("p") - F.col("s")))).first()[0] < 1e-4


# Licences, quality --------------------------------------------------------------------------------------------------------------------


def test_licenses(spark, odd, empty):
    known = licenses.known(spark)
    mit = licenses.LICENSES[0][1]
    texts = ["Copyright (c) 2020 Someone\n" + mit.upper().replace("LICENSE", "LICENCE"), "Text.\nReleased under the MIT Licence!", "licensed for nothing", None, "a\n\nSPDX-License-Identifier: MIT\n\nb", mit + " changed"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("digest", F.lit("d"))
    out = {r["doc_id"]: r for r in licenses.scan(df, known).collect()}
    assert out[0]["whole_license"] == "MIT" and out[1]["licenses"] == "MIT" and out[1]["whole_license"] is None and out[4]["n_matches"] == 2
    assert all(out[i]["licenses"] == "" for i in (2, 3, 5))
    assert licenses.scan(odd, known).count() == odd.count() and licenses.scan(empty, known).count() == 0
    with pytest.raises(ValueError):
        licenses.known(spark, [("x", "nothing to look for")])


def plain_canonical(text):
    out = re.sub(licenses.COPYRIGHT_LINE, "\n", text.lower())
    for word, same in licenses.SPELLINGS:
        out = out.replace(word, same)
    return re.sub(licenses.PUNCTUATION, " ", out).strip()


def test_known_licenses_in_other_dress(spark):
    """Every known text, with another case, spelling, punctuation and copyright line, is found as a whole; digests against plain code."""
    known = licenses.known(spark)
    texts = [(name, "Copyright (c) 2031 Some Body. All rights reserved.\n\n" + text.swapcase().replace(", ", " -- ").replace("\n", "\n  ") + "\n") for name, text in licenses.LICENSES]
    folder = "/usr/share/common-licenses"
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.3", "GFDL-1.3")):
        if os.path.exists(f"{folder}/{file}"):
            with open(f"{folder}/{file}") as f:
                texts.append((name, f.read().replace("license", "licence").upper()))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan(df, known).collect()}
    assert [out[i]["whole_license"] for i in range(len(texts))] == [name for name, _ in texts]
    assert all(out[i]["text_digest"] == hashlib.sha256(plain_canonical(t).encode()).hexdigest() for i, (_, t) in enumerate(texts))


def test_quality(spark, odd, empty):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    out = quality.classify(docs).join(labels, "doc_id").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.5
    assert quality.classify(odd).count() == odd.count() and quality.classify(empty).count() == 0
    assert not any(r["kept"] for r in quality.classify(odd).where("doc_id < 3").collect())


def test_posteriors_find_the_accuracies():
    rng = np.random.default_rng(0)
    truth, accuracy = rng.random(20000) < 0.8, [0.95, 0.9, 0.8, 0.7, 0.9]
    seen = np.array([np.where(rng.random(20000) < a, truth, ~truth).astype(int) for a in accuracy]).T
    patterns, where, counts = np.unique(seen, axis=0, return_inverse=True, return_counts=True)
    p, tables = quality.posteriors(patterns, counts.astype(float))
    assert ((p[where.ravel()] > 0.5) == truth).mean() > 0.95
    assert np.allclose(tables[:, 1, 1], accuracy, atol=0.03)


