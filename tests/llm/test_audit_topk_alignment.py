"""The filter audit, exact top-k and token alignment against brute force, and on odd input."""

import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tidemark.llm import alignment, audit, common, packing, queries, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_audit(rows, labels):
    """The audit row by row: rows of (doc_id, text, lang)."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    marked = []
    for i, text, lang in rows:
        x = text or ""
        for c in "\t\n\x0b\x0c\r":
            x = x.replace(c, " ")
        words = [w for w in x.split(" ") if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in x) > 10 * len(x),
            "D": any(c in "#$%&*|" for c in x), "E": i is not None and first[text or ""] < i,
        }
        marked.append((lang or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in marked}:
        mine = [m for m in marked if m[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                n_fail = sum(f in m[1] for m in mine)
                out[part, order, step] = [f, len(left), len(gone), n_fail - len(gone), sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)]
                shapley[f] += len(gone)
        for (p, _, _), row in out.items():
            if p == part:
                row.append(shapley[row[0]])
    return out


def test_audit_is_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words[: rng.choice([3, 400])], k=rng.choice([5, 99, 100, 150]))) for _ in range(40)]
    texts += [t.upper() for t in texts[:6]] + [t + " #" for t in texts[6:12]] + [None, "", "", "\t\n ", "É" * 10 + "AB", "A" * 10, "word " * 60000]
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts + texts[:15] + [texts[0]] * 30)]
    rows += [(None, texts[0], "en"), (None, None, None), rows[3], rows[3], (7, "another text", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(60)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    # columns of the operator's own names, which it must leave alone
    docs = spark.createDataFrame([(*r, "s", 1, 5, True) for r in rows], f"{DOCS.replace('source', 'part')}, k1 long, good boolean")
    found = audit.interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = plain_audit(rows, labels)
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in found.collect()}
    assert got == want and len(got) == 3 * 600


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert audit.interactions(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_audit_tables_go_with_their_files(spark):
    from pathlib import Path

    docs = spark.createDataFrame([(1, "a #", "en", "s", 3)], DOCS)
    assert audit.interactions(docs, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).count() == 600
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_ids")]
    assert not list(Path(common.shared_dir(spark).removeprefix("file://")).glob("tidemark_ids_*"))


def plain_top(rows, every, k):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(q)) for i, q in fine if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i and len(v) == len(q))
        out += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, run", [(16384, 64), (64, 2), (7, 1)])
def test_top_k_is_brute_force(spark, monkeypatch, block, run):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "RUN", run)
    rng = random.Random(7)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1 / 64]) for _ in range(5)]) for i in range(300)]  # many ties
    rows += [(1000 + i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(200)]
    rows += [(2000, None), (2020, [float("nan")] * 5), (2040, [1.0, None, 1.0, 1.0, 1.0]), (2060, [float("inf")] * 5), (None, [1.0] * 5), (2080, [1.0, 2.0]), (2100, [3.0, -4.0]), (2120, []), (2140, [])]
    rows += [(-40, [0.5] * 5), (3000, [1e5, -1e5, 3.0, 0.0, 0.0]), rows[5], rows[20], rows[20], (40, [0.1, 0.2, 0.3, 0.4, 0.5])]
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, q int").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(docs, every=20, k=9).select("query_id", "rank", "vec_id", "score").collect())
    assert got == plain_top(rows, 20, 9)


def test_top_k_of_few(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty).collect() == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one).collect() == []


def test_huge_components_count_as_the_limit(spark):
    rows = spark.createDataFrame([(0, [1e300]), (1, [-1e300]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(rows).orderBy("rank").collect()] == [(2, 64 * topk.LIMIT), (1, -topk.LIMIT * topk.LIMIT)]


def test_digits():
    for n in [*range(-300, 300), 1 << 40, -(1 << 27)]:
        d = topk.digits(n)
        assert sum(s << p for p, s in d) == n and all(b[0] - a[0] > 1 for a, b in zip(d, d[1:]))


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(packing.default_tokenizer(), alignment.default_pieces())


ODD = [
    "x <|endoftext|> y", "▁x", "a\n  b\t c　d\xa0e", "<s>hi</s> <unk> <0x41>", " ", "\n", "é́ﬁ 👩‍👩‍👧 漢字テスト", " a▁b c", "=" * 70 + " " + "日本語" * 50, "nul\x00 and \r\n a\r b \r", "  lead  and trail  ", " x\x85y",
]


def plain_alignment(text, pair):
    """Both tokenizers over the whole text, and the groups by a walk along the bytes."""
    if not text:
        return None
    a, b = pair.a.plain.encode(" " + text, add_special_tokens=False).ids, pair.b.model.encode(text)
    spelt_a, spelt_b, data = [pair.a.bytes[i] for i in a], [pair.b.bytes[i] for i in b], (" " + text).encode()
    if b"".join(spelt_a) != data or b"".join(spelt_b) != data:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in spelt_a]).tolist(), np.cumsum([len(x) for x in spelt_b]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        i2, j2 = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    return a, b, groups


def plain_scores(texts, pair):
    aligned = [plain_alignment(t, pair) for t in texts]
    links = [Counter((x, y) for g in (r[2] if r else []) for x in g[0] for y in g[1]) for r in aligned]
    counts = Counter(p for row in links for p in row)
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for r, row in zip(aligned, links):
        groups = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in r[2]) if r else ""
        out.append((len(r[0]) if r else 0, len(r[1]) if r else 0, len(r[2]) if r else 0, sum(row.values()), groups, sum(n for p, n in row.items() if counts[p] == top[p[0]]), sum(n * counts[p] for p, n in row.items())))
    return out


@pytest.mark.parametrize("hot, piece, group", [(400_000, 400_000, 10_000), (50, 300, 2), (0, 40, 1)])
def test_alignment_is_brute_force(spark, sf, pair, monkeypatch, hot, piece, group):
    monkeypatch.setattr(alignment, "PIECE", piece)
    monkeypatch.setattr(alignment, "BATCH", 20_000)
    monkeypatch.setattr(alignment, "GROUP", group)
    texts = [r["text"] for r in common.table(spark, sf, "documents").collect()] + ODD + [None, "", ODD[2], ODD[2]]
    rows = [(i if i % 17 else None, t, 1, [5], "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, pairs array<int>, groups string").coalesce(2)
    # functions sent to tasks carry the module's numbers only where workers are forked anew, so the batch is checked here too
    parts = alignment._pieces(" " + texts[0], piece, pair.cut)
    assert "".join(parts) == " " + texts[0]
    found = alignment.score(common.written(alignment.align(docs)), alignment.n_pieces(), hot=hot)
    got = Counter(tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")) for r in found.collect())
    assert got == Counter(plain_scores(texts, pair))


def test_pieces_and_large_groups_change_nothing(pair, monkeypatch):
    texts = [" " + t for t in ODD] + [" " + " ".join(ODD * 30)]
    whole = alignment.align_texts(texts, pair)
    monkeypatch.setattr(alignment, "GROUP", 1)
    for t, want in zip(texts, whole):
        parts = alignment._pieces(t, 25, pair.cut)
        got = alignment._joined(alignment.align_texts(parts, pair))
        assert (got is None) == (want is None)
        if want:
            assert all(np.array_equal(got[k], want[k]) if k in ("keys", "times") else got[k] == want[k] for k in want)


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert alignment.score(common.written(alignment.align(empty)), alignment.n_pieces()).collect() == []


def test_new_queries_give_their_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("op11_filter_audit", "op12_exact_top_k"):
        got = queries.queries()[name](spark, sf)
        want = con.sql(queries.oracle_sql()[name])
        assert sorted(want.columns) == sorted(got.columns)
        order = [want.columns.index(c) for c in got.columns]
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
