"""Embedding near-dedup, tool-call linking and the pipeline."""

import json
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, embeddings, queries
from tidemark.llm.common import table
from tidemark.llm.simhash import Forest


def brute_links(rows, threshold=0.9):
    """(id, n_links, component) of each row; rows of ids and vectors or None."""
    found = [(i, embeddings.unit(v)) for i, v in rows]
    forest, links = Forest(), Counter()
    for a, (_, x) in enumerate(found):
        for b, (_, y) in enumerate(found):
            if a < b and x is not None and y is not None and len(x) == len(y) and x @ y >= threshold:
                links[a] += 1
                links[b] += 1
                forest.link(a, b)
    groups = {}
    for a, (i, _) in enumerate(found):
        if i is not None:
            groups[forest.root(a)] = min(i, groups.get(forest.root(a), i))
    for a, (i, _) in enumerate(found):
        yield i, links[a], groups.get(forest.root(a))


def noisy_groups(rng, n, size, copies):
    base = rng.normal(size=(n, size))
    out = [b for b in base]
    for b in base[: n // 5]:
        out += [b + rng.normal(size=size) * np.linalg.norm(b) / np.sqrt(size) * rng.uniform(0.05, 0.55) for _ in range(copies)]
    return [list(map(float, x * rng.uniform(0.1, 50))) for x in out]


@pytest.mark.parametrize("split", [False, True])
def test_links_against_brute_force(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(embeddings, "TARGETS", 16)
        monkeypatch.setattr(embeddings, "QUERIES", 16)
    rows = list(enumerate(noisy_groups(np.random.default_rng(4), 120, 24, 6)))
    rows += [(1000 + i, rows[0][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("u", F.lit(1)).withColumn("label", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, z=5.0).collect()}  # z over the root of the size: no link is missed
    want = {i: (n, c, i == c) for i, n, c in brute_links(rows)}
    assert got == want and sum(n for n, _, _ in want.values()) > 500


@pytest.mark.parametrize("size", [64, 256])
def test_no_link_is_lost_on_uneven_vectors(spark, size):
    rng = np.random.default_rng(9)
    spread = 1 / np.arange(1, size + 1)
    base = rng.normal(size=(300, size)) * spread
    near = [b + rng.normal(size=size) * spread * f for b in base[:150] for f in (0.1, 0.25, 0.4)]
    other = noisy_groups(rng, 20, size + 1, 4)
    rows = list(enumerate([list(map(float, x)) for x in [*base, *near]] + other))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    want = {i: (n, c) for i, n, c in brute_links(rows)}
    assert got == want and sum(n for n, _ in want.values()) > 500 and any(want[i][0] for i in range(750, len(rows)))


def test_recall_on_the_table(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    noise = F.transform("embedding", lambda x, i: x + 0.02 * F.sin(i * 12.9 + F.col("vec_id")))
    both = df.select("vec_id", "embedding").unionByName(df.where("vec_id % 3 = 0").select((F.col("vec_id") + 10000).alias("vec_id"), noise.alias("embedding")))
    got = both.join(embeddings.near_duplicates(both), "vec_id").toPandas()
    x = np.stack([embeddings.unit(list(v)) for v in got.embedding])
    want = ((x @ x.T) >= 0.9).sum(axis=1) - 1
    assert want.sum() > 1000 and got.n_links.sum() / want.sum() >= 0.99 and (got.n_links <= want).all()


def test_odd_vectors(spark):
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1e200, 1e200]), (7, [1e-200, 1e-200]), (8, [1.0, -1.0]), (9, [1.0, 2.0, 3.0]), (6, [1e200, 1e200]), (None, [2.0, -2.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect())
    assert got == Counter([(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 2, 6), (7, 2, 6), (8, 1, 8), (9, 0, 9), (6, 2, 6), (None, 1, 8), (None, 0, None)])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.near_duplicates(df.where("vec_id = 0")).collect()[0]["component_id"] == 0


CALL = {"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "x", "limit": 3}}, {"id": "b", "name": "calculator", "arguments": '{"expression": "1+1", "z": 1}'}, {"name": "search", "arguments": {}}], "content": None}


def test_linking(spark):
    result = lambda i, c: json.dumps({"content": c, "tool_call_id": i})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", json.dumps(CALL)), (1, 2, "user", "and?"), (1, 3, "tool", result("a", {"z": 1, "a": [True, None]})), (1, 4, "tool", result("nope", "")),
        (1, 5, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "again"}}]})),
        (2, 0, "tool", result("a", 1)), (None, 0, "tool", result("a", 1)), (3, 0, None, None), (3, 0, None, None), (4, 0, "assistant", '{"tool_calls": NaN}'), (4, 1, "assistant", "{broken"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("status", F.lit("x")).withColumn("first", F.lit(1))
    out = chat.link(df).orderBy("conv_id", "at_turn", "at_stage", "at_part", "turn").collect()
    one = [(r["turn"], r["part"], r["kind"], r["status"].split(":")[0]) for r in out if r["conv_id"] == 1]
    assert one == [
        (0, 0, "message", "ok"), (1, 0, "message", "ok"), (1, 1, "call", "ok"), (1, 2, "call", "invalid"), (1, 3, "call", "invalid"), (3, 0, "result", "ok"), (2, 0, "message", "ok"), (4, 0, "result", "orphan"), (5, 0, "message", "ok"), (5, 1, "call", "duplicate"),
    ]
    assert [r["status"] for r in out if r["conv_id"] in (2, None)] == ["orphan", "orphan"]
    assert sum(r["conv_id"] == 3 for r in out) == 2
    lines = [r["line"] for r in out]
    assert all(chat.canonical(json.loads(x)) == x for x in lines)
    assert '{"content":{"a":[true,null],"z":1},"role":"tool","tool_call_id":"a"}' in lines
    assert chat.link(df.limit(0)).count() == 0


def plain_links(rows, schemas):
    """The lines of each conversation in order, by loops over whole conversations."""
    out, by = [], defaultdict(list)
    for conv, turn, role, text in rows:
        for part, kind, call, errors, line in chat.parts(role, text, schemas):
            by[conv].append((turn, part, kind, call, errors, line))
    for conv, found in by.items():
        first, answered = {}, set()
        for turn, part, kind, call, _, _ in sorted(found, key=lambda x: x[:2]):
            if kind == "call" and call is not None and conv is not None:
                first.setdefault(call, (turn, part))
            if kind == "result" and conv is not None:
                answered.add(call)
        for turn, part, kind, call, errors, line in found:
            known = first.get(call) if conv is not None else None
            status, place = "ok", (turn, {"message": 0, "result": 0, "call": 1}[kind], part)
            if kind == "result":
                status, place = ("ok", (known[0], 2, known[1])) if known else ("orphan", place)
            elif kind == "call":
                late = known is not None and known != (turn, part)
                status = f"invalid: {errors}" if errors else "duplicate" if late else "unanswered" if call not in answered or conv is None else "ok"
            out.append((conv, turn, part, kind, call, status, *place, line))
    return Counter(out)


def test_links_of_random_conversations(spark):
    rng = np.random.default_rng(5)
    rows, ids = [], ["a", "b", "c", "d", "", "\ud800", 7]
    for turn in range(900):
        conv = [None, 1, 1, 1, *range(2, 30)][rng.integers(32)]
        kind = rng.integers(4)
        call = lambda: {"id": ids[rng.integers(7)], "name": ["search", "calculator", "other"][rng.integers(3)], "arguments": [{"query": "x"}, '{"expression": "1"}', {"limit": 1e300}, None, {"\udc00": 1}][rng.integers(5)]}
        if kind == 0:
            rows.append((conv, turn // 3, "user", f"text {turn % 7}"))
        elif kind == 1:
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": [call() for _ in range(rng.integers(4))], "content": "c"})))
        else:
            rows.append((conv, turn, "tool", json.dumps({"tool_call_id": ids[rng.integers(7)], "content": [1.5, "\ud800", "ok"][rng.integers(3)]})))
    df = spark.createDataFrame(rows + rows[:20], "conv_id long, turn int, role string, text string")
    out = chat.link(df).collect()
    assert {r["status"].split(":")[0] for r in out} == {"ok", "invalid", "unanswered", "orphan", "duplicate"}
    assert Counter(tuple(r) for r in out) == plain_links(rows + rows[:20], chat.SCHEMAS)


def test_odd_messages():
    one = lambda t, role="assistant", schemas=chat.SCHEMAS: chat.parts(role, t, schemas)
    call = lambda arguments, name="search": '{"tool_calls": [{"id": "a", "name": "%s", "arguments": %s}]}' % (name, arguments)
    for number in ("1e999", "-1e999", "NaN", "Infinity"):
        assert [x[1] for x in one(call('{"query": "x", "limit": %s}' % number))] == ["message"]
        assert [x[1] for x in one('{"tool_call_id": "a", "content": %s}' % number, "tool")] == ["message"]
    assert one(call('"{\\"limit\\": 1e999}"'))[1][3] == "$: not of type object"
    assert one(call('{"query": "x", "limit": 1e300}'))[1][3] == "" and one(call('{"query": "x", "limit": 1.5}'))[1][3] == "$.limit: not of type integer"
    listed = {"t": {"type": "object", "properties": {"n": {"type": ["integer", "null"]}, "m": {"type": "thing"}}}}
    assert [one(call(a, "t"), schemas=listed)[1][3] for a in ('{"n": null}', '{"n": 2}', '{"n": "x"}', '{"m": 1}')] == ["", "", "$.n: not of type integer or null", "$.m: not of type thing"]
    for text in ('{"tool_call_id": "\\ud800", "content": 1}', '{"tool_call_id": "", "content": 1}', '{"tool_call_id": "a", "content": "\\ud800"}', call('{"\\ud800": 1, "expression": "1"}', "calculator"), "{" * 100_000, '{"tool_calls": [' * 50_000, '{"tool_calls": [], "content": ' + "[" * 900 + "]" * 900 + "}", "9" * 9000, '{"content": ' + "9" * 9000 + "}"):
        for role in ("tool", "assistant"):
            for *_, errors, line in one(text, role):
                assert (errors + line).encode("utf-8") and json.loads(line)


def test_schemas():
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "l": {"type": "array", "items": {"type": "string"}}, "e": {"enum": [1, 2]}}, "required": ["n"]}
    assert chat.problems({"n": 1, "l": ["a"], "e": 2}, schema) == []
    assert chat.problems({"l": ["a", 1], "e": 3}, schema) == ["$.n: missing", "$.e: not one of the allowed values", "$.l[1]: not of type string"]
    assert chat.problems({"n": True}, schema) == ["$.n: not of type integer"] and chat.problems([], schema) == ["$: not of type object"]


def test_whole_conversations(spark, sf):
    out = queries.op5_chat_linking(spark, sf)
    assert out.where("part = 0").count() == table(spark, sf, "conversations").count()


def test_pipeline(spark, sf):
    docs, before = table(spark, sf, "documents"), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        before, docs = docs, out.cache()
        if name == "language_id":
            assert docs.count() == before.count()
        if name == "decontamination":
            from tidemark.llm import decontaminate

            bad = decontaminate.decontaminate(before, table(spark, sf, "benchmark")).where("contaminated")
            assert docs.count() == before.count() - bad.count() and 0 < bad.count() < 0.2 * before.count()
        if name == "secret_scan":
            assert docs.where("text rlike 'token = \"[0-9a-f]{40}\"'").count() == 0 and docs.where("n_chars <> length(text)").count() == 0
            assert docs.join(before.select("doc_id", F.col("text").alias("old")), "doc_id").where("text = old").count() > 0.9 * before.count()
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


def test_pipeline_stages_on_odd_rows(spark, sf):
    schema = table(spark, sf, "documents").schema
    rows = [(None, None, None, None, None), (1, "", None, None, None), (2, "Same text here", "en", "s", 14), (2, "Same text here", "en", "s", 14), (3, "same text here", "en", None, None), (None, "Other text, no id", None, None, None), (4, "123 !!", "en", "s", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())
        assert got == ([(False, 2), (True, 0)] if data else [])


def test_stages_with_columns_of_any_name(spark, sf):
    """Extra columns named as the operators name theirs come through the first and the fourth stage unchanged."""
    docs = table(spark, sf, "documents").limit(40)
    named = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in ("score", "lang_pred", "findings", "redacted", "row", "__v")])
    for stage in (corpus_pipeline.language_stage, corpus_pipeline.secret_stage):
        plain, extra = stage(spark, docs, sf), stage(spark, named, sf)
        assert extra.columns == named.columns
        assert sorted(map(tuple, extra.select(*docs.columns).collect())) == sorted(map(tuple, plain.collect()))
        assert all(r[n] == f"own {n}" for r in extra.collect() for n in ("score", "lang_pred", "findings", "redacted", "row", "__v"))
