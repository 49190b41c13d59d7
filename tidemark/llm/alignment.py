"""Alignment of two tokenizers over the same bytes.

Each batch of documents becomes two token tables with byte offsets, and pandas' merge_asof, keyed by document, finds for each token start
the token of the other side that covers it. The union of both directions holds every overlap; overlaps with equal ends cut a document
into groups. Links are the pairs of tokens in a group. How many documents link a pair of ids is counted by Spark over all documents;
frequent pairs, of which there is a bounded table, are looked up in place, and the rest meet their counts in a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing
from .common import written

#: Characters in a batch, and in a piece of a longer text; texts are cut where white space follows another character, where both
#: tokenizers end a token.
BATCH, PIECE = 400_000, 400_000
#: Chunks whose ids a worker keeps (some 250 bytes each); beyond, it starts anew.
CACHED = 500_000
#: Pairs of ids in the table that every task gets, at most (17 bytes each).
HOT = 400_000
#: Links of a group that are made pair by pair; a larger group's are products of the counts of its ids.
GROUP = 10_000
SHIFT = 40  # bits of a pair of ids, behind the number of a text in its batch


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteSide:
    """The byte-level tokenizer; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.path, self.plain = path, Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        alphabet, vocabulary = byte_alphabet(), self.plain.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()

    def whole(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of each chunk, little-endian 32-bit numbers."""
        odd = {c for c in chunks if any(s in c for s in self.special)}
        found = dict(packing._encode_chunks([c for c in chunks if c not in odd], self.path))
        return found | {c: self.whole(c) for c in odd}


class PieceSide:
    """The tokenizer of pieces, which itself adds the space before a text; texts come with that space.

    inner: characters that a piece can have behind others, the mark of a space apart where it opens the piece.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.opens = np.array([p.startswith("▁") for p in names])
        self.space = self.model.piece_to_id("▁")
        self.inner = {c for p in names for c in (p.lstrip("▁") if p[0] == "▁" else p[1:])}
        probe = "\ufb01 \uff21  x\u0301\t\u3000"  # what a normaliser would change
        self.plain = b"".join(self.bytes[i] for i in self.model.encode(probe)).decode() == " " + probe

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, "<u4") for x in self.model.encode(texts, num_threads=1)]

    def whole(self, text: str) -> bytes:
        return self._raw([text[1:]])[0].tobytes()

    def chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of each chunk. Those of one space and a word are encoded end to end and told apart by the pieces that open with a space."""
        out, joined, rest = {}, [], []
        for c in chunks:
            (joined if c[0] == " " and len(c) > 1 and c[1] not in packing._BLANK and "▁" not in c else rest).append(c)
        for start in range(0, len(joined), 512):
            part = joined[start : start + 512]
            ids = self._raw(["".join(part)[1:]])[0]
            first = np.flatnonzero(self.opens[ids]).tolist()
            if len(first) != len(part):
                rest += part
                continue
            blob, stops = ids.tobytes(), [*(4 * i for i in first), 4 * len(ids)]
            out.update((c, blob[x:y]) for c, x, y in zip(part, stops, stops[1:]))
        # a chunk that opens with a space has the one that the model adds; of the others that one is taken away again
        for c, ids in zip(rest, self._raw([c[1:] if c[0] == " " else c for c in rest]), strict=True):
            if c == " ":
                ids = np.array([self.space], "<u4")
            out[c] = (ids if c[0] == " " else ids[1:]).tobytes()
        return out


class Pair:
    """Both tokenizers with the tables of their entries.

    Texts fall into chunks at white space that follows another character and that no piece has behind others. There both tokenizers end a
    token whatever stands around, so the ids of a chunk depend on it alone and each is encoded once a worker. Tokenizers that are not of
    this kind encode whole texts (apart is false).
    """

    def __init__(self, bytes_path: str, pieces_path: str) -> None:
        self.a, self.b = ByteSide(bytes_path), PieceSide(pieces_path)
        self.size_a, self.size_b = (np.array([len(x) for x in s.bytes], np.int64) for s in (self.a, self.b))
        self.flat_a, self.flat_b = _spelling(self.a.bytes), _spelling(self.b.bytes)
        self.apart = self.b.plain and "▁" not in self.b.inner
        space, cuts = packing._SPACE, "".join(re.escape(c) for c in sorted(packing._BLANK - self.b.inner))
        odd = "".join(re.escape(c) for c in sorted(packing._BLANK & self.b.inner)) or "^\\s\\S"
        self.chunk = re.compile(f"[{space}]*+[^{space}]++(?:[{odd}][{space}]*+[^{space}]*+)*+|[{space}]++")
        self.cut = re.compile(f"(?<=[^{space}])(?=[{cuts}])")
        self.known: dict[str, tuple[bytes, bytes]] = {}
        most = max(len(self.a.bytes), len(self.b.bytes))
        width = len(str(most))
        # decimal digits of each id, filled up with zero bytes, and room for the mark behind it
        self.digits = np.zeros((most, width + 1), np.uint8)
        for i in range(most):
            self.digits[i, : len(str(i))] = np.frombuffer(str(i).encode(), np.uint8)
        self.n_digits = (self.digits != 0).sum(axis=1)

    def _ids(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        if not self.apart:
            yield from ((self.a.whole(t), self.b.whole(t)) for t in texts)
            return
        if len(self.known) > CACHED:
            self.known.clear()
        chunks = [self.chunk.findall(t) for t in texts]
        found = [list(map(self.known.get, row)) for row in chunks]
        fresh = list({c for row, x in zip(chunks, found, strict=True) if None in x for c, ids in zip(row, x, strict=True) if ids is None})
        a, b = self.a.chunks(fresh), self.b.chunks(fresh)
        fresh = {c: (a[c], b[c]) for c in fresh}
        self.known.update((c, ids) for c, ids in fresh.items() if len(c) <= packing.LONGEST)
        for row, x in zip(chunks, found, strict=True):
            x = [fresh[c] if ids is None else ids for c, ids in zip(row, x, strict=True)] if None in x else x
            yield b"".join([ids[0] for ids in x]), b"".join([ids[1] for ids in x])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
        """Ids of both sides, and whether both sides' bytes are the text's."""
        ids = list(self._ids(texts))
        a, b = ([np.frombuffer(x[side], "<u4") for x in ids] for side in (0, 1))
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = [(int(self.size_a[x].sum()), int(self.size_b[y].sum())) for x, y in zip(a, b, strict=True)]
        fine = [s == (len(d), len(d)) for s, d in zip(sizes, data, strict=True)]
        for table, own in ((self.flat_a, a), (self.flat_b, b)):
            held = [i for i, ok in enumerate(fine) if ok]
            if held and table(np.concatenate([own[i] for i in held])) != b"".join([data[i] for i in held]):
                for i in held:
                    fine[i] = table(own[i]) == data[i]
        return a, b, fine


def _spelling(entries: list[bytes]):
    """A function that gives the bytes of ids."""
    flat, sizes = np.frombuffer(b"".join(entries), np.uint8), np.array([len(x) for x in entries], np.int64)
    starts = np.cumsum(sizes) - sizes

    def spell(ids: np.ndarray) -> bytes:
        n = sizes[ids]
        return flat[np.repeat(starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()

    return spell


@lru_cache(maxsize=2)
def _pair(bytes_path: str, pieces_path: str) -> Pair:
    return Pair(bytes_path, pieces_path)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of both sides for every pair with a common byte, each once or twice. a and b: doc, at (first byte), and the
    number, named a or b. Of two tokens that overlap, the one that starts later starts inside the other."""
    forth, back = pd.merge_asof(a, b, on="at", by="doc"), pd.merge_asof(b, a, on="at", by="doc")
    return np.concatenate([forth["a"], back["a"]]), np.concatenate([forth["b"], back["b"]])


def align_texts(texts: list[str], pair: Pair) -> list[dict]:
    """Of each text (with its space): n_a, n_b, n_groups, n_links, groups (bytes), keys and times of its pairs of ids; None for a text that the tokenizers change."""
    a, b, fine = pair.encode(texts)
    out: list[dict | None] = [None] * len(texts)
    held = [i for i, ok in enumerate(fine) if ok and len(a[i])]
    if not held:
        return out
    a, b = [a[i] for i in held], [b[i] for i in held]
    n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    ids_a, ids_b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
    docs = np.arange(len(held))
    doc_a, doc_b = np.repeat(docs, n_a), np.repeat(docs, n_b)
    end_a, end_b = np.cumsum(pair.size_a[ids_a]), np.cumsum(pair.size_b[ids_b])
    left = pd.DataFrame({"doc": doc_a, "at": end_a - pair.size_a[ids_a], "a": np.arange(len(ids_a))}, copy=False)
    right = pd.DataFrame({"doc": doc_b, "at": end_b - pair.size_b[ids_b], "b": np.arange(len(ids_b))}, copy=False)
    over_a, over_b = overlaps(left, right)
    common = end_a[over_a] == end_b[over_b]
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[over_a[common]], last_b[over_b[common]] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    of_a, of_b = np.bincount(group_a), np.bincount(group_b)
    first_b = np.cumsum(of_b) - of_b
    doc_of = doc_a[last_a]
    n_groups = np.bincount(doc_of, minlength=len(held))
    starts = np.cumsum(n_groups) - n_groups
    n_links = np.add.reduceat(of_a * of_b, starts)

    # pairs of ids: token by token in small groups, by counts of ids in large ones
    small = of_a * of_b <= GROUP
    take = np.flatnonzero(small[group_a])
    repeat = of_b[group_a[take]]
    i = np.repeat(take, repeat)
    j = np.arange(len(i)) - np.repeat(np.cumsum(repeat) - repeat, repeat) + first_b[group_a[i]]
    keys, times = np.unique((doc_a[i] << SHIFT) | (ids_a[i] * len(pair.b.bytes) + ids_b[j]), return_counts=True)
    for g in np.flatnonzero(~small):
        x, nx = np.unique(ids_a[group_a == g], return_counts=True)
        y, ny = np.unique(ids_b[group_b == g], return_counts=True)
        more = ((doc_of[g] << SHIFT) | (x[:, None] * len(pair.b.bytes) + y[None, :])).ravel()
        keys, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
        times = np.bincount(at, np.concatenate([times, np.outer(nx, ny).ravel()])).astype(np.int64)
    bounds = np.searchsorted(keys, np.arange(len(held) + 1) << SHIFT)

    # a group is its a ids, a bar, its b ids; in the row of all tokens those of a come before those of b in each group
    before_a, before_b = np.cumsum(of_b) - of_b, np.cumsum(of_a)
    place_a, place_b = np.arange(len(ids_a)) + before_a[group_a], np.arange(len(ids_b)) + before_b[group_b]
    row, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.uint8)
    row[place_a], row[place_b] = ids_a, ids_b
    mark[place_a], mark[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    ends = np.cumsum(n_a + n_b)
    mark[ends - 1] = 0
    cells = pair.digits[row]
    cells[:, -1] = mark
    text = cells[cells != 0].tobytes()
    sizes = np.concatenate([[0], np.cumsum(pair.n_digits[row] + (mark != 0))])[np.concatenate([[0], ends])].tolist()
    mask = (1 << SHIFT) - 1
    for n, to in enumerate(held):
        at = slice(bounds[n], bounds[n + 1])
        out[to] = {"n_a": int(n_a[n]), "n_b": int(n_b[n]), "n_groups": int(n_groups[n]), "n_links": int(n_links[n]), "groups": text[sizes[n] : sizes[n + 1]], "keys": keys[at] & mask, "times": times[at]}
    return out


def _joined(parts: list[dict | None]) -> dict | None:
    """The result of a text from those of its pieces."""
    if any(p is None for p in parts):
        return None
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([p["keys"] for p in parts]), return_inverse=True)
    times = np.bincount(at, np.concatenate([p["times"] for p in parts])).astype(np.int64)
    return {n: sum(p[n] for p in parts) for n in ("n_a", "n_b", "n_groups", "n_links")} | {"groups": b";".join(p["groups"] for p in parts), "keys": keys, "times": times}


def _pieces(text: str, most: int, cuts: re.Pattern) -> list[str]:
    """The text in pieces that begin with white space, of about `most` characters."""
    out, start = [], 0
    while len(text) - start > most:
        cut = cuts.search(text, start + most)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


SCHEMA = pa.schema([("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, pieces: str | None = None) -> DataFrame:
    """One row a document: doc_id, row (a number of its own), n_a, n_b, n_groups, n_links, groups, pairs and times.

    groups is `a1,a2|b1;a3|b2,b3`, the ids of both sides by group; pairs holds each linked pair of ids once, as a * (entries of b) + b,
    and times how often it is linked. Null and empty texts, and those that a tokenizer changes, have zeros, an empty string and empty
    arrays. Whole texts are read, long ones piece by piece. Ids may be null or repeated: each row is a document.
    """
    a_path, b_path = tokenizer or packing.default_tokenizer(), pieces or default_pieces()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pair, number = _pair(a_path, b_path), TaskContext.get().partitionId() << 33
        nothing = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": b"", "keys": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                first, parts, n = at, [], 0
                while at < batch.num_rows and n < BATCH and at - first < 512:
                    text = texts[at].as_py()
                    parts.append(_pieces(" " + text, PIECE if pair.apart else len(text) + 1, pair.cut) if text else [])
                    n += len(text or "")
                    at += 1
                found, group, room = [], [], 0
                for piece in (p for x in parts for p in x):
                    if group and room + len(piece) > 2 * BATCH:
                        found += align_texts(group, pair)
                        group, room = [], 0
                    group.append(piece)
                    room += len(piece)
                found = iter(found + align_texts(group, pair))
                results = [_joined([next(found) for _ in x]) if x else None for x in parts]
                results = [r or nothing for r in results]
                offsets = pa.array(np.cumsum([0, *(len(r["keys"]) for r in results)]), pa.int32())
                columns = [pa.array(range(number, number + len(results)), pa.int64()), *(pa.array([r[n] for r in results], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links"))]
                columns += [pa.array([r["groups"].decode() for r in results], pa.string())]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[n] for r in results]), pa.int64())) for n in ("keys", "times")]
                number += len(results)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), *columns], ["doc_id", *SCHEMA.names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame, n_pieces: int) -> DataFrame:
    """(pair, n, best): how many documents link the pair, and whether that is the highest count of its a id."""
    counts = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a = F.floor(F.col("pair") / n_pieces)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))  # a row an entry of the vocabulary at most
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def score(aligned: DataFrame, n_pieces: int, hot: int = HOT) -> DataFrame:
    """Adds n_best and count_sum to written rows of align() (and drops its arrays).

    Pairs that many documents link are looked up in a table of at most `hot` pairs, which each task gets; the others are few rows each
    and meet their counts in a join, so no key of it is hot. The choice changes the plan, never a result.
    """
    counts = written(pair_counts(aligned, n_pieces))
    sizes = {r["p"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).collect()}  # at most 64 rows
    least = 64
    while least > 0 and sum(c for p, c in sizes.items() if p >= least - 1) <= hot:
        least -= 1
    table = counts.where(F.col("n") >= F.lit(1 << min(least, 62))).orderBy("pair").toArrow()
    known = aligned.sparkSession.sparkContext.broadcast(tuple(table.column(n).to_numpy() for n in ("pair", "n", "best")))
    plain = [c for c in aligned.columns if c not in ("pairs", "times")]
    rows = aligned.select(*plain, "pairs", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            ours, offsets = batch.column(len(plain)), batch.column(len(plain)).offsets.to_numpy()
            keys = ours.values.to_numpy()[offsets[0] : offsets[-1]]
            times = batch.column(len(plain) + 1).values.to_numpy()
            shift = batch.column(len(plain) + 1).offsets.to_numpy()[0]
            times, offsets = times[shift : shift + len(keys)], offsets - offsets[0]
            at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
            here = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
            amount, top = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            amount[here], top[here] = n[at[here]] * times[here], best[at[here]] * times[here]
            total = lambda x, o=offsets: np.diff(np.concatenate([[0], np.cumsum(x)])[o])
            left = pa.array(np.concatenate([[0], np.cumsum(~here)])[offsets], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(plain)], pa.array(total(top), pa.int64()), pa.array(total(amount), pa.int64()), pa.ListArray.from_arrays(left, pa.array(keys[~here], pa.int64())), pa.ListArray.from_arrays(left, pa.array(times[~here], pa.int64()))],
                [*plain, "n_best", "count_sum", "pairs", "times"],
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*plain).schema.fields), "n_best long, count_sum long, pairs array<long>, times array<long>"])
    found = rows.mapInArrow(run, schema)
    if least == 0:
        return found.drop("pairs", "times")
    found = written(found)
    rare = counts.where(F.col("n") < F.lit(1 << min(least, 62)))
    links = found.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    sums = links.join(rare, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("n") * F.col("times")).alias("__sum"))
    rows = found.join(sums, "row", "left")
    more = lambda name, part: (F.col(name) + F.coalesce(part, F.lit(0).cast("long"))).alias(name)
    return rows.select(*plain, more("n_best", F.col("__best")), more("count_sum", F.col("__sum")))


def n_pieces(pieces: str | None = None) -> int:
    """Entries of the vocabulary of pieces, the base of a pair."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces or default_pieces()).get_piece_size()
