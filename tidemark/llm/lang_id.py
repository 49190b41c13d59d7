"""Language identification with string kernels.

Kernel: blended-spectrum presence, the number of n-grams (n = 1 to N characters) that two texts share, over the root of the product
of their own numbers. Nyström: K(x, landmarks) K(landmarks, landmarks)^-1/2 maps a text to features, on which kernel ridge
regression is solved one language against the rest. The score of a text is linear in its presence vector once its norm is divided
out, so texts are scored by products of presence matrices with one small weight matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: N-grams are hashed to so many presence bits.
DIM = 1 << 15
MAX_N = 3
#: Bound of the sample that the classifier is fitted on: about so many documents a language, chosen by a hash of their rows.
TRAIN_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 60
RIDGE = 1e-2
#: Presence bits of the sample that the fit unpacks at once.
STRETCH = 1 << 21
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
#: Characters taken at once from a text, up to the next white space: bounds the work space of very long texts.
SPAN = 1 << 18
_BLANK = re.compile("[ \\t\\n\\r]")


def presence(text: str | None) -> np.ndarray:
    """Sorted ids of the n-grams of the whole text, lower-cased, runs of what are no letters read as one space.

    A long text comes in spans that end with white space, so lower case doesn't depend on them, and what n-grams and runs at a border need
    is carried over: the result is that of the whole text.
    """
    ids = np.zeros(DIM, bool)
    text, start, tail, open_run = text or "", 0, np.zeros(0, np.uint32), False
    while start < len(text):
        end = _BLANK.search(text, start + SPAN) if len(text) - start > SPAN else None
        piece = text[start : end.end() if end else len(text)]
        start += len(piece)
        codes = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        plain = (codes < 128) & ~((codes >= 97) & (codes <= 122))
        codes = np.where(plain, np.uint32(32), codes)
        kept = codes[~(plain & np.r_[open_run, plain[:-1]])]
        open_run = bool(plain[-1])
        codes = np.concatenate([tail, kept])
        tail = codes[-(MAX_N - 1) :]
        mixed = np.zeros(len(codes), np.uint32)
        for n in range(MAX_N):
            if len(codes) <= n:
                break
            mixed = (mixed[: len(codes) - n] + codes[n:]) * _MULTIPLIERS[n % 3]
            mixed ^= mixed >> np.uint32(15)
            ids[(mixed + np.uint32(n * 7919)) % np.uint32(DIM)] = True
    return np.flatnonzero(ids)


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # presence ids x languages

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = [presence(t) for t in texts]
        dense = np.zeros((len(texts), DIM), np.float32)
        for row, ids in zip(dense, found, strict=True):
            row[ids] = 1 / np.sqrt(max(1, len(ids)))
        return dense @ self.weights


def _stretches(bits: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Packed presence rows, unpacked by stretches of ids: bounds the driver's work space, which whole rows of numbers would exceed."""
    step = max(1, STRETCH // (8 * len(bits)))
    for start in range(0, bits.shape[1], step):
        yield slice(8 * start, 8 * (start + step)), np.unpackbits(bits[:, start : start + step], axis=1).astype(np.float32)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """Fits on a bounded sample of the labelled rows with letters; None where there are no such rows.

    Counts of each language cover all rows. A row is in the sample by a hash of its id and text against the share that gives
    about TRAIN_PER_LANGUAGE rows; presence ids are made on the executors, so that texts never reach the driver.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(label_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & has_letter())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * TRAIN_PER_LANGUAGE / n))])
    unit = F.shiftrightunsigned("h", 11) / float(1 << 53)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            bits = [np.packbits(np.isin(np.arange(DIM), presence(t), assume_unique=True)).tobytes() for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(bits, pa.binary())], ["lang", "h", "bits"])

    sample = rows.where(unit < share[F.col("lang")]).mapInArrow(run, "lang string, h long, bits binary").collect()
    sample.sort(key=lambda r: (r["lang"], r["h"], bytes(r["bits"])))
    languages, taken, chosen = sorted({r["lang"] for r in sample}), {}, []
    for r in sample:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= TRAIN_PER_LANGUAGE:
            chosen.append(r)
    if not chosen:
        return None
    bits = np.frombuffer(b"".join(r["bits"] for r in chosen), np.uint8).reshape(len(chosen), -1)
    y = np.array([[1.0 if r["lang"] == x else -1.0 for x in languages] for r in chosen])
    rank, seen = [], {}
    for i, r in enumerate(chosen):
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= LANDMARKS_PER_LANGUAGE:
            rank.append(i)
    norms = np.sqrt(np.maximum(1, np.bitwise_count(bits).sum(axis=1, dtype=np.int64)))
    kernel = np.zeros((len(chosen), len(rank)))
    for _, part in _stretches(bits):
        kernel += part @ part[rank].T  # numbers of shared n-grams, which are exact
    kernel /= norms[:, None] * norms[rank]
    values, vectors = np.linalg.eigh(kernel[rank])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    balance = 1.0 / np.array([seen[r["lang"]] for r in chosen])
    balance /= balance.mean()
    weighted = features * balance[:, None]
    solved = np.linalg.solve(features.T @ weighted + RIDGE * len(chosen) * np.eye(features.shape[1]) / features.shape[1], weighted.T @ y)
    pull, weights = root @ solved / norms[rank][:, None], np.zeros((DIM, len(languages)), np.float32)
    for ids, part in _stretches(bits[rank]):
        weights[ids] = part.T @ pull
    return Model(languages, weights)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default: the id) plus lang_pred and score in [0, 1].

    Columns to keep that are named lang_pred or score give way to these. The score is the winner's share after a softmax of the regression outputs. Null texts and texts without a letter get `und` and 0,
    as all do where there is no model. Whole texts are read; only the text is looked at. Ties go to the first language by name. Repeated
    rows have the same result each, an empty table has none.
    """
    keep = [c for c in keep or [id_col] if c not in ("lang_pred", "score")]
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string", "score double"])
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shipped.value
        for part in slices(batches):
            texts = part.column(part.num_columns - 1).to_pylist()
            known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
            names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if fitted is not None and known.any():
                raw = fitted.scores([t for t, k in zip(texts, known, strict=True) if k]).astype(np.float64)
                raw = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
                names[known] = np.array(fitted.languages, object)[raw.argmax(axis=1)]
                score[known] = raw.max(axis=1) / raw.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(score)], [*part.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
