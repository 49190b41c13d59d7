"""Quality classifier by weak labels.

Heuristic labellers vote good (1), bad (0) or abstain on each whole text. Expectation-maximisation over the counts of vote patterns
estimates each labeller's accuracy; patterns are bounded by 3 to the number of labellers, so the counts of all documents fit a small
table. The posteriors then label a bounded sample on which a hashed linear scorer is fitted, and the scorer judges every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

DIM = 1 << 14
#: Bound of the sample that the scorer is fitted on, chosen by hash.
SAMPLE = 4000
KEEP = 0.5
# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it was on are as with be by at from or an this which not but have has had they you we he she his her their its were been than will would can could when what who if no so up out about into over after "
    "der die das und zu den von mit ist im für auf dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein "
    "le la les et des en un une du que est pour dans qui par sur pas plus ne se ce il au avec sont son ou nous vous elle ils leur être cette mais comme tout sans aux fait ses "
    "el los las y de que en por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante".split()
)
SYMBOLS = frozenset("#$%&*|!^~<>{}[]\\@=+_")
LABELLERS = ("symbols", "capitals", "repeated_words", "table_marks", "length", "function_words", "repeated_lines")
N = len(LABELLERS)


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, ...]:
    """Letters, capitals and symbols among the first 65,536 characters."""
    every = [chr(i) for i in range(1 << 16)]
    return tuple(np.array(x, bool) for x in ([c.isalpha() for c in every], [c.isupper() for c in every], [c in SYMBOLS for c in every]))


def statistics(text: str | None) -> tuple[list[str], dict[str, float]]:
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    letter, capital, symbol = _classes()
    letters, upper, symbols = (int(np.count_nonzero(c[codes])) for c in (letter, capital, symbol))
    low = [w.strip(".,;:!?\"'()").lower() for w in words]
    n = max(1, len(words))
    return low, {
        "symbols": symbols / max(1, len(text)),
        "capitals": upper / max(1, letters),
        "repeated_words": len(set(low)) / n,
        "table_marks": sum(w == "|" for w in words) / n,
        "words": len(words),
        "function_words": sum(w in FUNCTION_WORDS for w in low) / n,
        "repeated_lines": len(set(lines)) / max(1, len(lines)),
        "marked": sum(w[-1] in SYMBOLS for w in words) / n,
    }


def votes(s: dict[str, float]) -> list[int]:
    """1 good, 0 bad, -1 abstain, in the order of LABELLERS."""
    few = s["words"] < 8
    pick = lambda bad, good: 0 if bad else 1 if good else -1
    return [
        pick(s["symbols"] > 0.04, s["symbols"] < 0.015),
        pick(s["capitals"] > 0.4, s["capitals"] < 0.15),
        -1 if few else pick(s["repeated_words"] < 0.3 and s["words"] < 2000, s["repeated_words"] > 0.5),
        pick(s["table_marks"] > 0.08, s["table_marks"] < 0.01 and s["marked"] < 0.05),
        pick(s["words"] == 0, s["words"] >= 20),
        -1 if few else pick(s["function_words"] < 0.04, s["function_words"] > 0.15),
        pick(s["repeated_lines"] < 0.5, s["repeated_lines"] > 0.8 and s["words"] >= 20),
    ]


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each pattern, accuracies: labeller x class x {bad, good, abstain}) by expectation-maximisation from majority votes."""
    good, bad = (patterns == 1).sum(1), (patterns == 0).sum(1)
    p = np.clip((good - 2.0 * bad + 1) / np.maximum(1, good + bad) / 2 + 0.5, 0.02, 0.98)
    seen = np.stack([patterns == 0, patterns == 1, patterns == -1], axis=2).astype(float)
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        tables = np.einsum("cp,pln->lcn", weight, seen) + 0.5
        tables /= tables.sum(2, keepdims=True)
        logs = np.log(prior)[:, None] + np.einsum("pln,lcn->cp", seen, np.log(tables))
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return p, tables


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[ids].sum() / np.sqrt(max(1, len(ids))), -50, 50))))


_hashed: dict[str, int] = {}


def hashed(words: list[str], s: dict[str, float]) -> np.ndarray:
    """Ids of the features present: words of the whole text and deciles of the statistics, hashed."""
    if len(_hashed) > 300_000:
        _hashed.clear()
    out = set()
    for w in set(words):
        i = _hashed.get(w)
        if i is None:
            shape = "".join("s" if c in SYMBOLS else "" for c in w[-3:])
            i = _hashed[w] = zlib.crc32((shape or w).encode("utf-8", "surrogatepass")) % DIM
        out.add(i)
    out |= {zlib.crc32(f"{k}:{min(10, int(v * 10)) if k != 'words' else int(v).bit_length()}".encode()) % DIM for k, v in s.items()}
    return np.array(sorted(out), np.int64)


def fit(rows: list[tuple[np.ndarray, float]], rounds: int = 30, ridge: float = 1e-3) -> Scorer:
    """Logistic regression on posterior labels by Adagrad, in a fixed order."""
    w, b, gw, gb = np.zeros(DIM), 0.0, np.full(DIM, 1e-6), 1e-6
    for _ in range(rounds):
        for ids, y in rows:
            scale = 1 / np.sqrt(max(1, len(ids)))
            g = 1 / (1 + np.exp(-np.clip(b + w[ids].sum() * scale, -50, 50))) - y
            step = g * scale + ridge * w[ids]
            gw[ids] += step * step
            w[ids] -= 0.3 * step / np.sqrt(gw[ids])
            gb += g * g
            b -= 0.3 * g / np.sqrt(gb)
    return Scorer(w, float(b))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """One row a document: doc_id, votes (array), posterior, score (of the fitted scorer), kept (score >= keep).

    Null is read as the empty text, which no labeller calls good, and gets score 0. Repeated rows are judged alike. Pattern counts
    cover all documents. An empty table gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [statistics(t) for t in part.column(1).to_pylist()]
            ids = [hashed(*f).astype(np.int32) if f[0] else None for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([votes(s) for _, s in found], pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "h", "votes", "ids"])

    # one pass over the texts: votes and hashed features; no features where there are no words
    labelled = rows.withColumn("h", F.xxhash64("doc_id", "text")).mapInArrow(label, f"doc_id {kind}, h long, votes array<int>, ids array<int>")
    labelled = written(labelled)
    table = labelled.groupBy("votes").agg(F.count("*").alias("n")).collect()
    if not table:
        return labelled.select("doc_id", "votes", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    table.sort(key=lambda r: r["votes"])
    counts = np.array([r["n"] for r in table], float)
    p, _ = posteriors(np.array([r["votes"] for r in table]), counts)
    by_votes = {tuple(r["votes"]): float(x) for r, x in zip(table, p, strict=True)}
    share = min(1.0, SAMPLE / counts.sum())
    picked = labelled.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < share).where("ids is not null").select("h", "ids", "votes")
    sample = sorted(picked.collect(), key=lambda r: (r["h"], r["ids"]))
    shared = spark.sparkContext.broadcast((by_votes, fit([(np.array(r["ids"], np.int64), by_votes[tuple(r["votes"])]) for r in sample])))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scorer = shared.value
        for part in slices(batches):
            score = [0.0 if ids is None else scorer.score(np.array(ids, np.int64)) for ids in part.column(2).to_pylist()]
            posterior = [known[tuple(v)] for v in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(posterior), pa.array(score), pa.array([x >= keep for x in score])], ["doc_id", "votes", "posterior", "score", "kept"])

    return labelled.select("doc_id", "votes", "ids").mapInArrow(judge, f"doc_id {kind}, votes array<int>, posterior double, score double, kept boolean")
