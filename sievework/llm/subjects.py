"""Subject areas of documents (problem 9): classifier chains decoded by beam search.

Features of the whole text: words and word pairs, counted by the sentences that
hold them, so a word said once weighs less than a theme; the source;
and structure (length, sentences, script, share of capitals). One logistic
model a subject follows in a chain, each seeing the decisions before it, so
subjects that occur together support each other. Decisions are calibrated
(Platt) on held-out labelled documents and the best combination is decoded with
a beam.

The chain is fitted on a bounded sample of the labelled documents (``LABELLED``
rows, the smallest by a hash of the id), in one task; everything else covers
all documents. Labels are known to be incomplete and sometimes wrong: after a
first fit, labels that the model contradicts strongly are left out of the second.

Cases. Null or empty texts have no subject. Labels of unknown documents or
subjects are ignored. Without labels no document gets a subject. Repeated rows of
one id are one document. Texts of any length are read whole.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.tokens import source_key
from sievework.session import small

LABELLED = 4000
BEAM = 8
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_ARABIC = re.compile("[؀-ۿ]")
_SENTENCE = re.compile(r"[.!?۔؟\n]+|;\s")


def features(text: str, source: str | None, lang: str | None) -> dict[str, float]:
    """Named features of a text and their values."""
    flat = re.sub(r"[-­]\s*\n\s*", "", text)
    capitals = sum(c.isupper() for c in flat) / max(1, len(flat))
    held: Counter[str] = Counter()
    named: Counter[str] = Counter()
    sentences = 0
    for sentence in _SENTENCE.split(flat):
        words = _WORD.findall(sentence)
        if not words:
            continue
        sentences += 1
        low = [w.lower() for w in words]
        # In ordinary text a capital inside a sentence marks a name, which says nothing of the subject.
        keep = low if capitals > 0.3 else [w for i, (w, raw) in enumerate(zip(low, words)) if i == 0 or not raw[0].isupper()]
        seen = {f"w:{w}" for w in keep if len(w) > 2}
        seen.update(f"b:{a} {b}" for a, b in zip(keep, keep[1:]))
        held.update(seen)
    out = {k: 1.0 + math.log(n) for k, n in held.items()}
    norm = math.sqrt(sum(v * v for v in out.values())) or 1.0
    # Between the raw counts and full length normalization: long texts may treat several subjects.
    scale = 4.0 / norm**0.8
    out = {k: v * scale for k, v in out.items()}
    out["s:length"] = math.log1p(len(flat)) / 10
    out["s:sentences"] = math.log1p(sentences) / 5
    out["s:capitals"] = capitals
    out["s:arabic"] = float(_ARABIC.search(flat) is not None)
    out[f"source:{source or '-'}"] = 0.5
    out[f"lang:{(lang or '-').strip().lower()[:2]}"] = 0.5
    return out


class Sparse:
    """Rows of (column, value) in compressed form: products with a dense matrix cost what is filled, not rows x columns."""

    def __init__(self, rows: list[dict[str, float]], index: dict[str, int]) -> None:
        found = [sorted((index[k], v) for k, v in row.items() if k in index) for row in rows]
        self.shape = (len(rows), len(index))
        self.at = np.fromiter((j for row in found for j, _ in row), dtype=np.int64)
        self.value = np.fromiter((v for row in found for _, v in row), dtype=np.float32)
        self.start = np.cumsum([0, *map(len, found)])
        self._back()

    def _back(self) -> None:
        order = np.argsort(self.at, kind="stable")
        self.row = np.repeat(np.arange(self.shape[0]), np.diff(self.start))
        self.by_column, self.column_start = order, np.searchsorted(self.at[order], np.arange(self.shape[1] + 1))

    def take(self, keep: np.ndarray) -> Sparse:
        """The rows where ``keep`` is true."""
        new = object.__new__(Sparse)
        filled = keep[self.row]
        new.at, new.value = self.at[filled], self.value[filled]
        new.shape = (int(keep.sum()), self.shape[1])
        new.start = np.concatenate([[0], np.cumsum(np.diff(self.start)[keep])])
        new._back()
        return new

    @staticmethod
    def _sums(cells: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Sums of runs of rows; an empty run is 0."""
        total = np.zeros((len(start) - 1, cells.shape[1]), dtype=np.float32)
        full = np.flatnonzero(np.diff(start) > 0)
        if len(full):
            total[full] = np.add.reduceat(cells, start[:-1][full], axis=0)
        return total

    def times(self, w: np.ndarray) -> np.ndarray:
        """rows x w."""
        return self._sums(w[self.at] * self.value[:, None], self.start)

    def back_times(self, d: np.ndarray) -> np.ndarray:
        """columns x d: the transpose times d."""
        order = self.by_column
        return self._sums(d[self.row[order]] * self.value[order][:, None], self.column_start)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


Fit = tuple[np.ndarray, np.ndarray]


def _logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, chained: bool = False, start: Fit | None = None, decay: float = 2e-4, steps: int = 80) -> Fit:
    """(weights of features, weights of labels and intercepts): weighted logistic regressions for all columns of y at once, by Adam with L2 decay.

    In a chain a column also sees the labels before it. ``start`` is a fit to go on from.
    """
    k = y.shape[1]
    order = np.triu(np.ones((k, k), dtype=np.float32), 1) if chained else np.zeros((k, k), dtype=np.float32)
    dense = np.hstack([0.5 * y, np.ones((len(y), 1), dtype=np.float32)]).astype(np.float32)
    use = np.vstack([order, np.ones((1, k), dtype=np.float32)])
    w, v = (m.copy() for m in start) if start else (np.zeros((x.shape[1], k), dtype=np.float32), np.zeros((k + 1, k), dtype=np.float32))
    moments = [np.zeros_like(m) for m in (w, w, v, v)]
    total = np.maximum(weight.sum(axis=0), 1.0)
    fade = np.ones_like(v)
    fade[-1] = 0.0
    for t in range(1, steps + 1):
        error = ((_sigmoid(x.times(w) + dense @ v) - y) * weight / total).astype(np.float32)
        for at, (p, g) in enumerate(((w, x.back_times(error) + decay * w), (v, (dense.T @ error + decay * v * fade) * use))):
            first, second = moments[2 * at], moments[2 * at + 1]
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            p -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-6)
    return w, v


def _out_of_fold(x: Sparse, y: np.ndarray, weight: np.ndarray, starts: list[Fit | None], chained: bool = False) -> tuple[np.ndarray, list[Fit]]:
    """Scores of each row by models that did not see it, and those models; one fold for each start."""
    z, fits = np.zeros(y.shape, dtype=np.float32), []
    fold = np.arange(len(y)) % len(starts)
    for f, start in enumerate(starts):
        test = fold == f
        w, v = _logistic(x.take(~test), y[~test], weight[~test], chained, start, steps=30 if start else 80)
        z[test] = x.take(test).times(w) + 0.5 * y[test] @ v[:-1] + v[-1]
        fits.append((w, v))
    return z, fits


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of the best logistic fit a z + b to labels y, by Newton steps; a faint pull to (1, 0) holds it where all labels are alike."""
    x, at = np.column_stack([z, np.ones(len(z))]).astype(float), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(x @ at)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (p - y) + 0.1 * (at - [1.0, 0.0]))
        at = at - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(at[0]), float(at[1])


def fit_chain(rows: list[dict[str, float]], labels: np.ndarray, subjects: list[str], folds: int = 3) -> dict:
    """The chain: features (all that two labelled documents have), order, weights and calibration of each subject."""
    spread = Counter(k for row in rows for k in row)
    index = {k: i for i, k in enumerate(sorted(k for k, n in spread.items() if n >= 2))}
    order = sorted(range(len(subjects)), key=lambda j: (-labels[:, j].sum(), j))
    y, x = labels[:, order], Sparse(rows, index)
    # First fit without chain, out of fold, to find labels that cannot be right or are missing.
    first, fits = _out_of_fold(x, y, np.ones_like(y), [None] * folds)
    doubt = _sigmoid(first)
    trust = np.ones_like(doubt)
    trust[(y == 0) & (doubt > 0.55)] = 0.0
    trust[(y == 1) & (doubt < 0.06)] = 0.1
    z, fits = _out_of_fold(x, y, trust, fits, True)
    w, v = _logistic(x, y, trust, True, tuple(np.mean(m, axis=0) for m in zip(*fits)), steps=40)
    links, bias = v[:-1], v[-1]
    # Every label given counts here, also those left out of the fit: a low score is most often a word that the fit had not seen.
    a, b = np.array([platt(z[ok, at], y[ok, at]) for at, ok in enumerate(((y == 1) | (trust > 0.5)).T)]).reshape(-1, 2).T
    used = np.flatnonzero(np.abs(w).max(axis=1) > 0) if len(w) else np.zeros(0, dtype=int)
    names = sorted(index, key=index.get)
    return {
        "index": {names[i]: n for n, i in enumerate(used)}, "subjects": [subjects[j] for j in order], "w": w[used], "links": links, "bias": bias, "a": np.maximum(a, 0.2), "b": b,
    }


def decode_many(model: dict, rows: list[dict[str, float]], beam: int = BEAM) -> list[list[tuple[str, float]]]:
    """For each document the subjects of the best label combination, each with its calibrated probability: one beam search over a whole batch."""
    base = Sparse(rows, model["index"]).times(model["w"]) + model["bias"] if rows else np.zeros((0, len(model["subjects"])))
    n, k = len(rows), len(model["subjects"])
    score, chosen, probs = np.zeros((n, 1)), np.zeros((n, 1, k)), np.zeros((n, 1, k))
    for at in range(k):
        z = base[:, at : at + 1] + 0.5 * chosen[:, :, :at] @ model["links"][:at, at]
        p = np.clip(_sigmoid(model["a"][at] * z + model["b"][at]), 1e-9, 1 - 1e-9)
        score = np.concatenate([score + np.log(p), score + np.log(1 - p)], axis=1)
        yes, no = chosen.copy(), chosen
        yes[:, :, at] = 1.0
        told = probs.copy()
        told[:, :, at] = p
        chosen, probs = np.concatenate([yes, no], axis=1), np.concatenate([told, told], axis=1)
        best = np.argsort(-score, axis=1, kind="stable")[:, :beam]
        score = np.take_along_axis(score, best, 1)
        chosen, probs = (np.take_along_axis(c, best[:, :, None], 1) for c in (chosen, probs))
    return [[(s, float(p)) for s, c, p in zip(model["subjects"], chosen[i, 0], probs[i, 0]) if c] for i in range(n)]


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> bytes | None:
    """The fitted chain, or None without labels. Fitted in one task from at most ``LABELLED`` documents."""
    known = sorted(r["subject"] for r in subjects.filter("subject IS NOT NULL").select("subject").distinct().collect())
    tagged = labels.filter(F.col("subject").isin(known) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_set("subject").alias("tags"))
    bounded = tagged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    # The bounded ids go to the documents, not the documents to them: no text is shuffled but those of the sample.
    texts = documents.filter("text IS NOT NULL AND text <> ''").join(small(bounded), "doc_id")
    rows = texts.groupBy("doc_id", "tags").agg(F.min(F.struct("text", "source", "lang")).alias("d")).select("doc_id", "tags", "d.*")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort([zlib.crc32(str(i).encode()) for i in pdf["doc_id"]], kind="stable")]
        found = [features(t, s, g) for t, s, g in zip(pdf["text"], pdf["source"], pdf["lang"])]
        y = np.array([[float(k in tags) for k in known] for tags in pdf["tags"]], dtype=np.float32)
        return pd.DataFrame({"model": [pickle.dumps(fit_chain(found, y, known))]})

    got = rows.groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: fit(pdf), "model binary").collect()
    return bytes(got[0]["model"]) if got else None


def assign(documents: DataFrame, model: bytes | None) -> DataFrame:
    """(doc_id, subject, probability) of all documents."""
    schema = "doc_id bigint, subject string, probability double"
    narrow = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", "text", source_key(F.col("source")).alias("source"), "lang")
    if model is None:
        return narrow.select("doc_id", F.lit("").alias("subject"), F.lit(0.0).alias("probability")).filter("false")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = pickle.loads(model)
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                found = decode_many(chain, [features(*cells) for cells in zip(part["text"], part["source"], part["lang"])])
                out += [(i, s, p) for i, hits in zip(part["doc_id"], found) for s, p in hits]
            yield pd.DataFrame(out, columns=["doc_id", "subject", "probability"]).astype({"doc_id": "int64", "probability": "float64"})

    return narrow.mapInPandas(run, schema).dropDuplicates(["doc_id", "subject"])


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, probability)."""
    narrow = documents.withColumn("source", source_key(F.col("source"))).select("doc_id", "text", "source", "lang")
    return assign(documents, train(narrow, labels, subjects))


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, documents, share): how many documents treat each subject; '' stands for none."""
    ids = documents.filter("doc_id IS NOT NULL").select("doc_id").distinct()
    rows = ids.join(found.select("doc_id", "subject"), "doc_id", "left").select(F.coalesce("subject", F.lit("")).alias("subject"))
    total = ids.agg(F.count("*").alias("total"))
    return rows.groupBy("subject").agg(F.count("*").alias("documents")).join(F.broadcast(total)).select("subject", "documents", F.round(F.col("documents") / F.col("total"), 6).alias("share"))
