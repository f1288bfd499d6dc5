"""Toxicity by compression distance: windows of a text are compressed with a dictionary of toxic and one of ordinary
text, and what the first saves over the second is turned into a probability by calibrated thresholds.

Both dictionaries end with the commonest ordinary words, at the same distances. Before them the toxic one has the
words and word beginnings that are typical of toxic documents (by a likelihood ratio on document counts, with several
different contexts, so that copies of one document do not make its words typical), the ordinary one as many bytes that
occur in no text; so an ordinary window comes out about equally long with both. The calibration is a logistic
regression on shares of windows that save at least so many bytes, fitted by cross-fitting: on labelled documents that
their dictionaries have not seen.

Fitting takes a bounded sample of labelled documents to the driver; scoring is one pass without a shuffle over whole
texts, in which a task holds one batch.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shared import parts

WINDOW = 4
#: Bytes saved from which a window counts, one share each.
THRESHOLDS = (2, 3, 4, 5, 7)
FOLDS = 4
_WORDS = 3000  # bytes of the commonest words in either dictionary
_TERMS = 1500  # bytes of the most typical terms; more of them match parts of ordinary words


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _counted(texts: list[str]) -> tuple[Counter, dict[str, int]]:
    """How many texts have each term (a word, or the first 4 to 6 characters of one with a mark), and in how many
    contexts it is met."""
    docs: Counter = Counter()
    contexts: dict[str, set] = defaultdict(set)
    for text in texts:
        own, before = set(), ""
        for word in _words(text):
            for term in {word, *(word[:k] + "\0" for k in (4, 5, 6) if len(word) >= k)}:
                own.add(term)
                if len(contexts[term]) < 64:
                    contexts[term].add((before, word))
            before = word
        docs.update(own)
    return docs, {k: len(v) for k, v in contexts.items()}


def _likelihood_ratio(a: int, n: int, b: int, m: int) -> float:
    """G statistic of a in n against b in m, 0 where the first share is not the larger."""
    if a * m <= b * n:
        return 0.0
    rate = (a + b) / (n + m)
    part = lambda x, e: x * math.log(x / e) if x else 0.0
    return 2 * (part(a, n * rate) + part(n - a, n * (1 - rate)) + part(b, m * rate) + part(m - b, m * (1 - rate)))


def _fitting(terms: list[str], most: int) -> bytes:
    out, size = [], 0
    for term in terms:
        raw = term.rstrip("\0").encode()
        if size + len(raw) + 1 > most:
            break
        out.append(raw)
        size += len(raw) + 1
    return b" " + b" ".join(out[::-1]) if out else b""


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def scorer(self):
        """A function from texts to scores."""
        ours, theirs = (_compressor(d) for d in (self.toxic, self.ordinary))
        center, scale, weights = map(np.array, (self.center, self.scale, self.weights))

        def scores(texts: list[str | None]) -> list[float]:
            x = np.array([features(savings(t, ours, theirs)) for t in texts])
            z = ((x - center) / scale) @ weights + self.bias if len(texts) else np.zeros(0)
            return (1 / (1 + np.exp(-np.clip(z, -35, 35)))).tolist()

        return scores


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        window_log=14, hash_log=13, chain_log=14, search_log=6, min_match=4, target_length=48, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def savings(text: str | None, ours: zstandard.ZstdCompressor, theirs: zstandard.ZstdCompressor) -> np.ndarray:
    """Bytes that the toxic dictionary saves over the ordinary one in each window of the whole text."""
    words = _words(text)
    windows = [f" {' '.join(words[i : i + WINDOW])} ".encode("utf-8", "surrogatepass") for i in range(0, len(words), WINDOW)]
    return np.array([len(theirs.compress(w)) - len(ours.compress(w)) for w in windows] or [0])


def features(saved: np.ndarray) -> list[float]:
    """The largest saving, the mean of the three largest, shares of windows over each threshold (as square roots) and
    the mean of what is saved beyond one byte."""
    top = np.sort(saved)[::-1]
    return [float(top[0]), float(top[:3].mean()), *[math.sqrt(float((saved >= t).mean())) for t in THRESHOLDS], float(np.clip(saved - 1, 0, 8).mean())]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the bias of a weighted logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionaries(a: Counter, contexts: Counter, n: int, b: Counter, m: int) -> tuple[bytes, bytes]:
    """Both dictionaries from the document counts of terms in n toxic and m ordinary texts."""
    least = max(3, round(0.004 * n))
    ratio = {k: _likelihood_ratio(c, n, b[k], m) for k, c in a.items() if c >= least and contexts[k] >= least and (c + 0.5) / (n + 1) > 5 * (b[k] + 0.5) / (m + 1)}
    terms = sorted((k for k, g in ratio.items() if g >= 16), key=lambda k: (-ratio[k], k))
    common = _fitting(sorted((k for k in b if not k.endswith("\0") and k not in ratio), key=lambda k: (-b[k], k)), _WORDS) + b" "
    typical = _fitting(terms, _TERMS)
    theirs = b"\0" * max(len(typical), 8) + common
    return (typical + common if typical else theirs), theirs


def train_toxicity(texts: list[str], toxic: list[bool], calibrating: int = 2400, share: float = 1 / 3) -> ToxicityModel:
    """A model from labelled texts. The dictionaries come from all of them; the calibration is cross-fitted: texts of
    each of four parts (at most ``calibrating`` in all) are scored with dictionaries from the other three. Weights make
    toxic texts count as ``share`` of all. Without toxic texts every score is 0."""
    parts = [[(t, y) for k, (t, y) in enumerate(zip(texts, toxic, strict=True)) if k % FOLDS == f] for f in range(FOLDS)]
    counted = [[_counted([t for t, y in part if y is kind]) for kind in (True, False)] for part in parts]
    sizes = [[sum(y is kind for _, y in part) for kind in (True, False)] for part in parts]

    def fitted(use: list[int]) -> tuple[bytes, bytes]:
        total = lambda kind, what: sum((Counter(counted[f][kind][what]) for f in use), Counter())
        return _dictionaries(total(0, 0), total(0, 1), sum(sizes[f][0] for f in use), total(1, 0), sum(sizes[f][1] for f in use))

    ours, theirs = fitted(list(range(FOLDS)))
    x, y = [[0.0] * (len(THRESHOLDS) + 3)], [0.0]
    for f, part in enumerate(parts if any(toxic) else ()):
        pair = [_compressor(d) for d in fitted([g for g in range(FOLDS) if g != f])]
        for text, label in part[: calibrating // FOLDS]:
            x.append(features(savings(text, *pair)))
            y.append(float(label))
    x, y = np.array(x[1:] or x), np.array(y[1:] or y)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    if not y.any():
        return ToxicityModel(ours, theirs, tuple(center), tuple(scale), (0.0,) * x.shape[1], -35.0)
    weight = np.where(y > 0, share * len(y) / y.sum(), (1 - share) * len(y) / max(1.0, (1 - y).sum()))
    w = _logistic((x - center) / scale, y, weight)
    return ToxicityModel(ours, theirs, tuple(center), tuple(scale), tuple(w[:-1]), float(w[-1]))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_ordinary: int = 4000, longest: int = 16384) -> ToxicityModel:
    """A model from ``labels`` (doc_id, toxic) that are not held out: of each class at most so many documents of ``docs``, of
    those of up to ``longest`` characters the ones whose doc_id has the smallest hash. A document labelled both ways is
    toxic; of one with several texts the least counts."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    order = F.xxhash64("doc_id")
    short = docs.select("doc_id", "text").where(F.char_length("text") <= longest)
    there = marks.join(short.select("doc_id"), "doc_id", "left_semi")
    chosen = [there.where(F.col("toxic") == kind).orderBy(order, "doc_id").limit(most) for kind, most in ((True, most_toxic), (False, most_ordinary))]
    # No more rows than the two limits.
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = short.join(sample, "doc_id").groupBy(order.alias("o"), "doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: (r["o"], r["doc_id"]))
    return train_toxicity([r["text"] for r in rows], [r["toxic"] for r in rows])


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) of each row of ``docs`` (doc_id, text; other
    columns are ignored). Null and empty texts get the score of a text that saves nothing. A row for each row; a null
    doc_id is not held out."""

    def work(batches):
        scores = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores(batch["text"].to_pylist()), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_ordinary(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below 0.5; decided where they are read, without a
    shuffle. A column named ``text`` is scored."""

    def work(batches):
        scores = model.scorer()
        for batch in batches:
            for part in parts(batch):
                yield part.filter(pa.array([s < 0.5 for s in scores(part["text"].to_pylist())], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
