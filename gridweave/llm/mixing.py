"""Mixing to target weights with soft domains: a classifier fitted on a labelled table gives each document posteriors
over domains, and projected-gradient least squares finds nonnegative document rates with which the expected tokens of
each domain meet their targets.

With p the posteriors, w the tokens and r the rate of a document, S all tokens and T the targets, the problem is

    min over r >= least of  1/2 e' M^-1 e + penalty/2 sum w (r - 1)^2 / S,   e = (sum w p r - T) / S,   M = sum w p p' / S.

In the metric of w/S the gradient at a document is p' M^-1 e + penalty (r - 1), so a step needs the sums over all
documents and nothing else. Rates are never stored between steps: each step computes them again from the history of
M^-1 e, a few numbers.

Scale: one pass over texts for posteriors and tokens, written to the shared folder; each step is one aggregate over
that narrow table, summed in each task, with one row of each of them to a last one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shared import stored
from gridweave.llm.words import SPACE

BUCKETS = 1 << 14
_PIECE = 1 << 19


@dataclass(frozen=True)
class DomainModel:
    """Multinomial naive Bayes on hashed byte trigrams, its log odds divided by ``temperature`` and by the square root
    of the number of trigrams."""

    domains: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray
    temperature: float

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([log_odds(t, self.weights) for t in texts]).reshape(-1, len(self.domains))
        return _softmax(z / self.temperature + self.prior)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    return p / p.sum(axis=1, keepdims=True) if len(z) else p


def _trigrams(raw: np.ndarray) -> np.ndarray:
    code = raw[:-2].astype(np.uint32) | raw[1:-1].astype(np.uint32) << np.uint32(8) | raw[2:].astype(np.uint32) << np.uint32(16)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 14)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)


def trigram_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed trigrams of the whole text, some bytes at a time."""
    raw, out = _bytes(text), np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(raw) - 2), _PIECE):
        out += np.bincount(_trigrams(raw[at : at + _PIECE + 2]), minlength=BUCKETS)
    return out


def log_odds(text: str | None, weights: np.ndarray) -> np.ndarray:
    """Sums of weights over the whole text, divided by the square root of the number of trigrams."""
    raw, out = _bytes(text), np.zeros(weights.shape[1])
    if len(raw) < 3:
        return out
    for at in range(0, len(raw) - 2, _PIECE):
        out += weights[_trigrams(raw[at : at + _PIECE + 2])].sum(axis=0, dtype=np.float64)
    return out / np.sqrt(len(raw) - 2)


def train_domains(texts: list[str], labels: list[str], domains: tuple[str, ...] = ()) -> DomainModel:
    """A model from labelled texts; the temperature is the one with the least log loss on the third of them that did
    not make the counts. ``domains`` without a text are known too, with the prior of one text and no trigrams of their own;
    without any text all domains are equally likely everywhere."""
    domains = tuple(sorted({*labels, *domains}))
    y = np.array([domains.index(v) for v in labels], int)

    def fitted(rows):
        counts = np.full((BUCKETS, len(domains)), 0.05)
        for r in rows:
            counts[:, y[r]] += trigram_counts(texts[r])
        share = np.log(counts / counts.sum(axis=0))
        prior = np.log((np.bincount(y[rows], minlength=len(domains)) + 1) / (len(rows) + len(domains)))
        return prior, (share - share.mean(axis=1, keepdims=True)).astype(np.float32)

    every = np.arange(len(texts))
    held = every[every % 3 == 2]
    prior, weights = fitted(every[every % 3 != 2])
    best, temperature = np.inf, 1.0
    z = np.array([log_odds(texts[r], weights) for r in held]).reshape(-1, len(domains))
    for t in np.geomspace(0.05, 20, 25) if len(held) else ():
        loss = -np.log(_softmax(z / t + prior)[np.arange(len(held)), y[held]] + 1e-12).mean()
        if loss < best:
            best, temperature = loss, float(t)
    return DomainModel(domains, *fitted(every), temperature)


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = (), sample: int = 3000, longest: int = 16384) -> DomainModel:
    """A model from ``labelled`` (doc_id, domain), of at most ``sample`` documents of ``docs``: of those of up to ``longest``
    characters the ones whose doc_id has the smallest hash. A document with several domains or texts has the least of
    them. ``domains`` are known even if no document is labelled with them, see :func:`train_domains`."""
    order = F.xxhash64("doc_id")
    marks = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    short = docs.select("doc_id", "text").where(F.char_length("text") <= longest)
    # No more rows than the sample.
    chosen = F.broadcast(marks.join(short.select("doc_id"), "doc_id", "left_semi").orderBy(order, "doc_id").limit(sample))
    rows = short.join(chosen, "doc_id").groupBy(order.alias("o"), "doc_id").agg(F.min("text").alias("text"), F.min("domain").alias("domain")).collect()
    rows.sort(key=lambda r: (r["o"], r["doc_id"]))
    return train_domains([r["text"] for r in rows], [r["domain"] for r in rows], domains)


def _rates(p: np.ndarray, history: list[np.ndarray], step: float, penalty: float, least: float) -> np.ndarray:
    """Each document's rate after the steps so far."""
    r = np.full(len(p), max(1.0, least))
    for e in history:
        r = np.maximum(least, r - step * (p @ e + penalty * (r - 1)))
    return r


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _sums(featured: DataFrame, width: int, history: list[np.ndarray], step: float, penalty: float, least: float) -> np.ndarray:
    """Expected tokens of each domain at the rates after the steps so far."""

    def work(batches):
        for batch in batches:
            p, w = _matrix(batch["posteriors"], width), np.asarray(batch["tokens"], np.float64)
            part = (p * (w * _rates(p, history, step, penalty, least))[:, None]).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.list_(pa.float64()))], ["parts"])

    # Without a key, so that a step is not dealt out to all shuffle partitions: one row of each task meets the others.
    parts = featured.select("posteriors", "tokens").mapInArrow(work, "parts array<double>")
    return np.array([v or 0.0 for v in parts.agg(*[F.sum(F.col("parts")[k]) for k in range(width)]).first()])


def mix_sources(
    docs: DataFrame, model: DomainModel, targets: dict[str, float], budget: float | None = None, least: float = 0.0, penalty: float = 1e-3, most_steps: int = 100, close: float = 1e-6, most_rate: float | None = None
) -> DataFrame:
    """doc_id, tokens (words), posteriors (in the order of ``model.domains``), rate (at least ``least``), copies (the rate
    rounded up or down by a hash of doc_id and text, so that its expectation is the rate) and miss of each row of ``docs``
    (doc_id, text; other columns are ignored). ``miss`` is one number for all rows: the largest difference between a domain's
    share of the budget in expected tokens and its target, 0 where targets can be met; steps end when it is below ``close``,
    when they change nothing, or after ``most_steps``. A rate above ``most_rate`` is an error.

    ``targets`` are weights of domains; those that the model does not know are an error, those left out are 0.
    ``budget`` is the number of expected tokens; None: all tokens there are, or with ``least`` above 0 the smallest
    number with which no domain falls below ``least``. Null and empty texts have no tokens, the prior as posteriors, and
    change no sum. A row for each row; no rows give no rows.
    """
    width = len(model.domains)
    if set(targets) - set(model.domains) or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets are nonnegative weights of the model's domains")

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch["text"].slice(at, 256).to_pylist()
                tokens = []
                for t in texts:
                    space = SPACE[np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)]
                    tokens.append(int((~space & np.concatenate([[True], space[:-1]])).sum()) if len(space) else 0)
                p = model.posteriors(texts)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, 256), batch["draw"].slice(at, 256), pa.array(tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "draw", "tokens", "posteriors"])

    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) / float(1 << 32)
    featured = stored(docs.select("doc_id", "text", draw.alias("draw")).select("doc_id", "draw", "text").mapInArrow(work, "doc_id long, draw double, tokens long, posteriors array<double>"), "posteriors")

    def moments(batches):
        for batch in batches:
            p, w = _matrix(batch["posteriors"], width), np.asarray(batch["tokens"], np.float64)
            m = (p * w[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int64()), pa.array(m.ravel())], ["k", "v"])

    m = np.zeros(width * width)
    for k, v in featured.select("posteriors", "tokens").mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v")).collect():
        m[k] = v
    m = m.reshape(width, width)
    total = max(m.sum(), 1.0)  # posteriors sum to 1
    share = np.array([targets.get(d, 0.0) for d in model.domains]) / sum(targets.values())
    if budget is None:
        have = m.sum(axis=0)
        budget = total if least <= 0 else max([least * h / s for h, s in zip(have, share, strict=True) if s > 0])
    inverse = np.linalg.pinv(m / total + 1e-9 * np.eye(width))
    step = 1 / (1 + penalty)
    history: list[np.ndarray] = []
    before = np.full(width, np.inf)
    for _ in range(most_steps + 1):
        sums = _sums(featured, width, history, step, penalty, least)
        error = (sums - budget * share) / total
        miss = float(np.abs(sums / max(budget, 1.0) - share).max()) if m.any() else 0.0
        if np.abs(error).max() < close or np.abs(sums - before).max() < close * total or len(history) == most_steps:
            break
        history.append(inverse @ error)
        before = sums

    def rated(batches):
        for batch in batches:
            # Sums come in any order; without their last digits rates are the same from run to run.
            r = np.round(_rates(_matrix(batch["posteriors"], width), history, step, penalty, least), 6)
            if most_rate is not None and len(r) and r.max() > most_rate:
                raise ValueError(f"a document is to be repeated {r.max():.6g} times, more than {most_rate:.6g}: its domain is too rare for its target")
            copies = np.floor(r + np.asarray(batch["draw"], np.float64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tokens"], batch["posteriors"], pa.array(r), pa.array(copies)], ["doc_id", "tokens", "posteriors", "rate", "copies"])

    return featured.mapInArrow(rated, "doc_id long, tokens long, posteriors array<double>, rate double, copies long").withColumn("miss", F.round(F.lit(miss), 6))
