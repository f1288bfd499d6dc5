"""Quality rules as a short-circuit cascade, ordered by what they reject for what they cost.

Every document gets the base figures. Those that pass the base rule go through further rules, each of which sees only
what the ones before it let through. Costs and rejections are estimated on a bounded sample; they set the order alone,
so the verdicts are the same whatever the sample says.

Scale: one pass, no shuffle; a task holds one Arrow batch and works on half a megabyte of text at a time.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridweave.llm.shared import bounded_sample
from gridweave.llm.words import SPACE, Chunk, chunks, mix, spans

SYMBOLS = b"#*$%&|<>"
_SYMBOL, _UPPER, _LOWER = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91] = True
_LOWER[97:123] = True
#: An odd number for telling texts apart in hashes.
_APART = np.uint64(0x9FB21C651E98DF25)


def _per_text(chunk: Chunk, mask: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask marks."""
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[chunk.begin[1:]] - sums[chunk.begin[:-1]]


def repeated_windows(chunk: Chunk, n: int) -> np.ndarray:
    """The first words of the n-word windows that are found twice or more in their text. Windows are sorted by a hash;
    those that share one are compared word by word, and where two of them differ all windows are."""
    grams, at = chunk.grams(n)
    _, lead, back, times = np.unique(mix(grams + (chunk.doc[at].astype(np.uint64) + np.uint64(1)) * _APART), return_index=True, return_inverse=True, return_counts=True)
    again = times[back] > 1
    here, first = at[again], at[lead[back[again]]]
    if all((chunk.id[here + k] == chunk.id[first + k]).all() for k in range(n)) and (chunk.doc[here] == chunk.doc[first]).all():
        return here
    _, back, times = np.unique(np.column_stack([chunk.doc[at], *[chunk.id[at + k] for k in range(n)]]), axis=0, return_inverse=True, return_counts=True)
    return at[times[back] > 1]


def base_facts(chunk: Chunk) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words of each text."""
    n = len(chunk.first) - 1
    data, space = chunk.data, SPACE[chunk.data]
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    letters = np.concatenate([[0], np.cumsum(~space)])
    worded = letters[ends] > letters[starts]
    starts, ends = starts[worded], ends[worded]
    text = np.searchsorted(chunk.begin, starts, side="right") - 1
    line, different = spans(data, starts, ends)
    _, one = np.unique(text * (len(different) + 1) + line, return_index=True)
    n_lines = np.bincount(text, minlength=n)
    again = repeated_windows(chunk, 5)
    repeat = np.zeros(len(chunk.hash) + 1, np.int64)
    np.add.at(repeat, again, 1)
    np.add.at(repeat, again + 5, -1)
    covered = np.cumsum(repeat)[:-1] > 0
    return {
        "n_words": np.diff(chunk.first),
        "word_chars": _per_text(chunk, ~space & ((data & 0xC0) != 0x80)),
        "n_symbols": _per_text(chunk, _SYMBOL[data]),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - np.bincount(text[one], minlength=n),
        "n_repeat_words": np.bincount(chunk.doc[covered], minlength=n),
    }


def base_failed(facts: dict[str, np.ndarray]) -> np.ndarray:
    return (facts["n_words"] < 10) | (100 * facts["n_repeat_words"] > 20 * facts["n_words"])


@dataclass(frozen=True)
class Rule:
    """``rejects(chunk, facts, rows)`` tells which of the texts numbered ``rows`` the rule rejects."""

    name: str
    rejects: Callable[[Chunk, dict, np.ndarray], np.ndarray]


def _capitals(chunk: Chunk, facts: dict, rows: np.ndarray) -> np.ndarray:
    out = []
    for r in rows:
        own = chunk.data[chunk.begin[r] : chunk.begin[r + 1]]
        upper, lower = int(_UPPER[own].sum()), int(_LOWER[own].sum())
        out.append(10 * upper > 3 * (upper + lower))
    return np.array(out, bool)


def _one_word(chunk: Chunk, facts: dict, rows: np.ndarray) -> np.ndarray:
    out = []
    for r in rows:
        _, times = np.unique(chunk.id[chunk.first[r] : chunk.first[r + 1]], return_counts=True)
        out.append(len(times) > 0 and 10 * times.max() > 3 * times.sum())
    return np.array(out, bool)


def _stutter(chunk: Chunk, facts: dict, rows: np.ndarray) -> np.ndarray:
    out = []
    for r in rows:
        own = chunk.id[chunk.first[r] : chunk.first[r + 1]]
        out.append(10 * int((own[1:] == own[:-1]).sum()) > 3 * len(own))
    return np.array(out, bool)


def _dense(chunk: Chunk, facts: dict, rows: np.ndarray) -> np.ndarray:
    raw = [chunk.data[chunk.begin[r] : chunk.begin[r + 1]].tobytes() for r in rows]
    return np.array([len(x) >= 400 and 8 * len(zlib.compress(x, 1)) < len(x) for x in raw], bool)


#: The rules past the base one: symbols, mostly repeated lines, odd word lengths, words said again at once, capitals, one
#: dominant word, redundancy.
RULES = (
    Rule("symbols", lambda chunk, f, rows: 100 * f["n_symbols"][rows] > 10 * f["n_words"][rows]),
    Rule("repeated_lines", lambda chunk, f, rows: (f["n_dup_lines"][rows] > 3) & (2 * f["n_dup_lines"][rows] > f["n_lines"][rows])),
    Rule("word_length", lambda chunk, f, rows: (f["word_chars"][rows] < 2 * f["n_words"][rows]) | (f["word_chars"][rows] > 15 * f["n_words"][rows])),
    Rule("stutter", _stutter),
    Rule("capitals", _capitals),
    Rule("one_word", _one_word),
    Rule("redundant", _dense),
)


def verdicts(chunk: Chunk, facts: dict, rules: tuple[Rule, ...]) -> tuple[np.ndarray, list[str | None]]:
    """Which texts are kept, and the rule that rejected each of the others."""
    failed = base_failed(facts)
    by: list[str | None] = ["base" if x else None for x in failed]
    rows = np.flatnonzero(~failed)
    for rule in rules:
        if not len(rows):
            break
        bad = rule.rejects(chunk, facts, rows)
        for r in rows[bad]:
            by[r] = rule.name
        rows = rows[~bad]
    kept = np.zeros(len(failed), bool)
    kept[rows] = True
    return kept, by


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 1000) -> list[dict]:
    """Each rule's name, seconds a text and share rejected among at most ``sample`` texts that pass the base rule,
    in the order of rejection for cost. No text: the order given."""

    def work(batches):
        for batch in batches:
            seen, took, hit = 0, [0.0] * len(rules), [0] * len(rules)
            for _, chunk in chunks(batch["text"].to_pylist()):
                facts = base_facts(chunk)
                rows = np.flatnonzero(~base_failed(facts))
                seen += len(rows)
                for k, rule in enumerate(rules if len(rows) else ()):
                    began = time.perf_counter()
                    hit[k] += int(rule.rejects(chunk, facts, rows).sum())
                    took[k] += time.perf_counter() - began
            yield pa.RecordBatch.from_arrays([pa.array(list(range(len(rules)))), pa.array([seen] * len(rules)), pa.array(took), pa.array(hit)], ["rule", "seen", "took", "hit"])

    parts = bounded_sample(docs.select("doc_id", "text"), sample).select("text").mapInArrow(work, "rule long, seen long, took double, hit long").groupBy("rule").sum("seen", "took", "hit").collect()
    known = {r[0]: (r[1], r[2], r[3]) for r in parts}
    out = []
    for k, rule in enumerate(rules):
        seen, took, hit = known.get(k, (0, 0.0, 0))
        out.append({"rule": rule.name, "cost": took / max(seen, 1), "rejected": hit / max(seen, 1)})
    return sorted(out, key=lambda x: -x["rejected"] / max(x["cost"], 1e-9))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 1000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and rejected_by (base or a
    rule; null if kept) of each row of ``docs`` (doc_id, text; other columns are ignored).

    Null text: no words, and so rejected by the base rule. A row for each row, repeated ones too. ``rejected_by`` is
    the first rule in the sampled order; ``kept`` does not depend on that order.
    """
    by_name = {r.name: r for r in rules}
    ordered = tuple(by_name[x["rule"]] for x in rule_order(docs, rules, sample))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(batches):
        for batch in batches:
            for begin, chunk in chunks(batch["text"].to_pylist()):
                facts = base_facts(chunk)
                kept, by = verdicts(chunk, facts, ordered)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(begin, len(kept)), *[pa.array(facts[k].astype(np.int64)) for k in figures], pa.array(base_failed(facts)), pa.array(kept), pa.array(by, pa.string())],
                    ["doc_id", *figures, "base_failed", "kept", "rejected_by"],
                )

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id long, {', '.join(f'{k} long' for k in figures)}, base_failed boolean, kept boolean, rejected_by string")
