"""Quality rules as weak supervision: rules vote or abstain, a label model weighs them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreelens.llm.common import WordHashes, covered, id_and_bytes, staged, window_hashes

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_closed", "n_short_words")
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)


def figures_of(text: bytes, hashes: WordHashes) -> tuple[int, ...]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    windows = window_hashes(hashes.of(words), 3)
    _, where, times = np.unique(windows, return_inverse=True, return_counts=True)
    repeated = covered(np.flatnonzero(times[where] > 1), 3, len(words)) if len(windows) else np.zeros(0, bool)
    joined = b"".join(words).decode()
    upper = sum(map(str.isupper, joined))
    return (
        len(words),
        len(joined),
        len(text.translate(None, NOT_SYMBOLS)),
        len(lines) - len(set(lines)),
        int(repeated.sum()),
        len(lines),
        upper,
        sum(map(str.isalpha, joined)),
        sum(line.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for line in lines),
        sum(len(w) <= 3 for w in words),
    )


def text_figures(docs: DataFrame) -> DataFrame:
    """``doc_id``, a hash of the text as ``copy``, and the counts the rules look at, from whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [figures_of(t or b"", hashes) for t in batch.column(1).to_pylist()]
            columns = zip(*rows) if rows else [[]] * len(FIGURES)
            figures = (pa.array(c, pa.int64()) for c in columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *figures], ["doc_id", "copy", *FIGURES])

    docs = docs.withColumn("copy", F.xxhash64(F.col("text").cast("string")))
    return docs.mapInArrow(count, "doc_id long, copy long, " + ", ".join(f"{f} long" for f in FIGURES))


Rules = dict[str, tuple[str, str, str, str, float]]
#: Rule -> (figure, per, bad if, good if, least odds): conditions on the share x of two counts. A rule votes bad, good or,
#: where neither holds, abstains; detectors of one kind of junk never vote good, for most junk is of another kind. Least
#: odds: how many times likelier its bad vote is held to be for bad documents at least, whatever is estimated.
RULES: Rules = {
    "symbols": ("n_symbols", "n_words", "x > 0.10", "false", 300.0),
    "repeated_lines": ("n_dup_lines", "n_lines", "x > 0.60", "false", 10.0),
    "repeated_words": ("n_repeat_words", "n_words", "x > 0.40", "false", 300.0),
    "upper_case": ("n_upper", "n_letters", "x > 0.40", "false", 300.0),
    "word_length": ("word_chars", "n_words", "x < 2.5 or x > 14", "false", 10.0),
    "open_lines": ("n_closed", "n_lines", "x < 0.10", "x >= 0.50", 1.0),
    "letters": ("n_letters", "word_chars", "x < 0.60", "false", 10.0),
    "short_words": ("n_short_words", "n_words", "x < 0.02", "x >= 0.10", 1.0),
}


def votes(rules: Rules) -> Column:
    """One letter per rule: ``b`` bad, ``g`` good, ``-`` abstains (also where the share has no base)."""
    letters = []
    for figure, per, bad, good, _ in rules.values():
        share = f"({figure} / {per})"
        bad, good = bad.replace("x", share), good.replace("x", share)
        letters.append(F.expr(f"case when {per} = 0 then '-' when {bad} then 'b' when {good} then 'g' else '-' end"))
    return F.concat(*letters)


def label_model(
    patterns: dict[str, int], rules: Rules = RULES, steps: int = 200, weight: float = 0.3, start_bad: float = 0.85
) -> dict[str, float]:
    """Vote pattern -> probability of good quality, by expectation-maximisation over pattern counts.

    Two classes; given the class, every rule votes bad, good or abstains on its own, with probabilities
    that the data set. A prior worth ``weight`` of the rows holds each rule to the side of its own vote: the
    class called bad stays the one in which rules vote bad; without the rules' least odds, a common kind of junk that
    only one rule sees would count as a trait of good documents. Deterministic; the size of the input
    enters only through the counts.
    """
    keys = sorted(patterns)
    if not keys:
        return {}
    counts = np.array([patterns[k] for k in keys], float)
    cast = np.array([["bg-".index(v) for v in k] for k in keys])
    n_rules = cast.shape[1]
    least = np.log([rule[4] for rule in rules.values()])
    any_bad = (cast == 0).any(axis=1)
    good = np.where(any_bad, 1 - start_bad, 0.98)
    total = counts.sum()
    # Pseudo-counts of (bad, good, abstains) under good and under bad documents.
    prior = weight * total * np.array([[0.02, 0.88, 0.10], [0.30, 0.50, 0.20]])
    for _ in range(steps):
        share = np.array([(counts * good).sum() + weight * total * 0.8, (counts * (1 - good)).sum() + weight * total * 0.2])
        # However much junk there is, a document without a vote against it is taken for good four to one.
        odds = np.tile(max(np.log(share[0] / share[1]), np.log(4.0)), len(keys))
        for r in range(n_rules):
            cells = np.stack([[((counts * p) * (cast[:, r] == v)).sum() for v in range(3)] for p in (good, 1 - good)]) + prior
            rates = cells / cells.sum(axis=1, keepdims=True)
            # A bad vote never counts for good quality, nor a good vote against it.
            gain = np.log(rates[0] / rates[1])
            gain = np.array([min(gain[0], -least[r]), max(gain[1], 0.0), 0.0])
            odds += gain[cast[:, r]]
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - good).max() < 1e-10:
            break
        good = new
    return dict(zip(keys, good.tolist()))


def quality_scores(
    docs: DataFrame,
    rules: Rules = RULES,
    threshold: float = 0.5,
    min_words: int = 50,
    repeat_percent: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Counts of every text, the votes of the rules, the posterior probability of good quality, and the verdict.

    Rules vote on shares of counts. Documents are grouped by their vote pattern (at most 3 ** rules of
    them, whatever the input's size); only these counts reach the driver, where expectation-maximisation
    estimates how far each rule can be trusted. ``kept`` needs a posterior of ``threshold`` and passing base
    limits (``base_failed``): at least ``min_words`` words and at most ``repeat_percent`` % of them in
    three-word runs that occur twice.

    ``copy`` is Spark's xxhash64 of the text: it tells rows of one id apart. Null and empty texts have no words:
    all counts 0, base_failed. A null id stays null; repeated rows are
    scored each. Other columns are ignored. An empty table gives an empty result.
    """
    figures = staged(text_figures(id_and_bytes(docs, id_col, text_col)), "quality").withColumn("votes", votes(rules))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    figures = figures.withColumn("base_failed", failed)
    counts = {r["votes"]: r["count"] for r in figures.where("n_words > 0").groupBy("votes").count().collect()}
    model = label_model(counts, rules)
    known = figures.sparkSession.createDataFrame(list(model.items()) or [("", 0.0)], "votes string, quality double")
    # One row per vote pattern: at most 3 ** rules rows.
    scored = figures.join(F.broadcast(known), "votes", "left").withColumn("quality", F.coalesce("quality", F.lit(0.0)))
    kept = ~F.col("base_failed") & (F.col("quality") >= threshold)
    return scored.select("doc_id", *FIGURES[:5], "base_failed", kept.alias("kept"), "quality", "votes", "copy")
