"""Toxicity by the nearest labelled examples: exact TF-IDF cosine, block-max index, weighted votes."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreelens.llm.common import staged

TOKEN = re.compile(r"\w+")
#: A term is a word or a word's first letters, so many, at a level: it is in a text with at least so many of them.
PREFIXES = (4, 5, 6, 7)
LEVELS = (1, 2, 3, 4, 6, 8, 12)

SCORES = "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>"
EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))


def stems(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) > n)]


def all_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) rows to one row per term of each text."""
    for batch in batches:
        for at in range(batch.num_rows):
            toxic, text = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
            counts: Counter[str] = Counter()
            for word, n in Counter(TOKEN.findall(text.lower())).items():
                for stem in stems(word):
                    counts[stem] += n
            terms = [f"{stem}#{level}" for stem, n in counts.items() for level in LEVELS if n >= level]
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([toxic] * len(terms), pa.int32())], ["term", "toxic"])


class TermFinder(dict):
    """Word -> numbers of those of its stems that the vocabulary knows; forgets words beyond ``limit``."""

    def __init__(self, vocabulary: list[str], limit: int = 500_000):
        self.limit = limit
        self.levels: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, term in enumerate(vocabulary):
            stem, _, level = term.rpartition("#")
            self.levels[stem].append((int(level), number))
        self.stems = set(self.levels)

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > self.limit:
            self.clear()
        value = self[word] = tuple(s for s in stems(word) if s in self.stems)
        return value

    def terms(self, text: str) -> list[int]:
        counts = Counter(s for word in TOKEN.findall(text.lower()) for s in self[word])
        return sorted(number for stem, n in counts.items() for level, number in self.levels[stem] if n >= level)


@dataclass
class ExampleIndex:
    """Labelled examples as sets of terms, in blocks. A text's TF-IDF vector has the idf of each term it holds."""

    ids: np.ndarray
    toxic: np.ndarray
    holds: np.ndarray  # term x example, as bits
    idf: np.ndarray
    norms: np.ndarray
    votes: np.ndarray  # how many labelled rows an example stands for
    prior: float  # toxic share of examples without a known term
    share: float  # toxic share of all
    block: int = 64

    @classmethod
    def build(cls, rows: list[tuple[int, int, list[int]]], idf: np.ndarray, per_class: dict[int, int]) -> ExampleIndex:
        drawn = Counter(toxic for _, toxic, _ in rows)
        votes_of = {c: per_class[c] / drawn[c] for c in drawn}
        total = sum(votes_of[t] for _, t, _ in rows)
        share = sum(votes_of[t] * t for _, t, _ in rows) / total if total else 0.0
        bare = [(votes_of[t], t) for _, t, terms in rows if not terms]
        prior = (sum(v * t for v, t in bare) + 0.1 * share) / (sum(v for v, _ in bare) + 1.0)
        # Examples that share their rarest term stand together, which makes block maxima tight.
        rows = sorted((r for r in rows if r[2]), key=lambda r: (r[1], max(r[2], key=lambda t: (idf[t], t)), r[0]))
        holds = np.zeros((len(idf), len(rows)), bool)
        for i, (_, _, terms) in enumerate(rows):
            holds[terms, i] = True
        norms = np.sqrt((idf[:, None] ** 2 * holds).sum(axis=0)) if rows else np.zeros(0)
        toxic = np.array([r[1] for r in rows], np.int32)
        votes = np.array([votes_of[r[1]] for r in rows])
        return cls(np.array([r[0] for r in rows], np.int64), toxic, holds, idf, norms, votes, prior, share)

    def prepare(self) -> None:
        n = self.holds.shape[1]
        self.starts = np.arange(0, n, self.block)
        # The largest weight of each term in each block.
        weights = np.where(self.holds, self.idf[:, None] / np.where(self.norms > 0, self.norms, 1), 0.0)
        self.best = np.maximum.reduceat(weights, self.starts, axis=1) if n else np.zeros((len(self.idf), 0))

    def nearest(self, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest examples, and of those that tie with the last: blocks by falling bound until none reaches it."""
        idf = self.idf[terms]
        q = idf / np.sqrt((idf**2).sum())
        bound = q @ self.best[terms]
        order = np.argsort(-bound, kind="stable")
        places, cosines = np.zeros(0, np.int64), np.zeros(0)
        at, width = 0, max(1, -(-k // self.block))
        while at < len(order):
            floor = np.sort(cosines)[-k] if len(cosines) >= k else 0.0
            chosen = order[at : at + width]
            chosen = chosen[(bound[chosen] > 0) & (bound[chosen] >= floor - 1e-12)]
            if not len(chosen):
                break
            rows = (self.starts[chosen][:, None] + np.arange(self.block)).ravel()
            rows = rows[rows < len(self.ids)]
            found = (q * idf) @ self.holds[np.ix_(terms, rows)] / self.norms[rows]
            places, cosines = np.concatenate([places, rows]), np.concatenate([cosines, found])
            at, width = at + width, width * 4
        top = np.lexsort((places, -cosines))
        # All that tie with the k-th vote: their order in the index decides nothing.
        last = cosines[top[k - 1]] if len(top) > k else 0.0
        top = top[(cosines[top] > 0) & (cosines[top] >= last - 1e-12)]
        return places[top], cosines[top]

    def score(self, terms: list[int], k: int) -> tuple[float, list[dict]]:
        if not terms or not len(self.ids):
            return self.prior, []
        places, cosines = self.nearest(terms, k)
        weight = cosines**2 * self.votes[places]
        score = ((weight * self.toxic[places]).sum() + 0.5 * self.share) / (weight.sum() + 0.5)
        evidence = [
            {"doc_id": int(self.ids[p]), "cosine": float(c), "toxic": int(self.toxic[p])} for p, c in zip(places[:3], cosines[:3])
        ]
        return float(score), evidence


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text divides by 5, or there is no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    max_examples: int = 4096,
    max_terms: int = 2000,
    k: int = 15,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for every text.

    Learned from a bounded sample: at most ``max_examples`` labelled rows outside the held-out fifth, half of them of each
    class, by hash of the id; each votes for as many labelled rows as it stands for. From their terms, the ``max_terms`` most typical of
    toxic examples form the vocabulary. The terms' document frequencies are counted over all documents. A text gets
    the votes of its ``k`` nearest examples by TF-IDF cosine (and of those as near as the last), weighted by squared cosine, with a small prior; the nearest
    three are its evidence. The search is exact: a block of examples is skipped only if the sum of its largest term
    weights cannot reach the k-th best cosine.

    A text without a known term, empty and null ones too, gets the toxic share of such examples. Scores use the text
    alone. A null id is held out. Rows with the same id are scored each. Labels that are null, or of ids without a
    document, are not used; of contradicting labels the toxic one holds. Other columns are ignored. An empty table gives an
    empty result; without any label all scores are 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    known = known.where(~held_out())
    per_class = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    half = max_examples // 2
    sample = known.where("toxic = 1").orderBy(*by_hash).limit(half).union(known.where("toxic = 0").orderBy(*by_hash).limit(half))
    # At most ``max_examples`` rows of two numbers.
    sample = F.broadcast(staged(sample, "toxicity-sample"))

    texts = rows.join(sample, "doc_id").select("toxic", "text")
    terms = texts.mapInArrow(all_terms, "term string, toxic int").groupBy("term")
    counted = terms.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    n1, n0 = (min(half, per_class.get(c, 0)) for c in (1, 0))
    rate1, rate0 = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    typical = counted.where((F.col("a") >= 3) & (rate1 > 3 * rate0)).withColumn("gain", F.round(F.col("a") * F.log(rate1 / rate0), 6))
    vocabulary = [r["term"] for r in typical.orderBy(F.desc("gain"), "term").limit(max_terms).collect()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = TermFinder(vocabulary)
        for batch in batches:
            found = [finder.terms(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "terms"])

    vectors = staged(rows.mapInArrow(find, "doc_id long, terms array<int>"), "toxicity-vectors")
    n_docs = vectors.count()
    frequency = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most ``max_terms`` rows
    df = np.zeros(len(vocabulary))
    for r in frequency:
        df[r["term"]] = r["count"]
    idf = np.log((n_docs + 1) / (df + 1)) + 1
    examples = vectors.join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("terms").alias("terms"))
    index = ExampleIndex.build([(r["doc_id"], r["toxic"], r["terms"]) for r in examples.collect()], idf, per_class)
    # At most max_terms x max_examples bytes, as plain arrays: workers need not have this package.
    shared = spark.sparkContext.broadcast(tuple(getattr(index, f.name) for f in fields(index)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ExampleIndex(*shared.value)
        own.prepare()
        seen: dict[tuple[int, ...], tuple[float, list[dict]]] = {}
        for batch in batches:
            out = []
            for terms in batch.column(1).to_pylist():
                key = tuple(terms)
                if key not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    seen[key] = own.score(terms, k)
                out.append(seen[key])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], EVIDENCE)],
                ["doc_id", "score", "evidence"],
            )

    scored = vectors.mapInArrow(score, SCORES)
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"), "evidence")
