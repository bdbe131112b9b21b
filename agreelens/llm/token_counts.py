"""Exact token counts of whole texts and of every prefix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agreelens.llm.common import id_and_bytes
from agreelens.llm.tokens import worker_tokenizer

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
PREFIXES = COUNTS + ", ends array<int>, counts array<int>"


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 2048, prefixes: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of every text, by a table of counts over its prefixes.

    A prefix's count is that of the prefix one piece shorter plus the tokens of that piece, so one pass
    gives the count at every piece end. ``fit_chars`` is the longest such prefix with at most ``limit``
    tokens, the whole text if it fits; in a piece of over 64 characters it goes on to a place where the next character
    no longer fits. With ``prefixes`` the table itself is kept: ``ends`` (characters)
    and ``counts``, with up to 64 more places inside each piece of over 64 characters; ``tokens_within`` and ``chars_within`` answer from it without encoding again.

    Null and empty texts count 0 tokens. A null id stays null; repeated rows give one row each. Other
    columns are ignored. A very long text is one row in a worker, never cut.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [t or b"" for t in part.column(1).to_pylist()]
                texts = [t.decode() for t in raw]
                table = tokenizer.prefix_counts(texts)
                total = [int(c[-1]) if len(c) else 0 for c in table]
                ends, fit = [], []
                for i, (text, counts, n) in enumerate(zip(texts, table, total)):
                    own = tokenizer.ends(text) if prefixes or n > limit else None
                    fit.append(len(text) if n <= limit else tokenizer.fitting(text, limit, own, counts))
                    if prefixes:
                        own, table[i] = tokenizer.with_inside(text, own, counts)
                    ends.append(own)
                columns = [
                    part.column(0),
                    pa.array([len(t) for t in raw], pa.int64()),
                    pa.array(total, pa.int64()),
                    pa.array([n > limit for n in total], pa.bool_()),
                    pa.array(fit, pa.int64()),
                ]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
                if prefixes:
                    columns += [pa.array(ends, pa.list_(pa.int32())), pa.array([c.astype(np.int32) for c in table], pa.list_(pa.int32()))]
                    names += ["ends", "counts"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return id_and_bytes(docs, id_col, text_col).mapInArrow(count, PREFIXES if prefixes else COUNTS)


def tokens_within(counted: DataFrame, chars: int) -> DataFrame:
    """Tokens of the longest stored prefix of at most ``chars`` characters, from ``token_counts(prefixes=True)``."""
    fitting = F.size(F.filter("ends", lambda e: e <= chars))
    return counted.withColumn("tokens", F.when(fitting > 0, F.get("counts", fitting - 1)).otherwise(0).cast("long"))


def chars_within(counted: DataFrame, budget: int) -> DataFrame:
    """Characters of the longest stored prefix of at most ``budget`` tokens."""
    fitting = F.size(F.filter("counts", lambda c: c <= budget))
    return counted.withColumn("chars", F.when(fitting > 0, F.get("ends", fitting - 1)).otherwise(0).cast("long"))
