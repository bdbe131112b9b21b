"""Every stage of the pipeline against a plain version of it, each on what its predecessor kept."""

from __future__ import annotations

import hashlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from agreelens.llm import quality
from agreelens.llm.common import staged
from agreelens.llm.queries import VOCABULARY

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

# The columns of documents, and others whose names operators and stages use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy int, of int, which int, row int, n_removed int, equal int"
STAGES = dict(corpus_pipeline.STAGES)


def prose(rng, lines=12):
    """Lines of words of one to four syllables."""

    def word():
        return "".join("klmnprst"[a] + "aeiou"[b] for a, b in rng.integers(0, (8, 5), (rng.integers(1, 5), 2)))

    return "\n".join(" ".join(word() for _ in range(9)) + "." for _ in range(lines))


def rows_of(texts):
    extra = (1, 2, 3, 4, 5, 6)
    return [(i, t, "en", None if i is None or i % 5 == 0 else f"s{i % 3}", len(t or "")) + extra for i, t in texts]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(11)
    texts = [(i, prose(rng)) for i in range(40)]
    texts += [(40 + i, texts[i][1]) for i in range(5)]  # copies
    texts += [(50 + i, " ".join(texts[i][1].split()[:-2])) for i in range(5, 10)]  # near copies without the line ends
    texts += [(60 + i, prose(rng, 10) + "\n" + "\n".join(texts[20][1].split("\n")[3:7])) for i in range(4)]  # a shared run
    texts += [(70 + i, "$$$ ### *** %% " * 30) for i in range(6)]
    texts += [(80, None), (81, ""), (82, " \n\t"), (83, "short text"), (84, prose(rng, 900))]
    texts += [texts[12], texts[12], (None, prose(rng)), (None, None), (None, texts[13][1]), (14, prose(rng))]
    return rows_of(texts)


@pytest.fixture(scope="module")
def kept(spark, corpus):
    """Stage -> (rows in, rows out), each stage on its predecessor's rows; the last one's are rows with names."""
    out, docs = {}, staged(spark.createDataFrame(corpus, SCHEMA).repartition(3), "test-pipeline")
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        result = stage(spark, docs, None)
        if name != "packing":
            assert result.columns == docs.columns
        docs = staged(result, "test-pipeline")
        out[name] = (before, docs.collect() if name == "packing" else [tuple(r) for r in docs.collect()])
    return out


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def vote_letters(text):
    """Votes of the rules by their published limits, from counts over the plain text."""
    words, lines = brute.words_of(text), [x for x in text.split("\n") if brute.words_of(x)]
    n_words, word_chars, n_symbols, n_dup, n_repeat, _ = brute.quality_base(text)
    joined = "".join(words)
    figures = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "n_lines": len(lines),
        "n_upper": sum(c.isupper() for c in joined),
        "n_letters": sum(c.isalpha() for c in joined),
        "n_closed": sum(x.rstrip(brute.WHITE)[-1:] in '.!?:"' for x in lines),
        "n_short_words": sum(len(w.encode()) <= 3 for w in words),
    }
    letters = ""
    for figure, per, bad, good, _ in quality.RULES.values():
        if not figures[per]:
            letters += "-"
            continue
        scope = {"x": figures[figure] / figures[per], "false": False}
        letters += "b" if eval(bad, {}, scope) else "g" if eval(good, {}, scope) else "-"
    return letters


def test_quality_stage(kept):
    before, after = kept["quality rules"]
    votes = Counter(vote_letters(r[1]) for r in before if brute.words_of(r[1]))
    model = quality.label_model(votes)
    want = [r for r in before if not brute.quality_base(r[1])[5] and model[vote_letters(r[1])] >= 0.5]
    same(after, want)
    ids = {r[0] for r in after}
    assert set(range(40)) <= ids and 84 in ids and not ids & {70, 75, 80, 81, 82, 83}


def test_line_stage(kept):
    before, after = kept["line dedup"]
    first = {}
    # Rows without an id come last; rows equal in id and text share their places.
    for r in before:
        lines = [(j, x.strip(" ")) for j, x in enumerate((r[1] or "").split("\n")) if brute.words_of(x)]
        for (j, a), (_, b) in zip(lines, lines[1:]):
            place = (r[0] is None, r[0] or 0, j)
            first[a, b] = min(first.get((a, b), place), place)
    want = []
    for r in before:
        lines = [(j, x.strip(" ")) for j, x in enumerate((r[1] or "").split("\n")) if brute.words_of(x)]
        gone = set()
        for (j, a), (k, b) in zip(lines, lines[1:]):
            if first[a, b] < (r[0] is None, r[0] or 0, j):
                gone |= {j, k}
        if not gone:
            want.append(r)
            continue
        text = "\n".join(x for j, x in enumerate(r[1].split("\n")) if j not in gone)
        if brute.words_of(text):
            want.append((r[0], text, *r[2:4], len(text), *r[5:]))
    same(after, want)
    assert not {r[0] for r in after} & set(range(40, 45))  # copies have nothing left
    assert {60, 61, 62, 63} <= {r[0] for r in after}


def near_kept(rows):
    """By ids: what is left of ``rows``, whose texts may share an id."""
    keys = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda k: (k[0], k[1] or ""))
    groups = brute.near_groups([(n, text) for n, (_, text) in enumerate(keys)], shingle=5)
    gone = {keys[n][0] for n, (_, root) in groups.items() if keys[root][0] != keys[n][0]}
    out, seen = [], set()
    for r in sorted(rows, key=lambda r: (r[3] is not None, r[3] or "")):
        if r[0] is None or (r[0] not in gone and (r[0], r[1]) not in seen):
            seen.add((r[0], r[1]))
            out.append(r)
    return out


def test_near_stage(kept):
    before, after = kept["near dedup"]
    same(after, near_kept(before))
    ids = [r[0] for r in after]
    assert not set(ids) & set(range(55, 60)) and ids.count(12) == 1 and set(range(14)) <= set(ids)


def test_near_stage_on_copies_nulls_and_repeats(spark, corpus):
    docs = staged(spark.createDataFrame(corpus, SCHEMA), "test-pipeline")
    got = [tuple(r) for r in STAGES["near dedup"](spark, docs, None).collect()]
    same(got, near_kept(corpus))
    assert sum(r[0] is None for r in got) == 3 and {80, 81, 82} <= {r[0] for r in got}


def test_mix_stage(kept):
    before, after = kept["source mix"]
    by_source = defaultdict(list)
    for r in before:
        by_source[r[3]].append(r)
    sizes = {s: sum(len(brute.words_of(r[1])) for r in rows) for s, rows in by_source.items()}
    targets, total = brute.mix_targets(sizes), sum(sizes.values())
    # Each of the blocks of 32 words goes to the highest quotient.
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    blocks = dict.fromkeys(order, 0)
    for _ in range(int(total / 32 + 0.5)):
        blocks[max(order, key=lambda s: targets[s] / (2 * blocks[s] + 1))] += 1
    want = []
    for s, rows in by_source.items():
        words = min(32 * blocks[s], 3 * sizes[s])
        again, extra = divmod(words, sizes[s])
        rows.sort(key=lambda r: (hashlib.md5(f"17:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0))
        for r in rows:
            w = brute.words_of(r[1])
            cut = min(len(w), extra)
            extra -= cut
            texts = [r[1]] * again + ([r[1]] if cut == len(w) else [" ".join(w[:cut])] if cut else [])
            want += [(r[0], t, *r[2:4], len(t), *r[5:]) for t in texts]
    same(after, want)


def test_packing_stage(kept):
    before, after = kept["packing"]
    vocabulary = Tokenizer.from_file(VOCABULARY)
    own, sequences = defaultdict(list), defaultdict(list)
    for r in after:
        own[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for r in before:
        ids = vocabulary.encode(r[1], add_special_tokens=False).ids + [2]
        want[r[0]].append(ids)
    for i, texts in want.items():
        # Rows of one id are packed each on their own: what stands at each place must be what they hold there.
        held = Counter()
        for start, data, total in own[i]:
            held.update((total, start + j, x) for j, x in enumerate(np.frombuffer(data, "<u4").tolist()))
        assert held == Counter((len(ids), j, x) for ids in texts for j, x in enumerate(ids))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end & (end - 1) == 0 and end <= 4096 or end > 4096 - 64


def test_line_stage_takes_long_single_lines(spark):
    """A passage of over 50 words on one line goes from later documents, whatever stands around it; one of 50 stays."""
    long, short = " ".join(f"a{j}" for j in range(51)), " ".join(f"b{j}" for j in range(50))
    texts = [(1, f"first\n{long}\n{short}"), (2, f"{short}\nsecond\n{long}\nend"), (3, long), (4, f"{long}\n{short}")]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in STAGES["line dedup"](spark, spark.createDataFrame(rows_of(texts), SCHEMA), None).collect()}
    second = f"{short}\nsecond\nend"
    assert got == {1: (texts[0][1], len(texts[0][1])), 2: (second, len(second))}


def test_stages_take_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, None).count() == 0, name


def test_run_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir), "test-pipeline")
    got = corpus_pipeline.run(spark, sf_dir)
    columns = ["doc_id", "start", "length", "doc_tokens"]
    same([tuple(r) for r in got.select(*columns).collect()], [tuple(r) for r in docs.select(*columns).collect()])
