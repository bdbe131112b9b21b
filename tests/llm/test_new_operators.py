"""Fill-in-the-middle, URL filter and conversation repair against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from agreelens.llm import conversations as C
from agreelens.llm import fill_middle as M
from agreelens.llm import url_filter as U
from agreelens.llm.queries import URL_RULES, op12_url_filter, op13_conversations

sys.path.insert(0, str(Path(__file__).parent))

# ------------------------------------------------------------------------------------------ fill in the middle

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
SHARED = " ".join(f"word{i * i % 311} é日" for i in range(900))
TEXTS = [
    None,
    "",
    "a",
    " \n\t",
    "plain words and 12 numbers",
    "with <S> inside",
    "ends in <",
    "x" * 20_000,
    "é" * 9_000,
    SHARED,
    "head " + SHARED,
    SHARED[:5000] + "𝄞 tail" + SHARED[5000:],
    "".join(random.Random(2).choices("abXY é日𝄞 .\n<PSM>", k=30_000)),
]


def fim_brute(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows(spark, rows):
    # Other columns carry the operator's own names.
    made = [(i, t, "n", "form", 1) for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, n string, form string, cut int")


def test_fill_in_middle_matches_brute_force_and_restores(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(12 * len(TEXTS))] + [(None, "no id"), (None, None), (3, "again"), (3, "again")]
    out = M.fill_in_middle(fim_rows(spark, rows).repartition(3))
    got = out.withColumn("text", M.restore(F.col("output"), F.col("form"))).collect()
    assert sorted((repr(r["doc_id"]), *map(repr, tuple(r)[1:6])) for r in got) == sorted(
        (repr(i), *map(repr, fim_brute(i, t))) for i, t in rows
    )
    assert sorted((repr(r["doc_id"]), r["text"]) for r in got) == sorted((repr(i), t or "") for i, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_without_rows(spark):
    assert M.fill_in_middle(fim_rows(spark, [])).count() == 0


def test_chunks_follow_content_and_are_shared():
    memo, rolling = M.ChunkMemo(), M.RollingHash()
    raw = bytes(np.random.default_rng(0).integers(32, 120, 300_000, dtype=np.uint8))
    ends = rolling.chunk_ends(raw)
    assert M.RollingHash(segment=10_000).chunk_ends(raw) == ends and 150 < len(raw) / len(ends) < 400
    M.CountedText(raw, memo)
    before = memo.misses
    # An insertion at the head changes the chunks near it only.
    assert M.CountedText(b"new head" + raw, memo).tokens[-1] == len(TOKEN.findall("new head" + raw.decode()))
    assert memo.misses - before <= 2
    assert max(np.diff([0, *rolling.chunk_ends(b"a" * 50_000)])) <= M.LONGEST


def test_chunk_memory_is_bounded_in_bytes():
    memo = M.ChunkMemo(limit=1000)
    for i in range(200):
        assert memo[b"x%d" % i * 20][0] == 20 * (1 + len(str(i)))
        assert sum(map(len, memo)) <= 1000


# ------------------------------------------------------------------------------------------ URLs

URLS = [
    None,
    "",
    "no scheme/en/",
    "http://",
    "http://com/",
    "https://A.Example.COM/en/1?x=1&y=2#f",
    "https://www.example.com/en/1",
    "https://deep.www.example.com/en/1",
    "https://www.example.com/EN/1",
    "https://notexample.com/en/1",
    "https://example.com?/en/",
    "https://example.com#/en/",
    "https://x.net/es/1",
    "https://x.net/fr",
    "https://x.net/fr/?a://b.com/",
    "https://x.netx/fr/",
    "ftp://É.net/es/1",
    "https://x.org/" + "a1/" * 5000,
    "//x.com/y://z.net/es/",
]


def url_brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[1:] if fits else (None, None)
    return host, path, rule, verdict


def url_rows(spark, urls):
    return spark.createDataFrame([(i, u, "h", 2) for i, u in enumerate(urls)], "page_id long, url string, host string, fitted int")


def test_rules_match_brute_force(spark):
    got = {r["page_id"]: r for r in U.judge_urls(url_rows(spark, URLS + URLS[:3]), URL_RULES, rounds=2).collect()}
    assert len(got) == len(URLS) + 3
    for i, url in enumerate(URLS):
        host, path, rule, verdict = url_brute(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["blocked_score"] >= 0.5 else "allow"))
        assert 0 <= got[i]["blocked_score"] <= 1


def test_lexical_features_match_plain_ones(spark):
    rows = U.lexical_features(url_rows(spark, URLS), URL_RULES).collect()
    for r in rows:
        url = r["url"] or ""
        shares = [url.count(c) / len(url) for c in set(url)] if url else []
        assert r["entropy"] == pytest.approx(-sum(p * np.log2(p) for p in shares), abs=1e-9)
        assert r["digit_ratio"] == pytest.approx(sum(c in "0123456789" for c in url) / max(1, len(url)))
        assert r["depth"] == len([p for p in r["path"].split("/") if p])
        assert r["url_length"] == len(url) and r["hyphens"] == url.count("-")
        assert all(0 <= r[k] < U.BUCKETS for k in U.KINDS)
    assert rows[5]["parameters"] == 2


@pytest.mark.parametrize("urls, verdicts", [([], set()), (["https://x.org/a", None], {"allow"}), (["https://a.com/x", "https://b.org/"], {"allow"}), (["https://a.net/es/x", "https://b.org/"], {"block"})])
def test_one_verdict_or_none(spark, urls, verdicts):
    assert {r["verdict"] for r in U.judge_urls(url_rows(spark, urls), URL_RULES).collect()} == verdicts


def test_rules_equally_long_prefer_the_longer_host(spark):
    rules = [("allow", "b.c", "/x/yy"), ("block", "a.b.c", "/x/")]
    row = url_rows(spark, ["http://a.b.c/x/yy"]).select(U.fitting_rule(U.url_host(F.col("url")), U.url_path(F.col("url")), rules).alias("r")).head()
    assert row["r"]["rule"] == "a.b.c/x/"


def test_trees_learn_held_out_labels(spark, sf_dir):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    # Rules of a fifth of the labelled URLs are hidden: their verdicts are the trees'.
    rows = U.lexical_features(pages, URL_RULES).where("fitted is not null").withColumn("hidden", F.crc32("url") % 5 == 0)
    seen = rows.where("not hidden")
    statistics = U.suffix_statistics(seen)
    model = U.fit_url_model(U.training_rows(seen, statistics), rounds=10)
    label = (F.col("fitted.verdict") == U.BLOCK).cast("double")
    judged = model.transform(U.with_suffix_statistics(rows.where("hidden"), statistics).withColumn("label", label))
    right = judged.select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).head()[0]
    base = judged.select(F.avg("label")).head()[0]
    assert right > 0.97 and right > max(base, 1 - base) + 0.1


def test_suffix_evidence_by_hand(spark):
    urls = ["https://a.com/de/1"] * 8 + ["https://a.net/es/1"] * 4 + ["https://a.org/1"] * 2
    rows = U.lexical_features(url_rows(spark, urls), URL_RULES)
    full = {r["host"]: r for r in U.with_suffix_statistics(rows, U.suffix_statistics(rows)).collect()}
    # Each verdict's URLs count as half of all judged ones: 6 allowed, 6 blocked.
    assert full["a.com"]["top_evidence"] == pytest.approx(np.log(5 / 11)) and full["a.net"]["top_evidence"] == pytest.approx(np.log(11 / 5))
    assert full["a.org"]["top_evidence"] == 0 and [full[h]["domain_log_count"] for h in ("a.com", "a.org")] == [0, 0]
    assert full["a.com"]["ending_log_count"] == 1


def test_url_query_repeats_itself(spark, sf_dir):
    first, second = (sorted(map(tuple, op12_url_filter(spark, sf_dir).collect())) for _ in range(2))
    assert first == second and len(first) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


# ------------------------------------------------------------------------------------------ conversations

CODES = [0, 1, 2, 3, 4, 5, 6, 7, 8]


def audit_brute(codes):
    """Cost and audit by the grammar's states (0, 1: a user's or an assistant's turn comes next; 2: after the system turn; 3: nothing yet)."""

    def put(to, state, value):
        to[state] = min(to.get(state, value), value)

    def inserted(best):
        out, now = dict(best), best
        for _ in range(3):
            then = {}
            for s, (c, a) in now.items():
                put(then, 0 if s == 1 else 1, (c + 3, a + "I"))
            for s, v in then.items():
                put(out, s, v)
            now = then
        return out

    best = {3: (0, "")}
    for code in codes:
        then = {}
        for s, (c, a) in inserted(best).items():
            put(then, s, (c + 4, a + "D"))
            if code >= 8:
                continue
            more, role = 3 if code & 4 else 0, code & 3
            if s == 3 and role == 2:
                put(then, 2, (c + more, a + "K"))
            if role == (1 if s == 1 else 0):
                put(then, 0 if s == 1 else 1, (c + more, a + "K"))
            else:
                put(then, 0 if s == 1 else 1, (c + more + 3, a + "R"))
        best = then
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def aligned(codes, size):
    blocks = [codes[i : i + size] for i in range(0, len(codes), size)]
    aheads, ahead = [], list(C.TAIL_COSTS)
    for b in reversed(blocks):
        aheads.append(tuple(ahead))
        costs = C.Alignment(b).costs()
        ahead = [min(costs[4 * s + e] + ahead[e] for e in C.STATES) for s in C.STATES]
    state, audit = C.START, ""
    for b, after in zip(blocks, reversed(aheads)):
        own, state = C.Alignment(b).audit(state, after)
        audit += own
    return ahead[C.START], audit + C.TAILS[state]


def test_alignment_matches_grammar_states():
    for n in range(4):
        for codes in product(CODES, repeat=n):
            assert aligned(bytes(codes), 9) == audit_brute(codes)
    rng = random.Random(5)
    for _ in range(3000):
        weights = rng.choice([[5, 5, 1, 1, 1, 1, 0, 0, 1], [1] * 9, [1, 1, 0, 0, 5, 5, 0, 0, 3], [1, 1, 9, 1, 1, 1, 1, 1, 1]])
        codes = bytes(rng.choices(CODES, weights, k=rng.randint(4, 16)))
        assert aligned(codes, rng.choice([99, 1, 2, 3, 5])) == audit_brute(codes)


@pytest.mark.parametrize("weights", [[20, 20, 1, 1, 2, 2, 0, 0, 2], [1] * 9, [0, 0, 1, 0, 0, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0, 0, 0, 0]])
def test_alignment_of_long_conversations(weights):
    codes = bytes(random.Random(7).choices(CODES, weights, k=2500))
    assert aligned(codes, C.BLOCK) == audit_brute(codes)


def conversation_brute(rows):
    """(turn, role, text) rows in any order -> the summary's columns without conv_id."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    white, seen, codes, faults = " \t\n\v\f\r", set(), [], defaultdict(int)
    for _, role, text in rows:
        fault = "blank" if not text.strip(white) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(white)[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        codes.append("uas".find(role[0]) % 4 if role else 3)
        codes[-1] += {"blank": 8, "duplicate": 8, "truncated": 4, "": 0}[fault]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = audit_brute(codes)
    kept, names, n, left = [], ("user", "assistant"), 0, iter(rows)
    for edit in audit:
        _, role, text = next(left) if edit != "I" else (None, None, "")
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            kept.append(f"{role}:{text}")
            continue
        kept.append(f"{role if edit == 'K' else names[n % 2]}:{text}")
        n += 1
    digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest, kept


def turn_rows(spark, rows):
    schema = "conv_id long, turn long, role string, text string, place string, mark int, codes string, kind string"
    return spark.createDataFrame([(*r, "p", 1, "c", "k") for r in rows], schema)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "uncle"], ["Yes.", "Why?", "cut off", "", " \n", None, "Done! \t", "日本。", "a.\nb"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choice(texts)))
    rows += rows[:20]
    rows += [(99, i, ("user", "assistant")[i % 2 ^ (i % 37 == 5)], f"text {i % 400}" + "." * (i % 11 > 0)) for i in range(700)]
    return rows


@pytest.mark.parametrize("block", [4, 1024])
def test_conversations_match_brute_force(spark, talks, block):
    got = {r["conv_id"]: tuple(r)[1:] for r in C.conversation_audits(turn_rows(spark, talks).repartition(5), block=block).collect()}
    grouped = defaultdict(list)
    for conv, *row in talks:
        grouped[conv].append(tuple(row))
    assert got == {conv: conversation_brute(rows)[:-1] for conv, rows in grouped.items()}


def test_repaired_turns_follow_the_grammar(spark, talks):
    grouped, written = defaultdict(list), defaultdict(list)
    for conv, *row in talks:
        grouped[conv].append(tuple(row))
    for r in C.repaired_turns(turn_rows(spark, talks), block=64).orderBy("conv_id", "position").collect():
        written[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert dict(written) == {conv: kept for conv, rows in grouped.items() if (kept := conversation_brute(rows)[-1])}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in turns)) for turns in written.values())


def test_absent_turns_and_no_rows(spark):
    rows = turn_rows(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (2, 0, "user", "Gone.")]).withColumn("present", F.col("conv_id") == 1)
    got = {r["conv_id"]: r for r in C.conversation_audits(rows, present=F.col("present")).collect()}
    assert got[1]["audit"] == "KK" and got[1]["cost"] == 0
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.conversation_audits(turn_rows(spark, [])).count() == 0


def test_damage_matches_its_rules(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect() + [(None, None, None, None), (7, None, "system", "A. B!")]
    want = defaultdict(list)
    for conv, turn, role, text in map(tuple, turns):
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    df = spark.createDataFrame([tuple(t) for t in turns], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:] for r in C.conversation_audits(C.damaged(df), present=F.col("present")).collect()}
    assert got == {conv: conversation_brute(rows)[:-1] for conv, rows in want.items()}
    assert op13_conversations(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()


def test_a_long_conversation_is_aligned_in_many_tasks(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(6000)]
    rows = turn_rows(spark, rows).repartition(4).select("conv_id", "turn", "role", "text").withColumns(
        {"mark": F.md5("text"), "place": F.monotonically_increasing_id(), "present": F.lit(True), "blank": F.lit(False), "cut": F.lit(False)}
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = C._blocks(C._coded(rows), 256).withColumn("task", F.spark_partition_id())
        assert blocks.agg(F.count_distinct("task")).head()[0] >= 3
        assert blocks.agg(F.sum(F.length("codes"))).head()[0] == 6000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
