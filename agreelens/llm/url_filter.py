"""URL filter: rules by host and path, and boosted trees on lexical features for the URLs that no rule fits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreelens.llm.common import staged

ALLOW, BLOCK = "allow", "block"

#: Suffixes and path parts share this many buckets per kind, so their statistics are a table of proven size.
BUCKETS = 4096
#: Labelled URLs of each verdict that every bucket is credited with, so a few of them are little evidence.
SMOOTHING = 5.0
KINDS = ("top", "domain", "folder", "ending")

LEXICAL = (
    "url_length", "host_length", "host_parts", "depth", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "hyphens", "parameters", "has_fragment",
)
SUFFIX = tuple(f"{kind}_{what}" for kind in KINDS for what in ("log_count", "evidence"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty without ``://``."""
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule ``(verdict, host, path)`` that fits, as a struct (rule, verdict), else null.

    A rule fits its host and all subdomains if the path starts with the rule's. Of rules equally long the one with the longer host, then the first, wins.
    Rules are spelled out in the plan: meant for lists of some hundred.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1])), reverse=True)[::-1]:
        same = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        fits = same & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def _digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits; 0 for an empty text."""
    n = F.length(text).cast("double")
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c != "", _count_of(text, c) / n))
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - F.coalesce(F.when(p > 0, p * F.log2(p)), F.lit(0.0)))


def _count_of(text: Column, c: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, c, F.lit("")))


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The lexical features, none of them null."""
    after = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    parameters = F.when(after == "", 0.0).otherwise(1 + _count(after, "&") + _count(after, ";"))
    whole = F.coalesce(url, F.lit(""))
    ratio = lambda text: F.coalesce(F.try_divide(_digits(text), F.length(text)), F.lit(0.0))
    found = (
        F.length(whole),
        F.length(host),
        F.when(host == "", 0).otherwise(1 + _count(host, ".")),
        F.size(F.filter(F.split(path, "/"), lambda p: p != "")),
        ratio(whole),
        ratio(host),
        _entropy(whole),
        _entropy(host),
        _count(whole, "-"),
        parameters,
        F.contains(whole, F.lit("#")).cast("int"),
    )
    return {name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in zip(LEXICAL, found)}


def _suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Bucket of the host's last label, of its last two, of these with the path's first folder, and of the path's file ending."""
    domain = F.substring_index(host, ".", -2)
    keys = (
        F.substring_index(host, ".", -1),
        domain,
        F.concat_ws("/", domain, F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit(""))),
        F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1),
    )
    return {kind: F.pmod(F.xxhash64(F.lit(kind), key), F.lit(BUCKETS)).cast("int") for kind, key in zip(KINDS, keys)}


def lexical_features(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, url, host, path, fitted``, lexical features and suffix buckets of every row."""
    url = F.col("url")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": url_host(url), "path": url_path(url)})
    host, path = F.col("host"), F.col("path")
    return rows.select("*", fitting_rule(host, path, rules).alias("fitted"), *(c.alias(n) for n, c in (_lexical(url, host, path) | _suffixes(host, path)).items()))


def with_suffix_statistics(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """Adds the corpus-wide count and the evidence of each suffix bucket.

    ``statistics`` has at most ``BUCKETS`` rows per kind, whatever the corpus, and may be broadcast.
    """
    for kind in KINDS:
        own = statistics.where(F.col("kind") == kind).select(
            F.col("bucket").alias(kind), F.col("log_count").alias(f"{kind}_log_count"), F.col("evidence").alias(f"{kind}_evidence")
        )
        rows = rows.join(F.broadcast(own), kind, "left")
    return rows.na.fill(0.0, list(SUFFIX))


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """``kind, bucket, log_count, evidence`` over all rows. Counts are decades: a finer count would be a name for the suffix.

    Evidence is the log of how much more often blocked URLs have this suffix than allowed ones; 0 for a suffix that no rule judges.
    """
    each = rows.select(F.col("fitted.verdict").alias("verdict"), F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("bucket")) for k in KINDS))))
    sums = [F.count_if(F.col("verdict") == v).alias(v) for v in (ALLOW, BLOCK)]
    counted = each.groupBy("kind", "bucket").agg(F.count("*").alias("n"), *sums)
    totals = rows.agg(F.struct(*(F.count_if(F.col("fitted.verdict") == v).alias(v) for v in (ALLOW, BLOCK))).alias("t")).scalar()
    expected = {v: F.greatest(totals[v], F.lit(1)) for v in (ALLOW, BLOCK)}
    # Per verdict: URLs with the suffix, each verdict's URLs counting alike as a whole.
    both = expected[ALLOW] + expected[BLOCK]
    weighed = {v: F.col(v) * both / (2 * expected[v]) + SMOOTHING for v in (ALLOW, BLOCK)}
    return counted.select("kind", "bucket", F.floor(F.log10("n")).cast("double").alias("log_count"), F.ln(weighed[BLOCK] / weighed[ALLOW]).alias("evidence"))


def training_rows(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """Judged rows with all features, ``label`` (1 is blocked) and ``weight``, which gives both labels the same total.

    A suffix of a judged URL always has evidence, one of another URL often has none. So a quarter of the rows, by hash, keep no evidence, and the others
    each kind's by half: the trees learn what the other features are worth without it.
    """
    full = with_suffix_statistics(rows, statistics)
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), F.col("url")), F.lit(n))
    kept = {k: F.when((draw("all", 4) > 0) & (draw(k, 2) > 0), F.col(f"{k}_evidence")).otherwise(0.0) for k in KINDS}
    blocked = F.col("fitted.verdict") == BLOCK
    share = rows.agg(F.avg((F.col("fitted.verdict") == BLOCK).cast("double"))).scalar()
    weight = F.when(blocked, 0.5 / share).otherwise(0.5 / (1.0 - share))
    return full.withColumns({f"{k}_evidence": c for k, c in kept.items()}).select(
        *LEXICAL, *SUFFIX, blocked.cast("double").alias("label"), F.coalesce(weight, F.lit(1.0)).alias("weight")
    )


def fit_url_model(examples: DataFrame, rounds: int = 20, depth: int = 4, seed: int = 12) -> PipelineModel | None:
    """Boosted trees on ``training_rows``; None unless both labels occur."""
    if examples.select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="features")
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=seed, checkpointInterval=-1, weightCol="weight")
    vectors = assembler.transform(examples).select("features", "label", "weight")
    return PipelineModel([assembler, trees.fit(vectors)])


def _sample(rows: DataFrame, verdict: str, limit: int) -> DataFrame:
    """At most ``limit`` distinct URLs that rules give this verdict. Hashes thin them out before any are gathered."""
    own = rows.where(F.col("fitted.verdict") == verdict)
    place = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / (1 << 30)
    share = own.agg((F.lit(1.1 * limit) / F.greatest(F.count("*"), F.lit(1))).alias("share")).scalar()
    return own.where(place < share).dropDuplicates(["url"]).orderBy(place, "url").limit(limit)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    max_examples: int = 20_000,
    rounds: int = 20,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Every URL with its host, path, the rule that fits it, and a verdict: the rule's, else that of the trees.

    URLs that a rule judges are the labelled ones. The trees see length, depth, digit ratios, entropies, parameter counts and
    suffix statistics (how common a suffix is, and how much more common among blocked URLs); of the labelled URLs they are fitted on at most ``max_examples`` distinct ones per verdict, by hash. Suffix counts and shares
    cover all rows. The model's size does not depend on the input, and everything but its fit is JVM expressions.

    Returns ``page_id, host, path, rule, verdict, blocked_score``; the score is the trees' probability of ``block``, for every URL.

    A null URL, or one without ``://``, has an empty host and path and fits no rule. Without labelled URLs of both verdicts, the verdict is the one that occurs, else
    ``allow``, and the score 0 or 1 alike. Null ids stay null, repeated rows are judged each, other columns are ignored, long URLs are read whole, and an
    empty table gives no rows.
    """
    rows = staged(lexical_features(pages, rules, id_col, url_col), "url-features")
    statistics = staged(suffix_statistics(rows), "url-suffixes")
    chosen = staged(reduce(DataFrame.unionByName, (_sample(rows, v, max_examples) for v in (ALLOW, BLOCK))), "url-sample")
    examples = training_rows(chosen, statistics)
    # The order of rows decides between equally good splits.
    examples = staged(examples.repartition(4, *LEXICAL).sortWithinPartitions(*LEXICAL, *SUFFIX), "url-examples")
    model = fit_url_model(examples, rounds)
    if model is None:
        only = examples.agg(F.coalesce(F.max("label"), F.lit(0.0))).scalar()
        scored = rows.withColumn("blocked_score", only)
    else:
        scored = model.transform(with_suffix_statistics(rows, statistics)).withColumn("blocked_score", vector_to_array("probability")[1])
    own = F.when(F.col("blocked_score") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(
        "page_id", "host", "path", F.col("fitted.rule").alias("rule"), F.coalesce("fitted.verdict", own).alias("verdict"), "blocked_score"
    )
