"""The registered queries in plain SQL, written for DuckDB over the same tables.

Built from named common table expressions that restate the views and stages. Integers are cast to BIGINT and
doubles rounded, as ``catalog.tidy`` does.
"""

from __future__ import annotations

from ..functions.constants import PREDICTION_FLAG, PROMPT_INTRO, PY_WHITESPACE

_INTRO = PROMPT_INTRO.replace("'", "''")

# name -> (other expressions it reads, its definition)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "votes": (
        (),
        """SELECT l_orderkey AS item_id, CAST(CASE l_orderkey % 5 WHEN 0 THEN 1 + l_partkey % 3
             WHEN 1 THEN -1 - l_partkey % 3 WHEN 2 THEN 0 ELSE l_partkey % 7 - 3 END AS BIGINT) AS vote
           FROM lineitem""",
    ),
    "items": (
        ("votes",),
        """SELECT g.item_id, CASE WHEN g.item_id % 101 = 0 THEN '' WHEN g.item_id % 97 = 0 THEN s || ',x' ELSE s END
             AS votes_str, o_orderpriority AS verb, o_orderstatus AS genre
           FROM (SELECT item_id, string_agg(CAST(vote AS VARCHAR), ',' ORDER BY vote) AS s FROM votes GROUP BY item_id) g
           JOIN orders ON o_orderkey = g.item_id""",
    ),
    "pieces": (
        ("items",),
        """SELECT item_id, verb, genre, votes_str, trim(unnest(string_split(votes_str, ','))) AS piece FROM items""",
    ),
    "numbers": (
        ("pieces",),
        """SELECT *, CASE WHEN regexp_matches(piece, '^[+-]?[0-9]+$') THEN TRY_CAST(piece AS BIGINT) END AS v
           FROM pieces""",
    ),
    # All pieces of an item, empty ones included.
    "lenient": (
        ("numbers",),
        """SELECT item_id, count(*) AS total, coalesce(sum(v), 0) AS s, count(CASE WHEN v IS NULL THEN 1 END) > 0 AS bad,
             count(CASE WHEN v BETWEEN 1 AND 3 THEN 1 END) AS e, count(CASE WHEN v = 0 THEN 1 END) AS n, count(CASE WHEN v BETWEEN -3 AND -1 THEN 1 END) AS c
           FROM numbers GROUP BY item_id""",
    ),
    # Items that survive the dropping policy.
    "kept": (
        ("numbers",),
        """SELECT item_id, verb, genre, votes_str, count(*) AS total, sum(v) AS s,
             count(CASE WHEN v BETWEEN 1 AND 3 THEN 1 END) AS e, count(CASE WHEN v = 0 THEN 1 END) AS n, count(CASE WHEN v BETWEEN -3 AND -1 THEN 1 END) AS c
           FROM numbers WHERE piece <> '' GROUP BY item_id, verb, genre, votes_str
           HAVING count(CASE WHEN v IS NULL THEN 1 END) = 0""",
    ),
    "threshold": (
        ("kept",),
        """SELECT *, CASE WHEN CAST(e AS DOUBLE) / total >= 0.8 THEN 'entailment'
             WHEN CAST(n AS DOUBLE) / total >= 0.8 THEN 'neutral'
             WHEN CAST(c AS DOUBLE) / total >= 0.8 THEN 'contradiction' END AS gold_label FROM kept""",
    ),
    "agreed": (
        ("threshold",),
        """SELECT *, CAST(CASE gold_label WHEN 'entailment' THEN e WHEN 'neutral' THEN n
             WHEN 'contradiction' THEN c END AS DOUBLE) / total AS agreement FROM threshold""",
    ),
    # Items without a malformed vote; those without any vote have a total of 0.
    "well_formed": (
        ("numbers",),
        """SELECT item_id, genre, count(CASE WHEN piece <> '' THEN 1 END) AS total,
             count(CASE WHEN v BETWEEN 1 AND 3 THEN 1 END) AS e, count(CASE WHEN v = 0 THEN 1 END) AS n, count(CASE WHEN v BETWEEN -3 AND -1 THEN 1 END) AS c
           FROM numbers GROUP BY item_id, genre HAVING count(CASE WHEN piece <> '' AND v IS NULL THEN 1 END) = 0""",
    ),
    "decided": (
        ("well_formed",),
        """SELECT item_id, genre, CASE WHEN total = 0 THEN NULL WHEN CAST(e AS DOUBLE) / total >= 0.8 THEN 'entailment'
             WHEN CAST(n AS DOUBLE) / total >= 0.8 THEN 'neutral' WHEN CAST(c AS DOUBLE) / total >= 0.8 THEN 'contradiction' END AS gold_label,
             CASE WHEN total > 0 THEN CAST(greatest(e, n, c) AS DOUBLE) / total END AS top_share FROM well_formed""",
    ),
    "gold": (
        ("kept",),
        """SELECT CAST(item_id AS VARCHAR) AS item_id, verb, genre,
             CASE WHEN greatest(e, n, c) = e THEN 'entailment' WHEN greatest(e, n, c) = c THEN 'contradiction'
               ELSE 'neutral' END AS gold_label,
             CASE WHEN CAST(greatest(e, n, c) AS DOUBLE) / total >= 0.8 THEN 'low_entropy' ELSE 'high_entropy' END
               AS entropy_class FROM kept""",
    ),
    "responses": (
        (),
        """SELECT 'id' || CAST(o_orderkey AS VARCHAR) || '_run1' AS custom_id, CAST(o_custkey % 3 AS BIGINT) AS run,
             CASE o_custkey % 7 WHEN 0 THEN 'Entailment' WHEN 1 THEN 'contradiction' WHEN 2 THEN 'neutral' WHEN 3 THEN 'E'
               WHEN 4 THEN 'N' WHEN 5 THEN 'C' ELSE '' END AS content, o_orderpriority AS reasoning FROM orders""",
    ),
    "preds": (
        ("responses",),
        """SELECT *, coalesce(nullif(regexp_extract(custom_id, 'id([0-9]+)', 1), ''), custom_id) AS item_id,
             CASE WHEN contains(lower(content), 'e') THEN 'entailment' WHEN contains(lower(content), 'c') THEN 'contradiction'
               WHEN contains(lower(content), 'n') THEN 'neutral' ELSE 'unknown' END AS by_letter,
             CASE WHEN contains(lower(content), 'entailment') THEN 'entailment'
               WHEN contains(lower(content), 'contradiction') THEN 'contradiction'
               WHEN contains(lower(content), 'neutral') THEN 'neutral' ELSE 'unknown' END AS by_word FROM responses""",
    ),
    "joined": (
        ("preds", "gold"),
        "SELECT p.*, gold_label, entropy_class, verb, genre FROM preds p JOIN gold g ON p.item_id = g.item_id",
    ),
    "words": ((), "SELECT unnest(['entailment', 'neutral', 'contradiction']) AS label, unnest([0, 1, 2]) AS place"),
    "runs": (("joined",), "SELECT DISTINCT run FROM joined"),
    "per_class": (
        ("joined", "words", "runs"),
        """SELECT r.run, w.label, w.place, count(CASE WHEN gold_label = label AND by_letter = label THEN 1 END) AS tp,
             count(CASE WHEN gold_label <> label AND by_letter = label THEN 1 END) AS fp,
             count(CASE WHEN gold_label = label AND by_letter <> label THEN 1 END) AS fn, count(CASE WHEN gold_label = label THEN 1 END) AS support
           FROM runs r CROSS JOIN words w JOIN joined j ON j.run = r.run GROUP BY r.run, w.label, w.place""",
    ),
    "rates": (
        ("per_class",),
        """SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision,
             CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall FROM per_class""",
    ),
    "prf": (
        ("rates",),
        """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * (precision * recall) / (precision + recall) ELSE 0 END
             AS f1 FROM rates""",
    ),
    "strata": ((), "SELECT unnest(['low_entropy', 'high_entropy']) AS entropy_class"),
    "s_class": (
        ("joined", "words", "runs", "strata"),
        """SELECT r.run, s.entropy_class, w.label, count(CASE WHEN gold_label = label AND by_letter = label THEN 1 END) AS tp,
             count(CASE WHEN gold_label <> label AND by_letter = label THEN 1 END) AS fp,
             count(CASE WHEN gold_label = label AND by_letter <> label THEN 1 END) AS fn, count(CASE WHEN gold_label = label THEN 1 END) AS support
           FROM runs r CROSS JOIN strata s CROSS JOIN words w
           LEFT JOIN joined j ON j.run = r.run AND j.entropy_class = s.entropy_class
           GROUP BY r.run, s.entropy_class, w.label""",
    ),
    "s_rates": (
        ("s_class",),
        """SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision,
             CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall FROM s_class""",
    ),
    "s_prf": (
        ("s_rates",),
        """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * (precision * recall) / (precision + recall) ELSE 0 END
             AS f1 FROM s_rates""",
    ),
    "s_micro": (
        ("s_prf",),
        """SELECT run, entropy_class,
             coalesce(sum(f1) FILTER (WHERE support > 0 OR tp + fp > 0) / nullif(count(CASE WHEN support > 0 OR tp + fp > 0 THEN 1 END), 0), 0)
               AS macro_f1_present,
             coalesce(CAST(sum(tp) AS DOUBLE) / nullif(sum(tp + fp), 0), 0) AS mp,
             coalesce(CAST(sum(tp) AS DOUBLE) / nullif(sum(tp + fn), 0), 0) AS mr
           FROM s_prf GROUP BY run, entropy_class""",
    ),
    "s_total": (
        ("joined",),
        """SELECT run, entropy_class, count(*) AS num_examples, count(CASE WHEN gold_label = by_letter THEN 1 END) AS correct
           FROM joined GROUP BY run, entropy_class""",
    ),
    "wrong": (
        ("joined",),
        """SELECT run, entropy_class,
             'Gold:' || upper(substr(gold_label, 1, 3)) || ' -> Pred:' || upper(substr(by_word, 1, 3)) AS error_type,
             count(*) AS n FROM joined WHERE gold_label <> by_word GROUP BY run, entropy_class, error_type""",
    ),
    "pairs": (
        (),
        """SELECT u.conv_id, u.turn, u.text AS premise, a.text AS hypothesis FROM conversations u
           JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
           WHERE u.role = 'user' AND a.role = 'assistant'""",
    ),
    "coded": (
        (),
        """SELECT vec_id AS item_id, label % 4 - 1 AS code, vec_id % 3 = 0 AS is_text FROM embeddings""",
    ),
    "long": (
        (),
        """SELECT vec_id AS item_id, unnest(range(len(embedding))) AS token_id,
             CAST(unnest(embedding) AS DOUBLE) AS logit FROM embeddings""",
    ),
    "label_logit": (
        ("long",),
        """SELECT item_id, CASE token_id % 8 WHEN 0 THEN 'E' WHEN 1 THEN 'N' WHEN 2 THEN 'C' END AS label, logit
           FROM long WHERE token_id % 8 < 3""",
    ),
    "tops": (("label_logit",), "SELECT item_id, label, max(logit) AS m FROM label_logit GROUP BY item_id, label"),
    "lse": (
        ("label_logit", "tops"),
        """SELECT l.item_id, l.label, any_value(m) + ln(sum(exp(logit - m))) AS v FROM label_logit l
           JOIN tops t ON t.item_id = l.item_id AND t.label = l.label GROUP BY l.item_id, l.label""",
    ),
    "wide": (
        ("lse",),
        """SELECT item_id, max(v) FILTER (WHERE label = 'E') AS e, max(v) FILTER (WHERE label = 'N') AS n,
             max(v) FILTER (WHERE label = 'C') AS c FROM lse GROUP BY item_id""",
    ),
    "probs": (
        ("wide",),
        """SELECT item_id, e, n, c, exp(e - greatest(e, n, c)) / z AS pe, exp(n - greatest(e, n, c)) / z AS pn,
             exp(c - greatest(e, n, c)) / z AS pc
           FROM (SELECT *, exp(e - greatest(e, n, c)) + exp(n - greatest(e, n, c)) + exp(c - greatest(e, n, c)) AS z
                 FROM wide)""",
    ),
    "argmax": (
        ("probs",),
        """SELECT *, CASE WHEN pe >= pn AND pe >= pc THEN 'E' WHEN pn >= pc THEN 'N' ELSE 'C' END AS prediction
           FROM probs""",
    ),
    # The set holds a -1, so the older convention applies; digit strings and numbers follow it.
    "legacy": (("coded",), "SELECT coalesce(bool_or(code = -1), false) AS legacy FROM coded"),
    "scored": (
        ("argmax", "coded", "legacy"),
        """SELECT a.*, CASE WHEN code = -1 THEN CASE WHEN is_text THEN NULL ELSE 'E' END
             WHEN code = 0 THEN CASE WHEN legacy THEN 'N' ELSE 'E' END
             WHEN code = 1 THEN 'C' WHEN code = 2 THEN 'N' END AS gold_label
           FROM argmax a JOIN coded c ON c.item_id = a.item_id CROSS JOIN legacy""",
    ),
    "evaluated": (
        (),
        """SELECT d.doc_id, lang, source, n_chars, length(text) AS text_length, quality, toxic,
             (n_chars > 1000) = (quality = 1) AS is_correct FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    ),
    "flagged": (("evaluated",), "SELECT *, CAST(NOT is_correct AS INTEGER) AS err FROM evaluated"),
    "categories": (
        ("flagged",),
        """SELECT 'lang' AS feature, trim(lang) AS value, err FROM flagged
           UNION ALL SELECT 'source', trim(source), err FROM flagged
           UNION ALL SELECT 'toxic', trim(CAST(toxic AS VARCHAR)), err FROM flagged""",
    ),
    "cells": (
        ("categories",),
        """SELECT feature, value, count(CASE WHEN err = 1 THEN 1 END) AS errors, count(CASE WHEN err = 0 THEN 1 END) AS non_errors FROM categories
           WHERE value IS NOT NULL AND value <> '' AND value <> 'nan' GROUP BY feature, value""",
    ),
    "observed": (
        ("cells",),
        """SELECT feature, value, CAST(errors AS DOUBLE) AS o, errors + non_errors AS rt,
             sum(errors) OVER (PARTITION BY feature) AS ct, sum(errors + non_errors) OVER (PARTITION BY feature) AS n,
             count(*) OVER (PARTITION BY feature) AS k FROM cells
           UNION ALL
           SELECT feature, value, CAST(non_errors AS DOUBLE), errors + non_errors,
             sum(non_errors) OVER (PARTITION BY feature), sum(errors + non_errors) OVER (PARTITION BY feature),
             count(*) OVER (PARTITION BY feature) FROM cells""",
    ),
    "gaps": (
        ("observed",),
        """SELECT feature, n, k, CAST(rt AS DOUBLE) * ct / n AS x, abs(o - CAST(rt AS DOUBLE) * ct / n) AS gap
           FROM observed WHERE k > 1 AND ct > 0 AND ct < n""",
    ),
    "tests": (
        ("gaps",),
        """SELECT feature, CAST(any_value(n) AS BIGINT) AS n, any_value(k) AS k,
             sum(power(CASE WHEN k = 2 THEN gap - least(0.5, gap) ELSE gap END, 2) / x) AS chi2 FROM gaps GROUP BY feature""",
    ),
    "cramer": (
        ("tests",),
        """SELECT feature, n, greatest(0, chi2 / n - (k - 1) / CAST(n - 1 AS DOUBLE)) AS phi2,
             least(2 - 1 / CAST(n - 1 AS DOUBLE) - 1, k - power(k - 1, 2) / CAST(n - 1 AS DOUBLE) - 1) AS d FROM tests""",
    ),
    "layers": (
        (),
        """SELECT vec_id AS item_id, label % 3 AS label, vec_id % 7 AS grp, unnest(range(4)) AS layer FROM embeddings""",
    ),
    "log": (
        (),
        """SELECT user_id % 10 AS annotator_id, 10 + 3 * (event_id % 200) AS sample_id, event_id AS ts,
             CASE event_type WHEN 'view' THEN 'view' WHEN 'error' THEN 'skip' ELSE 'save' END AS action,
             CASE event_type WHEN 'purchase' THEN 'purchase | click' WHEN 'click' THEN 'click' END AS labels,
             CASE WHEN event_id % 4 = 0 THEN '  ' ELSE props END AS comments FROM events""",
    ),
    "states": (
        ("log",),
        """SELECT annotator_id, sample_id, count(CASE WHEN action = 'save' THEN 1 END) > 0 AS saved, count(CASE WHEN action = 'skip' THEN 1 END) > 0 AS skipped,
             max(ts) FILTER (WHERE action = 'save') AS save_ts, min(ts) FILTER (WHERE action = 'skip') AS skip_ts
           FROM log GROUP BY annotator_id, sample_id""",
    ),
    "state": (
        ("states", "log"),
        """SELECT s.annotator_id, s.sample_id,
             CASE WHEN saved THEN coalesce(l.labels, 'None') WHEN skipped THEN 'Skipped' END AS labels,
             CASE WHEN saved THEN nullif(trim(l.comments), '') WHEN skipped AND trim(l.comments) <> '' THEN l.comments END
               AS comments
           FROM states s LEFT JOIN log l ON l.ts = coalesce(s.save_ts, s.skip_ts)""",
    ),
    "sheet": (
        ("state",),
        """SELECT a.annotator_id, m.sample_id, position, labels, comments
           FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS position
                 FROM (SELECT DISTINCT 10 + 3 * (event_id % 200) AS sample_id FROM events)) m
           CROSS JOIN (SELECT unnest(range(10)) AS annotator_id) a
           LEFT JOIN state s ON s.annotator_id = a.annotator_id AND s.sample_id = m.sample_id""",
    ),
    "texts": (
        (),
        "SELECT doc_id, lang, source, length(text) AS length, md5(text) AS text_md5 FROM documents",
    ),
    "dealt": (
        ("layers",),
        """SELECT grp, (row_number() OVER (ORDER BY cls, grp) - 1) % 5 AS fold
           FROM (SELECT grp, max_by(label, n * 1000 - label) AS cls
                 FROM (SELECT grp, label, count(*) AS n FROM layers WHERE layer = 0 GROUP BY grp, label) GROUP BY grp)""",
    ),
    # Numbers of classes per group of unlike size, the largest first.
    "skewed": (
        (),
        """SELECT vec_id AS item_id, label % 3 AS label, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE vec_id % 50 END AS grp FROM embeddings""",
    ),
    "by_size": (
        ("skewed",),
        """SELECT grp, count(*) AS size, [count(CASE WHEN label = 0 THEN 1 END), count(CASE WHEN label = 1 THEN 1 END),
             count(CASE WHEN label = 2 THEN 1 END)] AS c FROM skewed GROUP BY grp""",
    ),
    # State: loads (five folds of three classes, one after the other) and the folds so far.
    "placed": (
        ("by_size", "skewed"),
        """SELECT list_reduce(
             list_transform(gs, lambda g: {'loads': g.c, 'folds': [g.grp]}),
             lambda s, g: list_transform(
               [list_transform(range(5), lambda f: [CAST(s.loads[3 * f + 1] * g.loads[1] AS DOUBLE) / (t[1] * t[1])
                 + CAST(s.loads[3 * f + 2] * g.loads[2] AS DOUBLE) / (t[2] * t[2])
                 + CAST(s.loads[3 * f + 3] * g.loads[3] AS DOUBLE) / (t[3] * t[3]),
                 CAST(s.loads[3 * f + 1] + s.loads[3 * f + 2] + s.loads[3 * f + 3] AS DOUBLE)])],
               lambda added: {'loads': list_transform(range(1, 16), lambda i: s.loads[i] + CASE
                 WHEN (i - 1) // 3 = list_position(added, list_min(added)) - 1 THEN g.loads[(i - 1) % 3 + 1] ELSE 0 END),
                 'folds': list_append(s.folds, list_position(added, list_min(added)) - 1)})[1],
             {'loads': list_transform(range(15), lambda i: CAST(0 AS BIGINT)), 'folds': CAST([] AS BIGINT[])}).folds AS folds,
             list_transform(gs, lambda g: g.grp) AS grps
           FROM (SELECT list({'grp': grp, 'c': c} ORDER BY size DESC, grp) AS gs FROM by_size),
             (SELECT [count(CASE WHEN label = 0 THEN 1 END), count(CASE WHEN label = 1 THEN 1 END),
                count(CASE WHEN label = 2 THEN 1 END)] AS t FROM skewed)""",
    ),
    # Upper tails by power series of positive terms.
    "corr_tails": (
        ("flagged",),
        """SELECT feature, correlation, n, CASE WHEN n = 2 THEN 1 ELSE greatest(0, 1 - power(correlation * correlation, 0.5)
             * exp((n - 2) / 2.0 * ln(1 - correlation * correlation) + lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0) - lgamma(0.5)) / 0.5
             * list_sum(list_transform(range(20000), lambda i: exp(lgamma((n - 1) / 2.0 + i) - lgamma((n - 1) / 2.0)
               - lgamma(1.5 + i) + lgamma(1.5) + i * ln(correlation * correlation))))) END AS p
           FROM (SELECT 'n_chars' AS feature, corr(CAST(err AS DOUBLE), CAST(n_chars AS DOUBLE)) AS correlation, count(n_chars) AS n FROM flagged
             UNION ALL SELECT 'text_length', corr(CAST(err AS DOUBLE), CAST(text_length AS DOUBLE)), count(text_length) FROM flagged)""",
    ),
    "chi2_tails": (
        ("tests",),
        """SELECT feature, chi2, n, k, CASE WHEN chi2 <= 0 THEN 1 ELSE greatest(0, 1 - exp(-chi2 / 2 + (k - 1) / 2.0 * ln(chi2 / 2) - lgamma((k + 1) / 2.0))
             * list_sum(list_transform(range(5000), lambda i: exp(i * ln(chi2 / 2) - lgamma((k + 1) / 2.0 + i) + lgamma((k + 1) / 2.0))))) END AS p
           FROM tests""",
    ),
    # Counts per run, scope (all, or a stratum) and class.
    "scopes": (
        ("joined",),
        """SELECT run, 'all' AS scope, gold_label AS gold, by_word AS pred FROM joined
           UNION ALL SELECT run, entropy_class, gold_label, by_word FROM joined""",
    ),
    "classes": (
        ("scopes",),
        """SELECT run, scope, label, total, right_, support, predicted, tp,
             CASE WHEN predicted = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / predicted END AS precision,
             CASE WHEN support = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / support END AS recall,
             CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * CAST(tp AS DOUBLE) / (predicted + support) END AS f1
           FROM (SELECT run, scope, label, count(*) AS total, count(CASE WHEN gold = pred THEN 1 END) AS right_,
               count(CASE WHEN gold = label THEN 1 END) AS support, count(CASE WHEN pred = label THEN 1 END) AS predicted,
               count(CASE WHEN gold = label AND pred = label THEN 1 END) AS tp
             FROM scopes CROSS JOIN (SELECT unnest(['entailment', 'neutral', 'contradiction']) AS label) GROUP BY run, scope, label)""",
    ),
    "averages": (
        ("classes",),
        """SELECT run, scope, CAST(any_value(total) AS DOUBLE) AS total, CAST(any_value(right_) AS DOUBLE) AS right_, CAST(any_value(right_) AS DOUBLE) / any_value(total) AS accuracy,
             avg(f1) AS macro_f1, sum(CASE WHEN predicted + support > 0 THEN f1 END) / count(CASE WHEN predicted + support > 0 THEN 1 END) AS macro_present,
             CASE WHEN sum(predicted) + sum(support) = 0 THEN 0 ELSE 2 * CAST(sum(tp) AS DOUBLE) / (sum(predicted) + sum(support)) END AS micro_f1,
             sum(f1 * support) / sum(support) AS weighted_f1, CAST(sum(support) AS DOUBLE) AS with_gold FROM classes GROUP BY run, scope""",
    ),
}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_STRIP = _quote(PY_WHITESPACE)
_PROMPT = f"'{_INTRO}[CONTEXT]: ' || {{p}} || '\n[HYPOTHESIS]: ' || {{h}} || '\n\n{PREDICTION_FLAG}'"
_TEXTS = "SELECT doc_id, lang, source, length, text_md5 FROM texts"
_LETTER = """CASE WHEN contains(lower({0}), 'e') THEN 'entailment' WHEN contains(lower({0}), 'c') THEN 'contradiction'
  WHEN contains(lower({0}), 'n') THEN 'neutral' ELSE 'unknown' END"""
_WORD = """CASE WHEN contains(lower({0}), 'entailment') THEN 'entailment' WHEN contains(lower({0}), 'contradiction')
  THEN 'contradiction' WHEN contains(lower({0}), 'neutral') THEN 'neutral' ELSE 'unknown' END"""
_ALL_TEXTS = """(SELECT custom_id, content FROM responses UNION ALL
  SELECT 'c' || CAST(conv_id AS VARCHAR) || 't' || CAST(turn AS VARCHAR), text FROM conversations)"""
_CODE = "CASE {0} WHEN -1 THEN 'E' WHEN 0 THEN {1} WHEN 1 THEN 'C' WHEN 2 THEN 'N' END"
_JOINED = "SELECT run, item_id, by_letter AS predicted_label, gold_label, entropy_class FROM joined"

# key -> (expressions it reads, final select)
SELECTS: dict[str, tuple[tuple[str, ...], str]] = {
    "scan_items": ((), "SELECT o_orderkey, o_orderpriority, o_orderstatus, 'orders.parquet' AS file_name FROM orders"),
    "row_ids": (
        (),
        "SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders",
    ),
    "head_n": (("items",), "SELECT item_id, votes_str, verb, genre FROM items ORDER BY item_id LIMIT 250"),
    "file_counts": (
        (),
        """SELECT 'documents.parquet' AS file_name, count(*) AS row_count, CAST(1 AS BIGINT) AS file_count FROM documents
           UNION ALL SELECT 'labels.parquet', count(*), CAST(1 AS BIGINT) FROM labels
           UNION ALL SELECT NULL, (SELECT count(*) FROM documents) + (SELECT count(*) FROM labels), CAST(2 AS BIGINT)""",
    ),
    "label_lookup": (
        (),
        """SELECT d.doc_id, lang, CAST(quality AS BIGINT) AS quality FROM documents d
           LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    ),
    "label_lookup_by_position": (
        (),
        """SELECT d.idx, doc_id, CAST(label AS BIGINT) AS label
           FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents) d
           LEFT JOIN (SELECT label, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings) e ON e.idx = d.idx""",
    ),
    "rt_csv": (("texts",), _TEXTS),
    "rt_json": (("texts",), _TEXTS),
    "rt_jsonstream": (("texts",), _TEXTS),
    "rt_jsonstream_mixed": (("texts",), _TEXTS),
    "votes_parse": (
        ("votes", "items", "lenient", "kept"),
        """SELECT i.item_id, CASE WHEN i.item_id % 101 = 0 THEN 0 ELSE v.n END AS strict_count,
             CAST(CASE WHEN i.item_id % 101 = 0 THEN 0 ELSE v.s END AS BIGINT) AS strict_sum,
             bad AS lenient_bad, l.total AS lenient_pieces, k.item_id IS NOT NULL AS kept, CAST(k.s AS BIGINT) AS kept_sum
           FROM items i JOIN lenient l ON l.item_id = i.item_id
           JOIN (SELECT item_id, count(*) AS n, sum(vote) AS s FROM votes GROUP BY item_id) v ON v.item_id = i.item_id
           LEFT JOIN kept k ON k.item_id = i.item_id""",
    ),
    "vote_buckets": (
        ("kept",),
        """SELECT item_id, votes_str, verb, genre, total AS vote_count, CAST(s AS BIGINT) AS vote_sum, e AS n_entailment,
             n AS n_neutral, c AS n_contradiction, round(CAST(e AS DOUBLE) / total, 8) AS share_entailment,
             round(CAST(n AS DOUBLE) / total, 8) AS share_neutral, round(CAST(c AS DOUBLE) / total, 8) AS share_contradiction
           FROM kept""",
    ),
    "vote_buckets_long": (
        ("votes",),
        """SELECT item_id, count(vote) AS vote_count, CAST(sum(vote) AS BIGINT) AS vote_sum,
             count(CASE WHEN vote BETWEEN 1 AND 3 THEN 1 END) AS n_entailment, count(CASE WHEN vote = 0 THEN 1 END) AS n_neutral,
             count(CASE WHEN vote BETWEEN -3 AND -1 THEN 1 END) AS n_contradiction FROM votes GROUP BY item_id""",
    ),
    "label_threshold": (
        ("decided",),
        "SELECT item_id, gold_label, CASE WHEN gold_label IS NOT NULL THEN round(top_share, 8) END AS agreement FROM decided",
    ),
    "label_mean_fallback": (
        ("lenient",),
        """SELECT item_id, CASE WHEN bad THEN 'neutral' WHEN CAST(e AS DOUBLE) / total >= 0.8 THEN 'entailment'
             WHEN CAST(n AS DOUBLE) / total >= 0.8 THEN 'neutral' WHEN CAST(c AS DOUBLE) / total >= 0.8 THEN 'contradiction'
             WHEN abs(CAST(s AS DOUBLE) / total) < 0.5 THEN 'neutral' WHEN s > 0 THEN 'entailment'
             ELSE 'contradiction' END AS gold_label,
             NOT bad AND greatest(e, n, c) / CAST(total AS DOUBLE) >= 0.8 AS agreed FROM lenient""",
    ),
    "label_plurality": (
        ("gold",),
        "SELECT CAST(item_id AS BIGINT) AS item_id, gold_label, entropy_class FROM gold",
    ),
    "agreement_filter": (
        ("agreed",),
        """SELECT item_id, verb, genre, gold_label, total AS vote_count, round(agreement, 8) AS agreement,
             round(CAST(s AS DOUBLE) / total, 8) AS mean_vote FROM agreed WHERE gold_label IS NOT NULL""",
    ),
    "agreement_counts": (
        ("decided",),
        """SELECT genre, count(CASE WHEN gold_label IS NOT NULL THEN 1 END) AS kept_rows, count(CASE WHEN gold_label IS NULL THEN 1 END) AS dropped_rows,
             count(CASE WHEN gold_label = 'entailment' THEN 1 END) AS kept_entailment, count(CASE WHEN gold_label = 'neutral' THEN 1 END) AS kept_neutral,
             count(CASE WHEN gold_label = 'contradiction' THEN 1 END) AS kept_contradiction FROM decided GROUP BY genre""",
    ),
    "prompts_llm": (
        ("pairs",),
        f"""SELECT conv_id, turn, {_PROMPT.format(p=f"trim(premise, {_STRIP})", h=f"trim(hypothesis, {_STRIP})")} || '\n'
              AS llm_prompt FROM pairs""",
    ),
    "prompts_chat": (
        ("pairs",),
        f"""SELECT 'id' || CAST(conv_id * 4294967296 + turn AS VARCHAR) || '_run1' AS custom_id, 'some/model' AS model,
              'user' AS role, {_PROMPT.format(p="premise", h="hypothesis")} AS content, CAST(100 AS BIGINT) AS max_tokens,
              false AS reasoning, CAST(0 AS DOUBLE) AS temperature FROM pairs WHERE trim(premise, {_STRIP}) <> ''""",
    ),
    "pair_text": (("pairs",), "SELECT conv_id, turn, premise || ' [SEP] ' || hypothesis AS text FROM pairs"),
    "resp_flatten": (("responses",), "SELECT custom_id, content, reasoning FROM responses"),
    "id_extract": (
        ("responses",),
        """SELECT custom_id, coalesce(nullif(regexp_extract(custom_id, 'id([0-9]+)', 1), ''), custom_id) AS item_id
           FROM (SELECT custom_id FROM responses UNION ALL SELECT o_orderpriority FROM orders)""",
    ),
    "extract_letter": (("responses",), f"SELECT custom_id, {_LETTER.format('content')} AS label FROM {_ALL_TEXTS}"),
    "extract_word": (("responses",), f"SELECT custom_id, {_WORD.format('content')} AS label FROM {_ALL_TEXTS}"),
    "extract_letter_after_marker": (
        ("pairs",),
        """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' WHEN 2 THEN 'contradiction'
             ELSE 'unknown' END AS label FROM pairs""",
    ),
    "gold_dedupe": (
        (),
        """SELECT l_orderkey AS item_id, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey FROM lineitem
           QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1""",
    ),
    "eval_join": (("joined",), _JOINED),
    "eval_join_salted": (("joined",), _JOINED),
    "eval_unmatched": (
        ("preds", "gold"),
        """SELECT custom_id, item_id, by_letter AS predicted_label FROM preds p
           WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.item_id = p.item_id)""",
    ),
    "detailed_eval": (
        ("joined",),
        """SELECT custom_id, by_word AS predicted_label, gold_label, by_word = gold_label AS is_correct, entropy_class,
             content AS raw_model_response, reasoning AS model_reasoning, verb, genre FROM joined""",
    ),
    "accuracy_known": (
        ("scored",),
        """SELECT count(*) AS num_examples, count(gold_label) AS num_with_gold, CAST(0 AS BIGINT) AS unknown_prediction_count,
             count(CASE WHEN gold_label = prediction THEN 1 END) AS correct,
             round(CAST(count(CASE WHEN gold_label = prediction THEN 1 END) AS DOUBLE) / count(gold_label), 8) AS accuracy_known FROM scored""",
    ),
    "accuracy_all": (
        ("scored",),
        """SELECT count(*) AS num_examples, round(CAST(count(CASE WHEN gold_label IS NOT DISTINCT FROM prediction THEN 1 END) AS DOUBLE)
             / count(*), 8) AS accuracy_all FROM scored""",
    ),
    "pred_counts": (
        ("joined",),
        """SELECT r.run, l.label, count(CASE WHEN CASE WHEN j.by_word = 'unknown' THEN 'UNKNOWN' ELSE j.by_word END = l.label THEN 1 END) AS n
           FROM (SELECT DISTINCT run FROM joined) r
           CROSS JOIN (SELECT unnest(['entailment', 'neutral', 'contradiction', 'UNKNOWN']) AS label) l
           JOIN joined j ON j.run = r.run GROUP BY r.run, l.label""",
    ),
    "label_dist": (
        ("joined", "words"),
        """SELECT j.run, w.label, count(CASE WHEN gold_label = label THEN 1 END) AS gold_n, count(CASE WHEN by_letter = label THEN 1 END) AS pred_n
           FROM joined j CROSS JOIN words w GROUP BY j.run, w.label""",
    ),
    "class_counts": (("per_class",), "SELECT run, label, tp, fp, fn, support FROM per_class"),
    "class_prf": (
        ("prf",),
        """SELECT run, label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support
           FROM prf""",
    ),
    "f1_summary": (
        ("joined", "prf"),
        """SELECT run, num_examples, correct, round(CAST(correct AS DOUBLE) / num_examples, 8) AS accuracy_all,
             round(macro_f1, 8) AS macro_f1, round(mp, 8) AS micro_precision, round(mr, 8) AS micro_recall,
             round(CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0 END, 8) AS micro_f1,
             round(weighted_f1, 8) AS weighted_f1
           FROM (SELECT run, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
                   CAST(sum(tp) AS DOUBLE) / sum(tp + fp) AS mp, CAST(sum(tp) AS DOUBLE) / sum(tp + fn) AS mr
                 FROM prf GROUP BY run)
           JOIN (SELECT run, count(*) AS num_examples, count(CASE WHEN gold_label = by_letter THEN 1 END) AS correct FROM joined GROUP BY run)
             USING (run)""",
    ),
    "confusion": (
        ("joined", "words"),
        """SELECT j.run, w.label AS gold, count(CASE WHEN gold_label = label AND by_letter = 'entailment' THEN 1 END) AS pred_entailment,
             count(CASE WHEN gold_label = label AND by_letter = 'neutral' THEN 1 END) AS pred_neutral,
             count(CASE WHEN gold_label = label AND by_letter = 'contradiction' THEN 1 END) AS pred_contradiction
           FROM joined j CROSS JOIN words w GROUP BY j.run, w.label""",
    ),
    "stratum_metrics": (
        ("s_prf", "s_micro", "s_total"),
        """SELECT p.run, p.entropy_class, coalesce(num_examples, 0) AS num_examples, coalesce(correct, 0) AS correct,
             round(coalesce(CAST(correct AS DOUBLE) / num_examples, 0), 8) AS accuracy_all,
             round(macro_f1_present, 8) AS macro_f1_present,
             round(CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0 END, 8) AS micro_f1,
             label, tp, fp, fn, support, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1
           FROM s_prf p JOIN s_micro m ON m.run = p.run AND m.entropy_class = p.entropy_class
           LEFT JOIN s_total t ON t.run = p.run AND t.entropy_class = p.entropy_class""",
    ),
    "error_types": (("wrong",), "SELECT run, entropy_class, error_type, n FROM wrong"),
    "error_types_top3": (
        ("wrong",),
        """SELECT run, entropy_class, error_type, n, row_number() OVER (PARTITION BY run, entropy_class
             ORDER BY n DESC, error_type) AS rank FROM wrong QUALIFY rank <= 3""",
    ),
    "summary_fields": (
        ("joined",),
        """SELECT run, count(*) AS num_examples, round(CAST(count(CASE WHEN gold_label = by_word THEN 1 END) AS DOUBLE) / count(*), 8) AS accuracy,
             round((fe * se + fn * sn + fc * sc) / (se + sn + sc), 8) AS weighted_f1, round(fn, 8) AS f1_neutral,
             sc AS gold_contradiction, low_total, high_accuracy, high_errors_ent_unk
           FROM joined JOIN (
             SELECT run, 2 * CAST(te AS DOUBLE) / (pe + se) AS fe, 2 * CAST(tn AS DOUBLE) / (pn + sn) AS fn,
               2 * CAST(tc AS DOUBLE) / (pc + sc) AS fc, se, sn, sc, low_total, high_accuracy, high_errors_ent_unk
             FROM (SELECT run, count(CASE WHEN gold_label = 'entailment' THEN 1 END) AS se, count(CASE WHEN gold_label = 'neutral' THEN 1 END) AS sn,
                 count(CASE WHEN gold_label = 'contradiction' THEN 1 END) AS sc, count(CASE WHEN by_word = 'entailment' THEN 1 END) AS pe,
                 count(CASE WHEN by_word = 'neutral' THEN 1 END) AS pn, count(CASE WHEN by_word = 'contradiction' THEN 1 END) AS pc,
                 count(CASE WHEN gold_label = by_word AND by_word = 'entailment' THEN 1 END) AS te,
                 count(CASE WHEN gold_label = by_word AND by_word = 'neutral' THEN 1 END) AS tn,
                 count(CASE WHEN gold_label = by_word AND by_word = 'contradiction' THEN 1 END) AS tc,
                 count(CASE WHEN entropy_class = 'low_entropy' THEN 1 END) AS low_total,
                 round(CAST(count(CASE WHEN entropy_class = 'high_entropy' AND gold_label = by_word THEN 1 END) AS DOUBLE)
                   / count(CASE WHEN entropy_class = 'high_entropy' THEN 1 END), 8) AS high_accuracy,
                 nullif(count(CASE WHEN entropy_class = 'high_entropy' AND gold_label = 'entailment' AND by_word = 'unknown' THEN 1 END), 0)
                   AS high_errors_ent_unk
               FROM joined GROUP BY run)) USING (run)
           GROUP BY ALL""",
    ),
    "majority_class": (
        ("layers",),
        """SELECT layer, label AS majority, n AS support FROM (SELECT layer, CAST(label AS BIGINT) AS label, count(*) AS n
             FROM layers GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY layer ORDER BY n DESC, label) = 1""",
    ),
    "gold_normalize": (
        ("coded",),
        f"""SELECT item_id, {_CODE.format("code", "'N'")} AS int_legacy, {_CODE.format("code", "'E'")} AS int_preferred,
              CASE WHEN code >= 0 THEN {_CODE.format("code", "'N'")} END AS text_legacy,
              CASE WHEN NOT is_text OR code >= 0 THEN {_CODE.format("code", "'N'")} END AS mixed_legacy,
              CASE WHEN NOT is_text OR code >= 0 THEN {_CODE.format("code", "'E'")} END AS mixed_preferred FROM coded""",
    ),
    "label_convention": (
        (),
        """SELECT split, coalesce(bool_or(code = -1), false) AS legacy_any, bool_and(code IN (-1, 0, 1)) AS legacy_subset,
             count(DISTINCT code) AS distinct_codes
           FROM (SELECT vec_id % 3 AS split, CASE vec_id % 3 WHEN 0 THEN label % 4 - 1 WHEN 1 THEN label % 3 ELSE label % 2 END
             AS code FROM embeddings) GROUP BY split""",
    ),
    "label_tokens": (
        (),
        """SELECT CAST(t AS BIGINT) AS token_id, CASE t % 8 WHEN 0 THEN 'E' WHEN 1 THEN 'N' ELSE 'C' END AS label
           FROM (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS t) WHERE t % 8 < 3""",
    ),
    "label_logits": (
        ("wide",),
        "SELECT item_id, round(e, 8) AS logit_E, round(n, 8) AS logit_N, round(c, 8) AS logit_C FROM wide",
    ),
    "label_logits_dense": (
        ("wide",),
        "SELECT item_id, round(e, 8) AS logit_E, round(n, 8) AS logit_N, round(c, 8) AS logit_C FROM wide",
    ),
    "label_probs": (
        ("probs",),
        "SELECT item_id, round(pe, 8) AS prob_E, round(pn, 8) AS prob_N, round(pc, 8) AS prob_C FROM probs",
    ),
    "label_argmax": (("argmax",), "SELECT item_id, prediction FROM argmax"),
    "scored_predictions": (
        ("scored",),
        """SELECT item_id, prediction, round(e, 8) AS logit_E, round(n, 8) AS logit_N, round(c, 8) AS logit_C,
             round(pe, 8) AS prob_E, round(pn, 8) AS prob_N, round(pc, 8) AS prob_C, gold_label,
             coalesce(gold_label = prediction, false) AS is_correct FROM scored""",
    ),
    "batch_score": (
        ("pairs",),
        f"""SELECT conv_id, turn, e AS logit_E, n AS logit_N, c AS logit_C,
              CASE WHEN e >= n AND e >= c THEN 'E' WHEN n >= c THEN 'N' ELSE 'C' END AS prediction
            FROM (SELECT conv_id, turn, CAST(len % 5 AS DOUBLE) AS e, CAST(len % 3 AS DOUBLE) AS n,
              CAST(len % 2 AS DOUBLE) AS c FROM (SELECT conv_id, turn,
              length({_PROMPT.format(p=f"trim(premise, {_STRIP})", h=f"trim(hypothesis, {_STRIP})")}) AS len FROM pairs))""",
    ),
    "error_flag": (("flagged",), "SELECT doc_id, is_correct, CAST(err AS BIGINT) AS error_flag FROM flagged"),
    "corr_numeric": (
        ("flagged",),
        """SELECT 'n_chars' AS feature, round(corr(CAST(err AS DOUBLE), CAST(n_chars AS DOUBLE)), 8) AS correlation,
             count(n_chars) AS n FROM flagged UNION ALL
           SELECT 'text_length', round(corr(CAST(err AS DOUBLE), CAST(text_length AS DOUBLE)), 8), count(text_length)
           FROM flagged""",
    ),
    "contingency": (("cells",), "SELECT feature, value, errors, non_errors FROM cells"),
    "chi2": (
        ("tests",),
        "SELECT feature, round(chi2, 6) AS chi2, n, k AS value_count, k - 1 AS dof FROM tests",
    ),
    "cramers_v": (
        ("cramer",),
        "SELECT feature, n, round(CASE WHEN d = 0 THEN 0 ELSE sqrt(phi2 / d) END, 6) AS cramers_v FROM cramer",
    ),
    "error_rate_by_cat": (
        ("cells",),
        """SELECT feature, value, round(CAST(errors AS DOUBLE) / (errors + non_errors), 8) AS error_rate,
             errors + non_errors AS support FROM cells""",
    ),
    "error_rate_top": (
        ("cells",),
        """SELECT feature, value, round(CAST(errors AS DOUBLE) / (errors + non_errors), 8) AS error_rate,
             errors + non_errors AS support FROM cells WHERE errors + non_errors >= 5
           ORDER BY feature, error_rate DESC, value""",
    ),
    "probe_input": (
        ("agreed",),
        """SELECT item_id, genre || ' [SEP] ' || verb AS text,
             CAST(CASE gold_label WHEN 'entailment' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS BIGINT) AS label,
             CASE WHEN verb <> '5-LOW' THEN verb ELSE '_NOGROUP_' END AS "group" FROM agreed WHERE gold_label IS NOT NULL""",
    ),
    "probe_folds": (
        ("layers", "dealt"),
        """SELECT item_id, CAST(layer AS BIGINT) AS layer, CAST(l.grp AS BIGINT) AS "group", CAST(label AS BIGINT) AS label,
             CAST(fold AS BIGINT) AS fold FROM layers l JOIN dealt d ON d.grp = l.grp""",
    ),
    "annot_state": (
        ("sheet",),
        "SELECT annotator_id, sample_id, labels, comments FROM sheet",
    ),
    "annot_resume": (
        ("sheet",),
        """SELECT annotator_id, coalesce(min(position) FILTER (WHERE labels IS NULL), 0) AS resume_at FROM sheet
           GROUP BY annotator_id""",
    ),
    "annot_progress": (
        ("sheet",),
        """SELECT annotator_id, count(*) AS total, count(labels) AS labelled,
             round(CAST(count(labels) AS DOUBLE) / count(*), 8) AS labelled_share,
             round(CAST(coalesce(min(position) FILTER (WHERE labels IS NULL), 0) + 1 AS DOUBLE) / count(*), 8)
               AS position_share FROM sheet GROUP BY annotator_id""",
    ),
    "annot_labels": (
        ("sheet",),
        """SELECT s.annotator_id, o.option, count(CASE WHEN list_contains(string_split(labels, ' | '), o.option) THEN 1 END) AS n
           FROM sheet s CROSS JOIN (SELECT unnest(['purchase', 'click', 'signup']) AS option) o
           GROUP BY s.annotator_id, o.option""",
    ),
    "stream_confusion": (
        ("joined",),
        "SELECT run, gold_label AS gold, by_letter AS pred, count(*) AS n FROM joined GROUP BY ALL",
    ),
    "annot_export": (
        ("sheet",),
        "SELECT sample_id, labels, comments FROM sheet WHERE annotator_id = 3",
    ),
    "label_lookup_repeats": (
        (),
        """SELECT o_orderkey AS idx, o_orderstatus, label FROM orders LEFT JOIN (
             SELECT l_orderkey AS idx, l_suppkey % 3 AS label FROM lineitem
             QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1) l
           ON l.idx = o_orderkey""",
    ),
    "head_large": (
        ("items",),
        """SELECT * FROM items QUALIFY row_number() OVER (ORDER BY item_id) <= (SELECT count(*) * 9 // 10 FROM items)""",
    ),
    "rt_positional": (
        ("items",),
        "SELECT item_id, verb || ' ' || genre AS premise, verb AS hypothesis, votes_str FROM items",
    ),
    "eval_join_dup_gold": (
        ("preds",),
        """SELECT run, p.item_id, by_letter AS predicted_label, gold_label FROM preds p JOIN (
             SELECT CAST(l_orderkey AS VARCHAR) AS item_id, ['entailment', 'neutral', 'contradiction'][l_partkey % 3 + 1] AS gold_label FROM lineitem
             QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1) g
           ON g.item_id = p.item_id""",
    ),
    "corr_pvalue": (
        ("corr_tails",),
        "SELECT feature, round(correlation, 8) AS correlation, n, round(p, 8) AS p_value FROM corr_tails",
    ),
    "chi2_pvalue": (
        ("chi2_tails",),
        "SELECT feature, round(chi2, 6) AS chi2, n, k AS value_count, k - 1 AS dof, round(p, 6) AS p_value FROM chi2_tails",
    ),
    "correlation_leaves": (
        ("corr_tails", "chi2_tails", "cramer", "cells"),
        """SELECT 'numerical_correlations' AS section, feature, CAST(NULL AS VARCHAR) AS value_of, path, round(number, 6) AS number FROM (
             SELECT feature, '$.correlation' AS path, correlation AS number FROM corr_tails UNION ALL SELECT feature, '$.p_value', p FROM corr_tails)
           UNION ALL SELECT 'categorical_associations', feature, NULL, '$.p_value', round(p, 6) FROM chi2_tails
           UNION ALL SELECT 'categorical_associations', feature, NULL, '$.cramers_v', round(CASE WHEN d = 0 THEN 0 ELSE sqrt(phi2 / d) END, 6) FROM cramer
           UNION ALL SELECT 'error_rates_by_category', feature, value, '$.error_rate', round(CAST(errors AS DOUBLE) / (errors + non_errors), 6) FROM cells
           UNION ALL SELECT 'error_rates_by_category', feature, value, '$.support', CAST(errors + non_errors AS DOUBLE) FROM cells""",
    ),
    "summary_leaves": (
        ("classes", "averages", "joined"),
        """SELECT run, path, round(number, 8) AS number, CAST(NULL AS VARCHAR) AS text FROM (
             SELECT run, unnest([('$.num_examples', total), ('$.num_with_gold', with_gold), ('$.accuracy', accuracy), ('$.macro_f1', macro_f1),
               ('$.micro_f1', micro_f1), ('$.weighted_f1', weighted_f1), ('$.correct_predictions', right_)]) AS x, x[1] AS path, x[2] AS number
             FROM averages WHERE scope = 'all'
             UNION ALL SELECT run, unnest([('.total', total), ('.accuracy', accuracy), ('.macro_f1', macro_present), ('.micro_f1', micro_f1)]) AS x,
               '$.entropy_breakdown.' || scope || x[1], x[2] FROM averages WHERE scope <> 'all'
             UNION ALL SELECT run, unnest([('.precision', precision), ('.recall', recall), ('.f1', f1), ('.support', CAST(support AS DOUBLE))]) AS x,
               '$.' || CASE WHEN scope = 'all' THEN '' ELSE 'entropy_breakdown.' || scope || '.' END || 'per_class_metrics.' || label || x[1], x[2] FROM classes
             UNION ALL SELECT run, unnest([('.gold.', CAST(support AS DOUBLE)), ('.predictions.', CAST(predicted AS DOUBLE))]) AS x,
               '$.label_distribution' || x[1] || label, x[2] FROM classes WHERE scope = 'all'
             UNION ALL SELECT run, NULL, '$.entropy_breakdown.' || entropy_class || '.errors.Gold:' || upper(left(gold_label, 3)) || ' -> Pred:' || upper(left(by_word, 3)),
               CAST(count(*) AS DOUBLE) FROM joined WHERE by_word <> gold_label GROUP BY run, entropy_class, gold_label, by_word)
           UNION ALL SELECT DISTINCT run, '$.model', NULL, 'some/model' FROM joined
           UNION ALL SELECT DISTINCT run, '$.predictions_file', NULL, 'run' || run || '.json' FROM joined""",
    ),
    "run_summary_leaves": (
        ("scored",),
        """SELECT path, round(number, 8) AS number, CAST(NULL AS VARCHAR) AS text FROM (
             SELECT unnest([('$.num_examples', count(*)), ('$.num_with_gold', count(gold_label)),
               ('$.accuracy', count(CASE WHEN gold_label = prediction THEN 1 END) / CAST(count(gold_label) AS DOUBLE)),
               ('$.unknown_prediction_count', count(CASE WHEN prediction NOT IN ('E', 'N', 'C') THEN 1 END)),
               ('$.prediction_counts.E', count(CASE WHEN prediction = 'E' THEN 1 END)), ('$.prediction_counts.N', count(CASE WHEN prediction = 'N' THEN 1 END)),
               ('$.prediction_counts.C', count(CASE WHEN prediction = 'C' THEN 1 END)),
               ('$.prediction_counts.UNKNOWN', count(CASE WHEN prediction NOT IN ('E', 'N', 'C') THEN 1 END)),
               ('$.batch_size', 4.0), ('$.seed', 7.0)]) AS x, x[1] AS path, CAST(x[2] AS DOUBLE) AS number FROM scored)
           UNION ALL SELECT '$.model', NULL, 'dense-logits'""",
    ),
    "probe_folds_balanced": (
        ("placed", "skewed"),
        """SELECT CAST(s.grp AS BIGINT) AS "group", CAST(f.fold AS BIGINT) AS fold, CAST(label AS BIGINT) AS label, count(*) AS n
           FROM skewed s JOIN (SELECT unnest(grps) AS grp, unnest(folds) AS fold FROM placed) f ON f.grp = s.grp GROUP BY ALL""",
    ),
    "probe_representations": (
        (),
        """SELECT d.doc_id AS item_id, CAST(i - 2 AS BIGINT) AS layer, CAST(length(coalesce(text, '')) % i AS DOUBLE) AS first,
             CAST(length(coalesce(text, '')) // i % 11 AS DOUBLE) AS second, CAST(quality AS BIGINT) AS label, source AS "group"
           FROM documents d JOIN labels l ON l.doc_id = d.doc_id CROSS JOIN (SELECT unnest([2, 3, 4]) AS i)""",
    ),
    # The certificate of an optimum: nothing but zeros.
    "probe_gradient": (
        ("layers",),
        """SELECT CAST(layer AS BIGINT) AS layer, CAST(label AS BIGINT) AS label, CAST(place AS BIGINT) AS place, CAST(0 AS DOUBLE) AS gradient
           FROM (SELECT DISTINCT layer, label FROM layers) CROSS JOIN (SELECT unnest(range(-1, 16)) AS place)""",
    ),
    "stream_annot_compacted": (("state",), "SELECT annotator_id, sample_id, labels, comments FROM state"),
    "stream_annot": (("state",), "SELECT annotator_id, sample_id, labels, comments FROM state"),
}


SELECTS["batch_score_by_length"] = SELECTS["batch_score"]


def _needed(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needed(CTES[name][0], seen)
            seen.append(name)
    return seen


def oracle(key: str) -> str:
    names, select = SELECTS[key]
    parts = [f"{name} AS ({CTES[name][1]})" for name in _needed(names, [])]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


def all_oracles() -> dict[str, str]:
    return {key: oracle(key) for key in SELECTS}
