"""Quality rules: learned decision lists (operator 5).

Sequential covering on labelled statistics: rules that recognise rejected texts
are grown condition by condition (best information gain on the growing part),
pruned on the rest, and their covered rows removed, until a new rule is no
longer precise enough. The ordered list is emitted as one Spark conditional
expression.

The list is fitted on at most ``sample`` labelled rows (a documented bound;
those of smallest id hash); statistics and verdicts cover every row. With no
labelled bad row the list is empty and every text is kept. A list has at most
``MAX_RULES`` rules of at most ``MAX_CONDITIONS`` conditions, each threshold one of
``CUTS`` quantiles of the growing rows: bounds of the model, not of the rows judged.

Null texts have no words. Repeated rows are judged each; a label repeated for an id
counts once (the lowest quality). Empty tables give no rules and no rows; a text of
any length is one pass. Columns named ``stats``, ``base_failed`` and ``kept`` are
replaced; others pass through.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskgrid.llm.common import per_text

SYMBOLS = b"#*$%&|<>"
STATS_DDL = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
             "n_repeat_words bigint, n_distinct bigint, n_upper bigint, n_marks bigint")
KEEP = {x: bytes(set(range(256)) - set(s)) for x, s in
        {"symbols": SYMBOLS, "upper": bytes(range(65, 91)), "marks": b"!?"}.items()}
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 64
CONTINUATION = bytes(range(0x80, 0xC0))


def text_stats(data: bytes) -> tuple:
    words = data.split()
    joined = b"".join(words)
    n = len(words)
    repeated = 0
    if n > 3:
        ids: dict = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        m = len(ids)
        two = np.unique(a[:-1] * m + a[1:], return_inverse=True)[1]
        _, inv, cnt = np.unique(two[:-1] * m + a[2:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(cnt[inv] > 1)
        mark = np.zeros(n, bool)
        for k in range(3):
            mark[at + k] = True
        repeated = int(mark.sum())
        distinct = m
    else:
        distinct = len(set(words))
    lines = Counter(x for x in data.split(b"\n") if x.split())
    return (n, len(joined.translate(None, CONTINUATION)), len(data.translate(None, KEEP["symbols"])),
            sum(c - 1 for c in lines.values()), repeated, distinct,
            len(data.translate(None, KEEP["upper"])), len(data.translate(None, KEEP["marks"])))


def with_stats(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    return df.withColumn(out, per_text(F.col(text), STATS_DDL, lambda: text_stats))


def features(s: str = "stats") -> dict[str, Column]:
    """Ratios the rules test; never null."""
    c = lambda k: F.col(f"{s}.{k}").cast("double")
    words = F.greatest(c("n_words"), F.lit(1.0))
    return {"symbols_per_word": c("n_symbols") / words, "repeat_share": c("n_repeat_words") / words,
            "dup_lines_per_word": c("n_dup_lines") / words, "mean_word": c("word_chars") / words,
            "distinct_share": c("n_distinct") / words, "upper_per_word": c("n_upper") / words,
            "marks_per_word": c("n_marks") / words}


def covers(x: np.ndarray, rule) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for j, op, t in rule:
        hit &= x[:, j] > t if op == ">" else x[:, j] <= t
    return hit


def grow(x: np.ndarray, bad: np.ndarray, cuts: int = CUTS):
    rule, x, bad = [], x, bad
    while len(x) and not bad.all() and len(rule) < MAX_CONDITIONS:
        p0 = bad.sum() / len(bad)
        best = (1e-9, None, None)
        for j in range(x.shape[1]):
            for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts))):
                for op in (">", "<="):
                    hit = x[:, j] > t if op == ">" else x[:, j] <= t
                    p = bad[hit].sum()
                    if p and not hit.all():
                        gain = p * (np.log2(p / hit.sum()) - np.log2(p0))
                        if gain > best[0]:
                            best = (gain, (j, op, float(t)), hit)
        if best[1] is None:
            break
        rule.append(best[1])
        x, bad = x[best[2]], bad[best[2]]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.98, max_rules: int = MAX_RULES) -> list:
    """Ordered rules (feature number, operator, threshold); rows any rule covers are rejected."""
    rules = []
    while bad.any() and len(rules) < max_rules:
        part = np.arange(len(x)) % 3 == 2  # pruning rows; the rest grow
        rule = grow(x[~part], bad[~part])
        if not rule:
            break

        def worth(r):
            hit = covers(x[part], r)
            p = bad[part][hit].sum()
            return (2 * p - hit.sum()) / max(hit.sum(), 1)
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = covers(x, rule)
        if not hit.any() or bad[hit].mean() < precision:
            break
        rules.append(rule)
        x, bad = x[~hit], bad[~hit]
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, precision: float = 0.98) -> list:
    """Rules from at most ``sample`` labelled documents, as (feature name, operator, threshold)."""
    chosen = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    named = features()
    # at most ``sample`` short rows, one of each id, so the broadcast and the rows fetched are bounded
    rows = (with_stats(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
            .select("doc_id", F.struct("quality", *[c.alias(k) for k, c in named.items()]).alias("r"))
            .groupBy("doc_id").agg(F.min("r").alias("r")).select("r.*").collect())
    rows.sort(key=lambda r: (*[r[k] for k in named], r["quality"]))
    if not rows:
        return []
    x = np.array([[r[k] for k in named] for r in rows])
    order = np.random.default_rng(0).permutation(len(x))
    bad = np.array([r["quality"] == 0 for r in rows])
    names = list(named)
    return [[(names[j], op, t) for j, op, t in r] for r in learn(x[order], bad[order], precision)]


def verdict(rules, s: str = "stats") -> Column:
    """True (keep) unless a rule of the ordered list covers the row."""
    named, out = features(s), None
    for rule in rules:
        test = None
        for k, op, t in rule:
            c = named[k] > t if op == ">" else named[k] <= t
            test = c if test is None else test & c
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(df: DataFrame, rules, text: str = "text", out: str = "stats") -> DataFrame:
    """``df`` plus ``out`` (statistics), ``base_failed`` and ``kept``."""
    n, rep = F.col(f"{out}.n_words"), F.col(f"{out}.n_repeat_words")
    base = (n < 50) | (100 * rep > 50 * n)
    return (with_stats(df, text, out).withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & verdict(rules, out)))
