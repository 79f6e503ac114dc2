"""Quality rules: text statistics and a learned decision list, in Spark SQL only.

``text_stats`` computes the statistics of every whole text.  ``learn_rules``
grows an ordered list of threshold conjunctions for the class "low quality" by
sequential covering: every rule is grown on two thirds of the labelled rows by
information gain, pruned on the other third, and kept if it is precise enough
there; the rows that it covers then leave, and the next rule is grown.
``verdict`` turns the list into one ordered Spark ``CASE WHEN`` expression.

Defined results: a null or empty text has zero words; a table without labels
(or without one of the classes) gives an empty list, which keeps every text;
repeated rows are judged each on its own; columns of ``docs`` that carry the
name of a statistic are kept as they are, since statistics live in one struct.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut_lineage, fresh, once, text_or_empty, words_of

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: features of the learned rules, as expressions of the statistics struct ``s``
FEATURES = {
    "words": "double(s.n_words)",
    "word_length": "s.word_chars / greatest(s.n_words, 1)",
    "symbols_per_word": "s.n_symbols / greatest(s.n_words, 1)",
    "dup_line_share": "s.n_dup_lines / greatest(s.n_lines, 1)",
    "repeat_share": "s.n_repeat_words / greatest(s.n_words, 1)",
    "distinct_share": "s.n_distinct / greatest(s.n_words, 1)",
    "words_per_line": "s.n_words / greatest(s.n_lines, 1)",
    "stop_share": "s.n_stops / greatest(s.n_words, 1)",
}


def text_stats(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with one more struct column ``out`` of long statistics.

    A word is in a repeated window if one of the three-word windows it belongs
    to occurs twice or more in the text; windows are told apart by the chained
    64-bit XXH64 of their words.
    """
    t, w, h, r, n = fresh(docs, "t_", "w_", "h_", "r_", "lines_")
    keep = [F.col(f"`{c}`") for c in docs.columns]
    step = docs.select(*keep, text_or_empty(text).alias(t))
    step = step.select(*keep, t, words_of(F.col(t)).alias(w), F.filter(
        F.split(F.col(t), "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "").alias(n))
    step = step.select(*keep, t, w, n, F.expr(
        f"CASE WHEN size({w}) >= 3 THEN transform(sequence(0, size({w}) - 3), "
        f"i -> struct(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]) AS h, i AS i)) END").alias(h))
    # only a text in which a window comes back needs its windows in order
    step = step.select(*keep, t, w, n, F.expr(
        f"CASE WHEN size(array_distinct({h}.h)) < size({h}) THEN sort_array({h}) END").alias(r))
    step = step.select(*keep, t, w, n, F.expr(
        f"sort_array(transform(filter({r}, (x, k) -> coalesce(x.h = get({r}, k - 1).h, false) "
        f"OR coalesce(x.h = get({r}, k + 1).h, false)), x -> x.i))").alias(r))
    stats = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.expr(f"aggregate({w}, 0L, (a, x) -> a + length(x))").alias("word_chars"),
        F.regexp_count(F.col(t), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(n) - F.size(F.array_distinct(n))).cast("long").alias("n_dup_lines"),
        F.expr(f"coalesce(aggregate({r}, struct(0L AS n, -3 AS p), "
               "(a, p) -> struct(a.n + least(3, p - a.p) AS n, p AS p), a -> a.n), 0L)").alias("n_repeat_words"),
        F.size(n).cast("long").alias("n_lines"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.expr(f"aggregate({w}, 0L, (a, x) -> a + CASE WHEN length(x) <= 3 THEN 1 ELSE 0 END)").alias("n_stops"),
    )
    return step.select(*keep, once(stats).alias(out))


def base_failed(s: str = "stats", min_words: int = 50, max_repeat: int = 50) -> Column:
    n, rep = F.col(f"{s}.n_words"), F.col(f"{s}.n_repeat_words")
    return (n < min_words) | (100 * rep > max_repeat * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self, s: str) -> str:
        return f"({FEATURES[self.feature].replace('s.', s + '.')}) {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def verdict(rules: list[Rule], s: str = "stats") -> Column:
    """The ordered list as one expression: false at the first rule that fires."""
    if not rules:
        return F.lit(True)
    return F.expr("CASE " + " ".join(
        f"WHEN {' AND '.join(c.sql(s) for c in rule)} THEN false" for rule in rules) + " ELSE true END")


def labelled_sample(labels: DataFrame, max_labelled: int) -> DataFrame:
    """At most ``max_labelled`` labelled ids, by the order of a hash of the id."""
    lab = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("q")).where("id IS NOT NULL AND q IN (0, 1)")
    lab = lab.groupBy("id").agg(F.min("q").alias("q"))
    return lab.orderBy(F.xxhash64("id"), "id").limit(max_labelled)


def learn_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, bins: int = 32,
                max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.95,
                min_support: int = 8) -> list[Rule]:
    """Sequential covering over a bounded sample of labelled rows.

    Only counts by feature and bin (``features x (bins + 1)`` rows) reach the
    driver.  The sample's ids are at most ``max_labelled`` longs, which is the
    proven bound of the one broadcast.
    """
    lab = labelled_sample(labels, max_labelled)
    known = docs.select("doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("id"))
    s = text_stats(known).select("id", "q", F.expr("NOT (stats.n_words < 50 OR 2 * stats.n_repeat_words > stats.n_words)").alias("ok"),
                                 *[F.expr(e.replace("s.", "stats.")).alias(f) for f, e in FEATURES.items()])
    # texts that fail the base rules are decided already; the list learns the rest
    s = cut_lineage(s.where("ok").select("q", (F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(3)) > 0).alias("grow"), *FEATURES))
    qs = [k / bins for k in range(1, bins)]
    edges = s.agg(*[F.percentile_approx(f, F.array(*map(F.lit, qs)), F.lit(10_000)).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(edges[f] or [])) for f in FEATURES}
    left = s
    rules: list[Rule] = []

    def holds(rule: Rule) -> Column:
        return F.expr(" AND ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold!r}D" for c in rule) or "true")

    def counts(rule: Rule) -> dict:
        """(feature, bin) -> (low quality, good) rows of the growing part under ``rule``."""
        binned = [F.struct(F.lit(f).alias("f"), F.expr(
            "size(filter(array({}), e -> {} > e))".format(", ".join(f"{c!r}D" for c in cuts[f]), f) if cuts[f] else "0").alias("b"))
            for f in FEATURES]
        rows = (left.where(F.col("grow") & holds(rule)).select("q", F.explode(F.array(*binned)).alias("x"))
                .groupBy("x.f", "x.b").agg(F.sum(1 - F.col("q")).alias("p"), F.sum("q").alias("n")).collect())
        return {(r["f"], r["b"]): (r["p"], r["n"]) for r in rows}

    for _ in range(max_rules):
        rule: Rule = ()
        for _ in range(max_conditions):
            table = counts(rule)
            one = next(iter(FEATURES))
            p0 = sum(p for (f, _), (p, n) in table.items() if f == one)
            n0 = sum(n for (f, _), (p, n) in table.items() if f == one)
            if p0 < min_support or not n0:
                break
            best, gain = None, 1e-9
            for f in FEATURES:
                below_p = below_n = 0
                for b, cut in enumerate(cuts[f]):
                    p, n = table.get((f, b), (0, 0))
                    below_p, below_n = below_p + p, below_n + n
                    for above, (p, n) in ((True, (p0 - below_p, n0 - below_n)), (False, (below_p, below_n))):
                        if p >= min_support and (g := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain:
                            best, gain = Condition(f, above, cut), g
            if best is None:
                break
            rule += (best,)
        if not rule:
            break
        # prune: the prefix of the conjunction that does best on the other third
        tests = left.where(~F.col("grow")).agg(*[F.struct(
            F.sum(F.when(holds(rule[:k]), 1 - F.col("q")).otherwise(0)).alias("p"),
            F.sum(F.when(holds(rule[:k]), F.col("q")).otherwise(0)).alias("n")).alias(f"k{k}")
            for k in range(1, len(rule) + 1)]).first()
        scored = [((t["p"] - t["n"]) / (t["p"] + t["n"]), -k, t) for k in range(1, len(rule) + 1)
                  if (t := tests[f"k{k}"])["p"]]
        if not scored:
            break
        _, k, t = max(scored, key=lambda x: x[:2])
        if t["p"] < min_precision * (t["p"] + t["n"]) or t["p"] < min_support / 2:
            break
        # a threshold goes half-way between the values on its two sides
        rule = rule[:-k]
        sides = left.agg(*[F.struct(F.max(F.expr(f"CASE WHEN {c.feature} <= {c.threshold!r}D THEN {c.feature} END")).alias("lo"),
                                    F.min(F.expr(f"CASE WHEN {c.feature} > {c.threshold!r}D THEN {c.feature} END")).alias("hi"))
                           .alias(f"c{i}") for i, c in enumerate(rule)]).first()
        rule = tuple(Condition(c.feature, c.above, (x["lo"] + x["hi"]) / 2 if None not in (x := sides[f"c{i}"]) else c.threshold)
                     for i, c in enumerate(rule))
        rules.append(rule)
        left = left.where(~holds(rule))
    return rules


def quality(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """``docs`` with ``stats``, ``base_failed`` and ``kept`` beside its own columns."""
    rules = learn_rules(docs, labels, **params)
    s, bad, kept = fresh(docs, "stats", "base_failed", "kept")
    out = text_stats(docs, out=s).withColumn(bad, base_failed(s))
    return out.withColumn(kept, ~F.col(bad) & verdict(rules, s))
