"""Quality rules: an ordered decision list, learned by sequential covering.

Statistics are worked out once per text and written. A rule is a conjunction of thresholds on them;
it is grown on two thirds of the labelled rows still uncovered, pruned on the other third, kept if it
is precise enough there, and its rows leave before the next is grown. The rules become one Spark
conditional expression, which decides every document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import batches, fewest, row_id, shown_id, texts, written
from tenderloom.llm.stats import COUNTS, SHARES, measure

FEATURES = SHARES
STATS = (
    "did long, th int, "
    + ", ".join(f"{c} long" for c in COUNTS)
    + ", "
    + ", ".join(f"{c} double" for c in SHARES)
)
# Labelled rows that the list is learned from at most: those with the smallest hash of their id.
FIT_ROWS = 20_000
SEED = 20_24


@dataclass(frozen=True)
class Test:
    __test__ = False

    feature: str
    above: bool
    limit: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x > self.limit if self.above else x <= self.limit

    def column(self) -> Column:
        x = F.col(self.feature)
        return x > F.lit(self.limit) if self.above else x <= F.lit(self.limit)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


@dataclass(frozen=True)
class Rule:
    """Reject where all tests hold."""

    tests: tuple[Test, ...]

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([t.holds(table) for t in self.tests])

    def column(self) -> Column:
        out = self.tests[0].column()
        for test in self.tests[1:]:
            out = out & test.column()
        return out

    def __str__(self) -> str:
        return "reject if " + " and ".join(map(str, self.tests))


def statistics(docs: DataFrame) -> DataFrame:
    """``STATS`` of every row. Nothing is shuffled and a text stays in its task."""

    def run(frames):
        for batch, data in batches(frames, "data"):
            rows = [measure(x) for x in data]
            arrays = [batch.column("did"), batch.column("th")]
            arrays += [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
            arrays += [pa.array([r[1][i] for r in rows], pa.float64()) for i in range(len(SHARES))]
            yield pa.RecordBatch.from_arrays(arrays, ["did", "th", *COUNTS, *SHARES])

    return texts(docs).mapInArrow(run, STATS)


def labelled(stats: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """The statistics and labels of at most ``rows`` labelled documents."""
    good = (
        labels.where(F.col("quality").isNotNull())
        .groupBy(row_id().alias("did"))
        .agg(F.min("quality").alias("label"))
    )
    chosen = fewest(stats.join(good, "did"), rows, SEED, "th").select("label", *FEATURES).toPandas()
    return {c: chosen[c].to_numpy() for c in chosen.columns}


def _gain(table, bad, open_, rule_pos, rule_neg):
    """The best next test by FOIL's gain over the rows still in the rule."""
    best, best_gain = None, 1e-9
    before = math.log2(rule_pos / (rule_pos + rule_neg))
    for name in FEATURES:
        x, y = table[name][open_], bad[open_]
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        cuts = np.flatnonzero(x[1:] > x[:-1])
        if not len(cuts):
            continue
        pos = np.cumsum(y)[cuts].astype(float)
        all_ = cuts + 1.0
        for above in (False, True):
            p = rule_pos - pos if above else pos
            n = (rule_pos + rule_neg - all_) - p if above else all_ - p
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), 0.0)
            at = int(np.argmax(gain))
            if gain[at] > best_gain:
                lo, hi = float(x[cuts[at]]), float(x[cuts[at] + 1])
                middle = lo + (hi - lo) / 2
                best, best_gain = Test(name, above, middle if lo <= middle < hi else lo), gain[at]
    return best


def learn(
    table: dict[str, np.ndarray],
    precision: float = 0.9,
    least_rows: int = 5,
    most_tests: int = 4,
    most_rules: int = 24,
) -> list[Rule]:
    """Rules for label 0, in the order they were found. No rows, or one label only: no rules.

    A rule must cover ``least_rows`` labelled rows, of which a share of ``precision`` has label 0
    both where it was grown and where it was pruned; the list ends with the first that doesn't.
    """
    bad = table["label"] == 0 if len(table.get("label", ())) else np.zeros(0, bool)
    prune_part = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules and (bad & left & ~prune_part).sum() >= least_rows:
        inside, tests = left & ~prune_part, []
        while len(tests) < most_tests:
            pos, neg = int((bad & inside).sum()), int((~bad & inside).sum())
            if not neg or not pos:
                break
            test = _gain(table, bad, inside, pos, neg)
            if test is None:
                break
            tests.append(test)
            inside &= test.holds(table)
        if not tests:
            break

        def worth(rule: Rule) -> float:
            hit = rule.holds(table) & left & prune_part
            pos, neg = int((bad & hit).sum()), int((~bad & hit).sum())
            return (pos - neg / (1 - precision) * precision) / (1 + pos + neg)

        rule = max((Rule(tuple(tests[:i])) for i in range(len(tests), 0, -1)), key=worth)
        hit = rule.holds(table) & left
        for part in (hit & prune_part, hit & ~prune_part):
            if not part.sum() or bad[part].mean() < precision:
                rule = None
                break
        if rule is None or hit.sum() < least_rows:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Whether the list keeps a row, and the number of the rule that rejects it (0: none)."""
    number = F.lit(0)
    for i in range(len(rules), 0, -1):
        number = F.when(rules[i - 1].column(), F.lit(i)).otherwise(number)
    return number == 0, number


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Every row of ``docs`` with its statistics, ``base_failed``, ``kept`` and ``rule``.

    A null or empty text has no words and so fails the base; a null id stays null and its row is
    judged like any other; repeated rows are judged each; a document with several labels counts with
    the smallest; without labels only the base decides; an empty table gives an empty one.
    """
    stats = written(statistics(docs), "rules-stats")
    rules = learn(labelled(stats, labels), **settings)
    good, number = verdict(rules)
    return stats.withColumns({"base_failed": base_failed(), "rule": number}).withColumn(
        "kept", ~F.col("base_failed") & good
    )


def quality_rules(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``judged`` in the form of a report, one row per document."""
    return judged(docs, labels, **settings).select(
        shown_id().alias("doc_id"), *COUNTS, "base_failed", "kept", "rule",
    )


def kept_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    fine = judged(docs, labels, **settings).where("kept").select("did", "th").distinct()
    fine = fine.withColumnsRenamed({"did": "__did", "th": "__th"})
    text = F.coalesce(F.col("text"), F.lit(""))
    on = (row_id() == F.col("__did")) & (F.hash(text) == F.col("__th"))
    return docs.join(fine, on, "left_semi")
