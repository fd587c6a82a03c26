"""Learned quality rules: a decision list of threshold conjunctions.

Word and line statistics of every document are Spark expressions. From labelled documents, sequential covering grows one
conjunction after another (the threshold of best gain is added until no good document is left in it), prunes it on rows held
out for that, and keeps it while it is precise enough there. The learner sees a table of how many good and bad labelled
documents fall in each cell of the quantile grid, counted by Spark; its rules come out as one ordered Spark conditional
expression.

The rules are fitted on at most LABELLED documents with a label, chosen by hash; every document is judged.

Defined cases: a null text has no words and fails the base rules; a document without a label, or with a null one, teaches
nothing; with several labels every one counts; without labels of both kinds the list is empty and the base rules alone
decide; rows with the same doc_id are each judged; an empty table gives an empty result; other columns are ignored. Windows of
words are compared by a 64-bit hash. Everything is made of DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table, words, written

#: Labelled documents that the rules are fitted on, at most.
LABELLED = 20_000
#: Thresholds tried of each statistic, conditions of a rule, rules, precision that a rule needs on the rows held out.
THRESHOLDS, CONDITIONS, RULES, PRECISION = 40, 4, 12, 0.95
WINDOW = 5
SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "dup_lines_per_word", "repeat_share", "upper_share", "distinct_share")


def _let(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def repeat_words(ws: Column) -> Column:
    """Words that stand in windows of WINDOW words found twice or more in their text."""
    return _let(ws, _repeat_words)  # so that a filter pushed below it doesn't split the text again for every window


def _repeat_words(ws: Column) -> Column:
    n = F.size(ws)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(WINDOW))))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            found = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(found, lambda x: x["i"].cast("long")))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
        return F.aggregate(_let(placed, twice), start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW).cast("long"), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    # most texts repeat no window: their hashes are only counted
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, base statistics and the features of the rules for each row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    d = docs.select(
        "doc_id", words(F.col("text")).alias("ws"), F.char_length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("upper"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    d = d.select("doc_id", F.size("ws").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeat_words(F.col("ws")).alias("n_repeat_words"), "upper", F.size(F.array_distinct("ws")).alias("distinct"))
    per_word = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        per_word("word_chars").alias("mean_word_chars"), per_word("n_symbols").alias("symbols_per_word"), per_word("n_dup_lines").alias("dup_lines_per_word"), per_word("n_repeat_words").alias("repeat_share"),
        F.coalesce(F.col("upper") / F.nullif(F.col("word_chars"), F.lit(0)), F.lit(0.0)).alias("upper_share"), per_word("distinct").alias("distinct_share"),
    )


@dataclass(frozen=True)
class Condition:
    """feature >= value (above) or feature < value."""

    feature: str
    value: float
    above: bool

    def column(self) -> Column:
        return F.col(self.feature) >= self.value if self.above else F.col(self.feature) < self.value


Rule = tuple[Condition, ...]


def grid(sample: DataFrame, features: tuple[str, ...] = FEATURES) -> tuple[dict[str, list[float]], list[tuple]]:
    """Thresholds of each feature and the labelled rows by cell: (cell, held out, bad, good)."""
    cuts = sample.agg(*(F.percentile_approx(f, [i / THRESHOLDS for i in range(1, THRESHOLDS)]).alias(f) for f in features)).first()
    bounds = {f: sorted({float(x) for x in cuts[f] or []}) for f in features}
    cell = [sum((F.when(F.col(f) >= b, 1).otherwise(0) for b in bounds[f]), F.lit(0)).alias(f) for f in features]
    rows = sample.select(*cell, (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), "quality")
    # at most as many rows as the sample has, whose size is bounded
    counted = rows.groupBy(*features, "held").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") != 0).alias("good")).collect()
    return bounds, sorted((tuple(r[f] for f in features), r.held, r.bad, r.good) for r in counted)


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0))) if bad else -math.inf


def learn(bounds: dict[str, list[float]], cells: list[tuple]) -> list[Rule]:
    """Rules in order, each covering bad documents that those before it leave."""
    names = list(bounds)
    rules: list[Rule] = []

    def meets(cell: tuple, rule: tuple) -> bool:
        return all((cell[f] >= k) == above for f, k, above in rule)

    def counts(rows: list[tuple], rule: tuple) -> tuple[int, int]:
        met = [r for r in rows if meets(r[0], rule)]
        return sum(r[2] for r in met), sum(r[3] for r in met)

    def precision(rows: list[tuple], rule: tuple) -> float:
        bad, good = counts(rows, rule)
        return (bad + 1) / (bad + good + 2)

    left = cells
    while len(rules) < RULES:
        grow, held = [r for r in left if not r[1]], [r for r in left if r[1]]
        rule: tuple = ()
        rows = grow
        while len(rule) < CONDITIONS:
            bad0, good0 = sum(r[2] for r in rows), sum(r[3] for r in rows)
            if not bad0 or not good0:
                break
            best = (0.0, None)
            for f, name in enumerate(names):
                sums = [[0, 0] for _ in range(len(bounds[name]) + 1)]
                for cell, _, bad, good in rows:
                    sums[cell[f]][0] += bad
                    sums[cell[f]][1] += good
                bad = good = 0
                for k in range(len(bounds[name]), 0, -1):
                    bad, good = bad + sums[k][0], good + sums[k][1]
                    for above, b, g in ((True, bad, good), (False, bad0 - bad, good0 - good)):
                        if (gain := _gain(b, g, bad0, good0)) > best[0]:
                            best = (gain, (f, k, above))
            if best[1] is None:
                break
            rule = (*rule, best[1])
            rows = [r for r in rows if meets(r[0], (best[1],))]
        while len(rule) > 1 and precision(held, rule[:-1]) >= precision(held, rule):
            rule = rule[:-1]
        bad, good = counts(held, rule)
        if not rule or bad < 3 or bad < PRECISION * (bad + good):
            break
        rules.append(tuple(Condition(names[f], bounds[names[f]][k - 1], above) for f, k, above in rule))
        left = [r for r in left if not meets(r[0], rule)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for documents that no rule rejects: the decision list as an ordered conditional expression."""
    out = None
    for rule in rules:
        met = rule[0].column()
        for condition in rule[1:]:
            met &= condition.column()
        out = F.when(met, False) if out is None else out.when(met, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from at most LABELLED rows of labels (doc_id, quality)."""
    chosen = labels.filter("quality is not null and doc_id is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(LABELLED)
    # bounded by LABELLED
    few = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    sample = written(statistics(few).join(F.broadcast(chosen), "doc_id"), "labelled")
    bounds, cells = grid(sample.filter("not base_failed"))
    return learn(bounds, cells)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of docs with kept: base rules, then the learned list."""
    return statistics(docs).withColumn("kept", ~F.col("base_failed") & verdict(fit(docs, labels)))


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
