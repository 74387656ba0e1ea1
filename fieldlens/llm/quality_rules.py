"""Quality rules as a learned decision list, in DataFrame expressions only.

Statistics of a text are column expressions. Sequential covering learns, from labelled statistics, an ordered list of
threshold conjunctions for low quality: a rule is grown condition by condition on two thirds of the labelled rows
(each step is one grouped count over all features and thresholds), pruned on the other third, kept if it is precise
enough there, and the rows it covers leave. The list becomes one ordered CASE expression. What reaches the driver
is a histogram of features x thresholds per step, whatever the input.

Defined results: a null or empty text has no words (all statistics 0) and fails the base; a document without a label
is judged like any other; without labels of both kinds the list is empty and the base alone decides; repeated rows
are judged alike, and count as often as they occur when rules are learnt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fieldlens.llm.base import BLANK, stored

WINDOW = 5
#: statistic -> expression over the columns of ``measured``
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "log_words": "ln(n_words + 1)",
}
BINS = 48


def _removed(text: str, pattern: str) -> Column:
    """Characters of ``text`` that ``pattern`` matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of every whole text, one row per document. No shuffle, no Python."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = words.select("doc_id", "t", F.expr(rf"filter(split(t, r'{BLANK}'), w -> w <> '')").alias("w"))
    words = words.select("doc_id", "t", "w", F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    words = words.select("doc_id", "t", "w", F.expr(r"filter(split(t, '\n', -1), l -> l rlike r'[^\x20\x09-\x0D]')").alias("lines"), F.expr(
        f"case when size(h) < {WINDOW} then array() else transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({', '.join(f'get(h, i + {k})' for k in range(WINDOW))})) end").cast("array<long>").alias("runs"))
    return words.select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        _removed("t", r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeats().cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), _removed("t", r"\p{Lu}").alias("n_upper"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
    )


def _repeats() -> Column:
    """Words inside a run of five that occurs twice or more.

    Only texts with a repeated run are sorted: runs and their places in hash order, neighbours with an equal hash are
    repeated, and the places in text order give the covered words. n log n for any text.
    """
    return F.expr(f"""
      case when size(runs) = size(array_distinct(runs)) then 0 else
        aggregate(
          transform(array(sort_array(transform(runs, (h, i) -> struct(h, i)))), s ->
            sort_array(transform(filter(sequence(0, size(s) - 1), k -> (k > 0 and s[k - 1].h = s[k].h) or (k < size(s) - 1 and s[k + 1].h = s[k].h)), k -> s[k].i))),
          0, (acc, p) -> acc + aggregate(p, struct(-{WINDOW} as last, 0 as n), (a, x) -> struct(x as last, a.n + least(x - a.last, {WINDOW}) as n), a -> a.n))
      end""")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def text(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


def _all(tests: list[Test]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.column()
    return out


def with_features(stats: DataFrame) -> DataFrame:
    return stats.select("*", *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()])


def learn(stats: DataFrame, label: str, rules: int = 6, conditions: int = 3, precision: float = 0.97, least: int = 20) -> list[list[Test]]:
    """Ordered conjunctions for ``label`` = 0, from rows with ``FEATURES`` and ``label`` 0 or 1."""
    part = F.pmod(F.xxhash64(*sorted(FEATURES)), F.lit(3))
    rows = stats.where(F.col(label).isin(0, 1)).withColumn("__bad", 1 - F.col(label)).withColumn("__grow", part < 2)
    cuts = _cuts(rows)
    if not cuts:
        return []
    binned = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), _bin(n, cuts[n]).alias("b")) for n in cuts])).alias("x")
    rows = stored(rows.select(*cuts, "__bad", "__grow"))
    found: list[list[Test]] = []
    left = F.lit(True)
    for _ in range(rules):
        tests: list[Test] = []
        for _ in range(conditions):
            seen = rows.where("__grow").where(left & _all(tests)).select("__bad", binned)
            counts = {(r["f"], r["b"]): (r["bad"], r["n"]) for r in seen.groupBy("x.f", "x.b").agg(F.sum("__bad").alias("bad"), F.count("*").alias("n")).collect()}
            best = _best(counts, cuts, least)
            if best is None or (tests and best[0] <= _rate(counts, next(iter(cuts)))):
                break
            tests.append(best[1])
            if best[0] >= 0.999:
                break
        tests = _prune(rows.where("not __grow").where(left), tests, precision, least)
        if not tests:
            break
        found.append(tests)
        left = left & ~_all(tests)
    return found


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Thresholds: quantiles of each feature over the labelled rows, low and high quality apart."""
    at = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    got = rows.groupBy("__bad").agg(*[F.percentile_approx(n, at, 2000).alias(n) for n in FEATURES]).collect()
    if len(got) < 2:
        return {}
    return {n: sorted({float(v) for r in got for v in r[n] or []}) for n in FEATURES}


def _bin(name: str, cuts: list[float]) -> Column:
    """Number of thresholds below the value."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(name)))


def _rate(counts: dict, feature: str) -> float:
    bad = sum(b for (f, _), (b, _) in counts.items() if f == feature)
    return bad / max(1, sum(n for (f, _), (_, n) in counts.items() if f == feature))


def _best(counts: dict, cuts: dict[str, list[float]], least: int) -> tuple[float, Test] | None:
    """The test with the largest information gain over the rows still covered (bad rows it covers x log precision ratio)."""
    import math

    best = None
    for name, own in cuts.items():
        cells = [counts.get((name, b), (0, 0)) for b in range(len(own) + 1)]
        bad, n = sum(c[0] for c in cells), sum(c[1] for c in cells)
        if not bad or n < least:
            continue
        low = [0, 0]
        for k, threshold in enumerate(own):
            low = [low[0] + cells[k][0], low[1] + cells[k][1]]
            for above, (b, m) in ((False, low), (True, (bad - low[0], n - low[1]))):
                if m >= least and b:
                    gain = b * (math.log2((b + 1e-9) / m) - math.log2(bad / n))
                    if gain > 1e-9 and (best is None or gain > best[2]):
                        best = (b / m, Test(name, above, threshold), gain)
    return best and best[:2]


def _prune(rows: DataFrame, tests: list[Test], precision: float, least: int) -> list[Test]:
    """The shortest beginning of the rule that is precise enough on rows it was not grown on; none if no beginning is."""
    if not tests:
        return []
    got = rows.agg(*[x for k in range(1, len(tests) + 1) for x in (
        F.count(F.when(_all(tests[:k]), 1)).alias(f"n{k}"), F.sum(F.when(_all(tests[:k]), F.col("__bad"))).alias(f"b{k}"))]).collect()[0]
    for k in range(1, len(tests) + 1):
        if got[f"n{k}"] >= least // 4 and got[f"b{k}"] >= precision * got[f"n{k}"]:
            return tests[:k]
    return []


def as_case(rules: list[list[Test]]) -> Column:
    """1-based number of the first rule that holds, 0 when none does."""
    if not rules:
        return F.lit(0)
    return F.expr("case " + " ".join(f"when {' and '.join(t.text().replace('inf', 'double(\"inf\")') for t in tests)} then {k}" for k, tests in enumerate(rules, 1)) + " else 0 end")


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", **options) -> DataFrame:
    """doc_id, the base statistics, ``base_failed``, ``kept`` and ``rule`` (0: none) of every document."""
    stats = stored(with_features(measured(docs, doc_id, text)))
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("__label")).where("__label in (0, 1) and doc_id is not null")
    rules = learn(stats.join(marked, "doc_id"), "__label", **options)
    return stats.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")).withColumn("rule", as_case(rules).cast("int")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
