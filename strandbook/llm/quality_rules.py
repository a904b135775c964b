"""Quality rules as a learned decision list, in DataFrame functions only.

Features come from one pass over the whole texts. The rules are learned from labelled rows by sequential
covering: each rule is grown as a conjunction of thresholds that maximises the information gain on two
thirds of the labelled documents, pruned on the last third, and kept only while it is precise enough on
that third; the rows that it covers are then taken out. Every step needs only counts by feature, bin and
label, which Spark aggregates over all labelled rows. The list ends up as one Spark ``when`` chain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, checked_broadcast, row_key, unused, words_of

WINDOW = 3
SYMBOLS = "#*$%&|<>"
#: Shares and counts that a rule may test; all follow from the base measures and the word array.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share")


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the FEATURES; the text column is dropped.

    Words are runs without ASCII white space; null texts count as empty and give zeros. Repeated words are
    those inside three-word windows that occur twice or more in the text, the first occurrence included.
    Column names that start with two underscores are used on the way. Rows and other columns stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    df = docs.withColumn("__words", words_of(text)).withColumn("__lines", lines)
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    words, n = F.col("__words"), F.size("__words")
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get(words, i - 1 + k) for k in range(WINDOW))))
    df = df.withColumn("__windows", F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__repeats", F.size("__windows") > F.size(F.array_distinct("__windows")))
    # Windows as (hash, place), sorted: a window repeats if a neighbour has its hash. Their places, sorted again, cover words.
    placed = F.array_sort(F.transform(F.col("__windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__placed", F.when(F.col("__repeats"), placed))
    at = F.col("__placed")
    twice = F.filter(at, lambda x, i: ((i > 0) & (F.get(at, i - 1)["h"] == x["h"])) | (F.get(at, i + 1)["h"] == x["h"]))
    df = df.withColumn("__places", F.array_sort(F.transform(twice, lambda x: x["i"])))
    places = F.col("__places")
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    df = df.withColumn("n_repeat_words", F.when(F.col("__repeats"), covered).otherwise(F.lit(0).cast("bigint")))
    df = df.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    kept_chars = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]++", "")).cast("long")
    df = df.withColumn("n_symbols", kept_chars(SYMBOLS.replace("&", r"\&")))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    df = df.withColumn("__n_lines", F.size("__lines")).withColumn("__upper", kept_chars("A-Z")).withColumn("__digits", kept_chars("0-9")).withColumn("__marks", kept_chars("!?.,;:"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
    df = (
        df.withColumn("mean_word", share("word_chars", "n_words"))
        .withColumn("symbol_share", share("n_symbols", "word_chars"))
        .withColumn("dup_line_share", share("n_dup_lines", "__n_lines"))
        .withColumn("repeat_share", share("n_repeat_words", "n_words"))
        .withColumn("upper_share", share("__upper", "word_chars"))
        .withColumn("digit_share", share("__digits", "word_chars"))
        .withColumn("mark_share", share("__marks", "word_chars"))
    )
    return df.drop(text_col, *(c for c in df.columns if c.startswith("__")))


@dataclass(frozen=True)
class Test:
    """One threshold: feature >= value, or feature < value."""

    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.value if self.above else F.col(self.feature) < self.value


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for test in self.tests:
            out = out & test.column()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{t.feature} {'>=' if t.above else '<'} {t.value:.6g}" for t in self.tests)


def _edges(labelled: DataFrame, bins: int) -> dict[str, list[float]]:
    found = labelled.agg(*(F.percentile_approx(f, [i / bins for i in range(1, bins)], 10_000).alias(f) for f in FEATURES)).first()
    return {f: sorted(set(found[f] or [])) for f in FEATURES}


def _bin(value: Column, edges: list[float]) -> Column:
    """Number of edges at or below the value."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.lit([float(e) for e in edges]), lambda e: e <= value))


def learn_rules(labelled: DataFrame, bins: int = 64, max_rules: int = 8, max_tests: int = 3, least_precision: float = 0.97, least_laplace: float = 0.88, least_cover: int = 10) -> list[Rule]:
    """Rules that reject, in order, learned from rows with FEATURES and a boolean ``good``.

    All labelled rows count; rows whose label is null are left out. Documents are split two to one for
    growing and pruning by a hash of their features. Without rows of both labels there are no rules.
    Ties go to the earlier feature and the lower threshold, so that reruns agree. Only counts by bin
    reach the driver (features x bins rows). On the pruning rows a rule must reach ``least_precision``
    plainly and ``least_laplace`` with one hit and one miss added.
    """
    edges = _edges(labelled, bins)
    binned = labelled.filter("good is not null").select(
        F.col("good"),
        (F.pmod(F.xxhash64(*FEATURES), F.lit(3)) < 2).alias("grow"),
        *FEATURES,
        F.array(*(_bin(F.col(f), edges[f]) for f in FEATURES)).alias("bin"),
    )
    rules: list[Rule] = []

    def counts(rows: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        found: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in FEATURES}
        for r in rows.select("good", F.posexplode("bin").alias("at", "b")).groupBy("at", "b").agg(F.count_if(~F.col("good")).alias("bad"), F.count_if("good").alias("ok")).collect():
            found[FEATURES[r["at"]]][r["b"]] = (r["bad"], r["ok"])
        return found

    def total(rows: DataFrame) -> tuple[int, int]:
        r = rows.agg(F.count_if(~F.col("good")), F.count_if("good")).first()
        return r[0], r[1]

    rest = binned
    while len(rules) < max_rules:
        tests: list[Test] = []
        rows = rest.filter("grow")
        table = counts(rows)
        bad, ok = (sum(v[i] for v in table[FEATURES[0]].values()) for i in (0, 1))
        while len(tests) < max_tests and bad >= least_cover and ok > 0:
            base = math.log2(bad / (bad + ok))
            best: tuple[float, Test, int, int] | None = None
            for f in FEATURES:
                run_bad = run_ok = 0
                for b, edge in enumerate(edges[f]):
                    got = table[f].get(b, (0, 0))
                    run_bad, run_ok = run_bad + got[0], run_ok + got[1]
                    for above, p, n in ((True, bad - run_bad, ok - run_ok), (False, run_bad, run_ok)):
                        if p >= least_cover and (gain := p * (math.log2(p / (p + n)) - base)) > (best[0] if best else 1e-9):
                            best = gain, Test(f, above, edge), p, n
            if best is None:
                break
            tests.append(best[1])
            bad, ok = best[2], best[3]
            rows = rows.filter(best[1].column())
            if ok:
                table = counts(rows)
        if not tests:
            break
        # Prune: the shortest prefix of the tests that does best on the rows held back.
        held = rest.filter("not grow")
        value: tuple[float, int, float, float] | None = None
        for k in range(1, len(tests) + 1):
            p, n = total(held.filter(Rule(tuple(tests[:k]), 0).column()))
            worth = (p - n) / (p + n) if p + n else -1.0
            if value is None or worth > value[0]:
                value = worth, k, (p + 1) / (p + n + 2), p / max(p + n, 1)
        rule = Rule(tuple(tests[: value[1]]), value[2])
        if value[3] < least_precision or rule.precision < least_laplace:
            break
        rules.append(rule)
        rest = rest.filter(~rule.column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """0 where no rule fires, else the number of the first that does, as one ``when`` chain."""
    out = F.lit(0)
    for i in range(len(rules), 0, -1):
        out = F.when(rules[i - 1].column(), i).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """(one row per row of docs: doc_id, row_key, the base measures, FEATURES, base_failed, rule, kept; the rules).

    Learns from labels(doc_id, quality 0/1) on the documents that pass the base rules, since only those
    reach the list. Labels that are null, or that differ for one doc_id, are left out; a label without a
    document as well. Null texts count as empty (and fail the base rules). Repeated rows are judged alike.
    """
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row_key"))
    measured = scratch.keep(with_measures(plain).withColumn("base_failed", base_failed()), "measured")
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    labelled = measured.filter("not base_failed").join(known, "doc_id").select(*FEATURES, (F.col("low") > 0).alias("good"))
    labelled = scratch.keep(labelled, "labelled")
    rules = learn_rules(labelled)
    scratch.drop("labelled")
    judged = measured.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    return judged, rules


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that ``judge`` keeps, with all their columns."""
    judged, _ = judge(docs, labels, id_col, text_col)
    key = unused("__key", docs)
    gone = judged.filter(~F.col("kept")).select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key(id_col, text_col)).join(checked_broadcast(gone, 32), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
