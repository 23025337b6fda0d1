"""Quality rules: a decision list learned from labelled documents (native).

Sequential covering: conditions `statistic <= t` or `statistic > t` are added to a rule one at a
time by the information they gain on the growing part of the labelled rows, the rule is pruned on
the other part, what it covers is set aside, and the next rule is grown on the rest. The finished
list is a chain of Spark conditional expressions. Counts for every candidate condition come from one
aggregation per step; the driver sees a table of (statistic, bin) counts of fixed size.

Defined results: null and empty texts have all statistics 0 and fail the base rule (under 50 words);
repeated rows are judged alike, one by one; extra columns are ignored by `statistics` and kept by
`judged`; labels that are null or whose document is missing are not used, several labels of a
document count as its lowest; with no usable labels the list is empty and only the base rule rejects.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .words import SPACES, count_of, whole, words

#: Labelled rows that the list is fitted on, at most; those with the smallest hash of doc_id.
FIT_ROWS = 20_000
BINS = 24
MAX_RULES = 8
MAX_CONDITIONS = 3
#: A rule must be right on this share of what it rejects among the pruning rows.
MIN_PRECISION = 0.9
#: Comparisons of windows with repeated ones up to which a text's repeated windows are looked up.
LOOKUPS = 10_000_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("word_len", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share")


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. w: a column, not an expression."""
    n = F.size(w)
    keys = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def next_to(s: Column) -> Column:
        """Elements that the one after them equals."""
        return F.filter(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.when(a == b, a)), lambda k: k.isNotNull())

    def by_lookup(keys: Column, found: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: F.array_contains(found, keys[i]))

    def by_order(keys: Column) -> Column:
        def starts(pairs: Column) -> Column:
            m = F.size(pairs)
            same = F.zip_with(F.slice(pairs, 2, m - 1), F.slice(pairs, 1, m - 1), lambda b, a: b["k"] == a["k"])
            edge = F.array(F.lit(False))
            return _let(same, lambda e: F.sort_array(F.filter(
                F.zip_with(pairs, F.zip_with(F.concat(edge, e), F.concat(e, edge), lambda l, r: l | r), lambda p, hit: F.when(hit, p["i"])),
                lambda i: i.isNotNull())))

        return _let(F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), starts)

    def covered(keys: Column) -> Column:
        # few repeated windows are looked up, many are found by sorting: the same places
        at = _let(F.array_distinct(next_to(F.sort_array(keys))), lambda d: F.when(F.size(d).cast("long") * F.size(keys) <= LOOKUPS, by_lookup(keys, d)).otherwise(by_order(keys)))
        return _let(at, lambda at: F.aggregate(
            F.zip_with(F.slice(at, 2, F.size(at) - 1), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(F.lit(3), b - a)),
            F.lit(3), lambda s, x: s + x))

    return F.when(n < 4, 0).otherwise(_let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(covered(k)))).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and, as longs, COUNTS, and as doubles, RATIOS. One pass, no shuffle."""
    t = F.col("_t")
    base = docs.select(*[F.col(c) for c in keep], whole("text").alias("_t"))
    base = base.withColumn("_w", words(t)).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    n, lines = F.col("n_words"), F.size("_lines")
    counted = base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        (F.char_length(t).cast("long") - count_of(t, SPACES)).alias("word_chars"),
        F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("_upper"),
        count_of(t, "!").alias("_bang"),
        lines.alias("_n_lines"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counted.select(
        *keep, *COUNTS,
        share("word_chars", "n_words").alias("word_len"), share("n_symbols", "n_words").alias("symbol_share"),
        share("n_dup_lines", "_n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_upper", "word_chars").alias("upper_share"), share("_bang", "n_words").alias("bang_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class Condition:
    name: str
    above: bool
    threshold: float
    #: Of the threshold among its statistic's.
    bin: int = 0

    def column(self) -> Column:
        c = F.col(self.name).cast("double")
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class Rule:
    conditions: list[Condition]
    rejected: int = 0
    wrong: int = 0

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects."""

    rules: list[Rule] = field(default_factory=list)

    def rule_number(self) -> Column:
        """1 for the first rule, and so on; null where none holds."""
        out = F.lit(None).cast("int")
        for k, r in reversed([*enumerate(self.rules, 1)]):
            out = F.when(r.column(), k).otherwise(out)
        return out


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Statistics and `bad` (1: quality is 0) of at most fit_rows labelled documents, chosen by hash."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("_q"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    # at most fit_rows rows of two numbers: a bounded broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return statistics(found, ("doc_id", "_q")).withColumn("bad", (F.col("_q") == 0).cast("int"))


def learned(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DecisionList:
    names = [*COUNTS, *RATIOS]
    sample = written(labelled(docs, labels, fit_rows).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))), "labelled")
    cuts_row = sample.agg(*[F.percentile_approx(F.col(n).cast("double"), [k / BINS for k in range(1, BINS)], 10_000).alias(n) for n in names]).first()
    if cuts_row[0] is None:
        return DecisionList()
    cuts = {n: sorted(set(cuts_row[n])) for n in names}
    bins = {n: sum([(F.col(n).cast("double") > c).cast("int") for c in cuts[n][1:]], (F.col(n).cast("double") > cuts[n][0]).cast("int")) for n in names}
    binned = written(sample.select("part", "bad", *names, F.array(*[F.struct(F.lit(k).alias("f"), bins[n].alias("b")) for k, n in enumerate(names)]).alias("at")), "binned")

    def table(where: Column) -> dict[tuple[int, int], tuple[int, int]]:
        rows = binned.where(where).select("bad", F.inline("at")).groupBy("f", "b").agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("n")).collect()
        return {(r["f"], r["b"]): (int(r["p"]), int(r["n"] - r["p"])) for r in rows}

    def grown(left: Column) -> list[Condition]:
        conditions: list[Condition] = []
        where = left & (F.col("part") > 0)
        while len(conditions) < MAX_CONDITIONS:
            counts = table(where)
            p0, n0 = (sum(v[i] for (f, _), v in counts.items() if f == 0) for i in (0, 1))
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for k, name in enumerate(names):
                low_p = low_n = 0
                for b, cut in enumerate(cuts[name]):
                    p, n = counts.get((k, b), (0, 0))
                    low_p, low_n = low_p + p, low_n + n
                    for above, (p1, n1) in ((False, (low_p, low_n)), (True, (p0 - low_p, n0 - low_n))):
                        if p1:
                            gain = p1 * (math.log2((p1 + 1e-9) / (p1 + n1)) - math.log2(p0 / (p0 + n0)))
                            best = max(best, (gain, Condition(name, above, cut, b)), key=lambda x: x[0])
            if best[1] is None:
                break
            conditions.append(best[1])
            where = where & best[1].column()
        return conditions

    def pruned(conditions: list[Condition], left: Column) -> Rule | None:
        """The prefix of the conditions that is worth most on the pruning rows."""
        if not conditions:
            return None
        sums = []
        for k in range(1, len(conditions) + 1):
            holds = Rule(conditions[:k]).column()
            sums += [F.coalesce(F.sum(F.when(holds, F.col("bad"))), F.lit(0)).alias(f"p{k}"), F.coalesce(F.sum(F.when(holds, 1 - F.col("bad"))), F.lit(0)).alias(f"n{k}")]
        got = binned.where(left & (F.col("part") == 0)).agg(*sums).first()
        value = lambda k: (got[f"p{k}"] - got[f"n{k}"]) / max(1, got[f"p{k}"] + got[f"n{k}"])
        k = max(range(1, len(conditions) + 1), key=lambda k: (value(k), -k))
        p, n = got[f"p{k}"], got[f"n{k}"]
        return Rule(conditions[:k], int(p), int(n)) if p and p >= MIN_PRECISION * (p + n) else None

    found = DecisionList()
    left = F.lit(True)
    while len(found.rules) < MAX_RULES:
        rule = pruned(grown(left), left)
        if rule is None:
            break
        found.rules.append(rule)
        left = left & ~rule.column()
    return found


def kept_rows(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), "text")
    # a row number between statistics and filter: Spark won't push the filter below it, where each condition would count anew
    numbered = statistics(rows, ("_row",)).withColumn("_at", F.monotonically_increasing_id())
    return numbered.where((F.col("_at") >= 0) & ~base_failed() & rules.rule_number().isNull()).select("_row.*")


def judged(docs: DataFrame, rules: DecisionList, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """statistics() with base_failed, rule (number of the rule that rejects, or null) and kept."""
    return (
        statistics(docs, keep)
        .withColumn("base_failed", base_failed()).withColumn("rule", rules.rule_number())
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
