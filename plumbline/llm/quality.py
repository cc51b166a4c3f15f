"""Quality rules with risk-controlled thresholds, as Spark SQL expressions alone.

Base counts are taken from each whole text. Every rule compares one ratio with a cutoff of a fixed
grid. A labelled holdout tells how many good documents the rules would reject together. A third of it
(by hash of doc_id) and the bad documents order the cutoffs: from all rules off, one rule at a time
goes one cutoff stricter, the least costly for good documents first. The other two thirds test that path from loose to
strict: the exact (Clopper-Pearson) upper bound of the share of good documents that any of the rules
rejects must stay below ``risk``, and the first step that fails ends the path. A fixed sequence spends
its whole confidence on each step, so ``delta`` is divided by the number of pools alone.

A pool is a stratum. Strata with too few good documents to prove a single step join the neighbour with
fewer; the bound then holds for the pool, and a step also ends the path where one member's own share
of rejected good documents is above ``risk``. Strata without good documents in the test have their rules off, as
has every stratum while one pool of all is too small.

Null and empty texts have no words and fail the base rule; documents without a label are judged, but
not counted in the holdout; a label without a document is ignored, and one doc_id with several rows or
labels counts each pair; an empty table gives no rows and needs no label."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

RISK, DELTA = 0.01, 0.05
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Strata by length, as (name, least number of words).
STRATA = (("short", 0), ("middle", 200), ("long", 1000))
#: Rules: ratio and cutoffs, from strict to loose; a document fails above its cutoff.
RULES = {
    "symbols": ("n_symbols / n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    "dup_lines": ("n_dup_lines / n_lines", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)),
    "repeats": ("n_repeat_words / n_words", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4)),
    "capitals": ("n_capitals / word_chars", (0.1, 0.2, 0.3, 0.5, 0.7)),
    "long_words": ("word_chars / n_words / 20", (0.3, 0.4, 0.5, 0.75, 1.0)),
}
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Columns that ``judge`` adds; those of a caller under these names are left out.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "base_failed", "kept")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def quality_features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_capitals (long) from the whole text.

    Repeated words come from sorting hashes of a document's 3-word windows: n log n in its length, inside its row. Two different windows of one text with one 64-bit hash
    could part equal ones in the order, at odds of about n^2 / 2^65."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_words", F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != ""))
    d = d.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, BLANKS)) > 0))
    # a hash of each window with its place, sorted by hash: equal windows are neighbours, and words are compared where hashes tie
    windows = F.expr("""
        case when size(_words) < 3 then array()
        else sort_array(transform(sequence(0, size(_words) - 3), i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) as h, i as p))) end""")
    d = d.withColumn("_windows", windows)

    def same(other: str) -> str:
        y = f"_windows[{other}]"
        return f"{y}.h = x.h and _words[{y}.p] = _words[x.p] and _words[{y}.p + 1] = _words[x.p + 1] and _words[{y}.p + 2] = _words[x.p + 2]"

    twice = F.expr(f"""
        sort_array(filter(transform(_windows, (x, i) ->
            if((i > 0 and {same("greatest(i - 1, 0)")}) or (i < size(_windows) - 1 and {same("least(i + 1, size(_windows) - 1)")}), x.p, -1)), p -> p >= 0))""")
    d = d.withColumn("_twice", twice)
    # words under sorted windows of three: each adds what lies before the next window's start
    repeated = F.expr("""
        aggregate(_twice, struct(0L as n, -3 as last), (a, p) ->
            struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)""")
    base = {
        "n_words": F.size("_words"),
        "word_chars": F.length(_without(text, BLANKS)),
        "n_symbols": F.length(text) - F.length(_without(text, SYMBOLS)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated,
        "n_lines": F.size("_lines"),
        "n_capitals": F.length(text) - F.length(_without(text, CAPITALS)),
    }
    return d.select(*[d[c] for c in docs.columns if c not in base], *[x.cast("long").alias(c) for c, x in base.items()])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def stratum() -> Column:
    out = F.lit(STRATA[0][0])
    for name, least in STRATA[1:]:
        out = F.when(F.col("n_words") >= least, name).otherwise(out)
    return out


def _ratio(rule: str) -> Column:
    up, _, down = RULES[rule][0].partition(" / ")
    first, _, scale = down.partition(" / ")
    return F.coalesce(F.try_divide(F.col(up), F.col(first)), F.lit(0.0)) / float(scale or 1)


def _log_gamma(x: str) -> str:
    """Stirling's series, moved up by eight."""
    z = f"({x} + 8)"
    return f"(({z} - 0.5) * ln({z}) - {z} + 0.9189385332046727 + 1 / (12 * {z}) - 1 / (360 * power({z}, 3)) + 1 / (1260 * power({z}, 5)) - ln({' * '.join(f'({x} + {i})' for i in range(8))}))"


def upper_tail(k: str, n: str, p: str) -> Column:
    """P(Bin(n, p) <= k) for k < n, in SQL: the regularised incomplete beta function I_{1-p}(n - k, k + 1) by its continued fraction.

    A cutoff with k rejections of n has its Clopper-Pearson upper bound at or below p exactly where this is at most the level."""
    a, b, x = f"cast({n} - {k} as double)", f"cast({k} + 1 as double)", f"(1 - {p})"
    front = f"exp({_log_gamma(f'({a} + {b})')} - {_log_gamma(a)} - {_log_gamma(b)} + {a} * ln({x}) + {b} * ln(1 - {x}))"

    def fraction(a: str, b: str, x: str) -> str:
        # Lentz's way: c and d are the ratios of successive numerators and denominators
        step = f"""case when i % 2 = 0 then (i div 2) * ({b} - i div 2) * {x} / (({a} + i - 1) * ({a} + i))
                   else -({a} + i div 2) * ({a} + {b} + i div 2) * {x} / (({a} + i - 1) * ({a} + i)) end"""
        return f"""aggregate(sequence(1, 400), struct(cast(1 as double) as f, cast(1 as double) as c, cast(0 as double) as d), (s, i) ->
            transform(array({step}), t -> transform(array(struct(1 / (1 + t * s.d) as d, 1 + t / s.c as c)), u -> struct(s.f * u.c * u.d as f, u.c as c, u.d as d))[0])[0],
            s -> 1 / s.f)"""

    direct = f"{front} * {fraction(a, b, x)} / ({a})"
    other = f"1 - {front} * {fraction(b, a, f'(1 - {x})')} / ({b})"
    return F.expr(f"case when {k} >= {n} then 1.0 when {x} < ({a} + 1) / ({a} + {b} + 2) then {direct} else {other} end")


def least_good(risk: float, level: float) -> int:
    """Good documents that prove a step at the level when it rejects none of them."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def pools(counts: dict[str, int], risk: float = RISK, delta: float = DELTA) -> list[list[str]]:
    """Strata with good documents, in groups of neighbours that have enough of them for delta divided by the number of groups. Looks at the counts alone."""
    out = [[name] for name, _ in STRATA if counts.get(name)]
    while len(out) > 1:
        n = [sum(counts[s] for s in p) for p in out]
        i = n.index(min(n))
        if n[i] >= least_good(risk, delta / len(out)):
            break
        j = min((j for j in (i - 1, i + 1) if 0 <= j < len(out)), key=lambda j: n[j])
        out[min(i, j) : max(i, j) + 1] = [out[min(i, j)] + out[max(i, j)]]
    return out


def path(steps: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[tuple[int, ...]]:
    """Places in the cutoffs of each rule, from all off to all strictest, one rule one cutoff at a time: next is what rejects the fewest good for each bad document.

    ``steps`` has a row for each kind of document: how many cutoffs of each rule it exceeds; ``good`` and ``bad`` count the documents of each kind."""
    at = [len(cuts) for _, cuts in RULES.values()]
    out, failed = [], np.zeros(len(steps), bool)
    while any(at):
        best = None
        for r in range(len(at)):
            if at[r]:
                new = (steps[:, r] >= at[r]) & ~failed
                lost, caught = int(good[new].sum()), int(bad[new].sum())
                cost = (lost / (caught + 1), -caught, -at[r], r)
                if best is None or cost < best[0]:
                    best = (cost, r)
        r = best[1]
        failed |= steps[:, r] >= at[r]
        at[r] -= 1
        out.append(tuple(at))
    return out


def thresholds(features: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> list[tuple[str, str, float]]:
    """(stratum, rule, cutoff) of the rules that are on: at most strata x rules.

    Good documents are those with quality 1 that pass the base rule, bad ones those with quality 0 that do. Labelled documents are counted
    by stratum and the number of cutoffs that each ratio exceeds, so what the driver gets is bounded by the grid."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("_id"), "quality")
    labelled = features.where(~base_failed()).withColumn("stratum", stratum()).join(known, F.col("doc_id") == F.col("_id"))
    exceeded = [reduce(lambda a, b: a + b, [(_ratio(r) > c).cast("int") for c in cuts]).alias(f"m{i}") for i, (r, (_, cuts)) in enumerate(RULES.items())]
    learns = (F.pmod(F.xxhash64(F.lit("quality"), "_id"), F.lit(3)) == 0).alias("learns")
    cells = labelled.select("stratum", "quality", learns, *exceeded).groupBy("stratum", "quality", "learns", *[f"m{i}" for i in range(len(RULES))]).agg(F.count(F.lit(1)).alias("n")).collect()
    tested = {name: sum(r["n"] for r in cells if r["stratum"] == name and r["quality"] == 1 and not r["learns"]) for name, _ in STRATA}
    groups, paths, tests = pools(tested, risk, delta), [], []
    for g, members in enumerate(groups):
        own = [r for r in cells if r["stratum"] in members]
        steps = np.array([[r[f"m{i}"] for i in range(len(RULES))] for r in own])
        n = np.array([r["n"] for r in own], np.int64)
        is_good, learn = np.array([r["quality"] == 1 for r in own]), np.array([r["learns"] for r in own])
        paths.append(path(steps, n * (is_good & learn), n * ~is_good))
        for j, at in enumerate(paths[g]):
            failed = (steps > np.array(at)).any(axis=1) & is_good & ~learn
            lost = {s: int(n[failed & np.array([r["stratum"] == s for r in own])].sum()) for s in members}
            if len(members) > 1 and any(k > risk * tested[s] for s, k in lost.items()):
                break
            tests.append(f"({g}, {j}, {sum(lost.values())}L, {sum(tested[s] for s in members)}L)")
    if not tests:
        return []
    listed = features.sparkSession.sql(f"select * from values {', '.join(tests)} as t(pool, step, k, n)")  # at most strata x cutoffs rows
    passed = {(r["pool"], r["step"]) for r in listed.where(upper_tail("k", "n", str(risk)) <= delta / len(groups)).collect()}
    out = []
    for g, members in enumerate(groups):
        last = None
        for j, at in enumerate(paths[g]):
            if (g, j) not in passed:
                break
            last = at
        if last:
            out += [(s, r, float(cuts[i])) for s in members for i, (r, (_, cuts)) in zip(last, RULES.items()) if i < len(cuts)]
    return out


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """docs with the features, base_failed and kept. Features are computed once and kept as a table."""
    features = cut(quality_features(docs), "quality")
    s = stratum()
    broken = [(s == name) & (_ratio(rule) > cutoff) for name, rule, cutoff in thresholds(features, labels, risk, delta)]
    fails = reduce(lambda a, b: a | b, broken, F.lit(False))
    return features.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~fails)
