"""Quality rules: base limits, then robust multivariate outliers per language and source.

DataFrame functions only. Each text gives base counts and a vector of
transformed statistics (log length, mean word length, log symbols per word,
share of repeated lines, share of words in repeated 5-word windows). Per
language and source, the minimum-covariance-determinant estimate of location
and scatter is found by concentration steps from a start at medians and
quartile ranges: the rows are ordered by Mahalanobis distance, and the
part `COVERED` nearest gives the next estimate. A reweighted step follows, and
documents beyond `cutoff` are rejected.

No group is ever collected: a step bins the distances, sums counts and products
per (group, bin), and takes the bins up to the covered part, so each task
reduces its rows before the shuffle and a group with a third of all rows is
as cheap as any. Statistics are integers (thousandths) summed exactly, so that
reruns agree to the last bit.

Defined cases: a null or empty text has no words and fails the base rules; null
languages and sources are groups of their own; groups below `MIN_ROWS` rows
pool their rows per language, and those again in one rest group, which if it
is small rejects nothing; repeated rows and ties are counted as they stand; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.llm.common import SPACE, WORD, pick
from trialgrid.session import written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = ("x0", "x1", "x2", "x3", "x4")
DIMS = len(VECTOR)
SCALE = 1000.0
#: Least standard deviation of each statistic, so that constant ones give no singular scatter.
FLOORS = (0.2, 0.2, 0.25, 0.15, 0.08)
COVERED, STEPS, MIN_ROWS = 0.6, 5, 60
BINS_PER_E = 16


def _chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-squared, by the series of the incomplete gamma function."""
    a, half = k / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= half / (a + n)
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a))


def _chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_cdf(middle, k) < q else (low, middle)
    return high


def _consistency(part: float) -> float:
    """Factor that makes the scatter of the nearest `part` of normal rows consistent."""
    return part / _chi2_cdf(_chi2_quantile(part, DIMS), DIMS + 2)


CUTOFF = _chi2_quantile(1 - 1e-7, DIMS)


def statistics(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns `carry` (first, under their own names), then lang, source, the
    base counts, the statistic vector in thousandths, and base_failed."""
    kept = {f"c{i}": c for i, c in enumerate(carry)}
    rows = pick(documents, **kept, text=text_col, lang=lang_col, source=source_col)
    keys = [*kept, "lang", "source"]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    rows = rows.select(
        *keys, F.array_remove(F.split(text, f"{SPACE}+"), "").alias("words"),
        F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        lines.alias("lines"))
    rows = rows.select(*keys, "word_chars", "n_symbols", F.size("words").cast("bigint").alias("n_words"),
                       F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
                       F.size("lines").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"))
    h = F.col("hashes")
    windows = F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - 4),
                          lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(5)]))
    rows = rows.select(*keys, *[c for c in COUNTS if c != "n_repeat_words"], "n_lines",
                       F.when(F.col("n_words") >= 5, windows).alias("windows"))
    rows = rows.select(*keys, *[c for c in COUNTS if c != "n_repeat_words"], "n_lines",
                       F.when(F.size(F.array_distinct("windows")) < F.size("windows"),
                              F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
                       .alias("sorted"))
    s = F.col("sorted")
    found_twice = F.filter(s, lambda x, k: (F.get(s, k - 1).h == x.h) | (F.get(s, k + 1).h == x.h))
    rows = rows.select(*keys, *[c for c in COUNTS if c != "n_repeat_words"], "n_lines",
                       F.sort_array(F.transform(found_twice, lambda x: x.i)).alias("at"))
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - i, F.lit(5)))),
                          F.lit(0), lambda a, b: a + b)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
    words, thousandths = F.greatest(F.col("n_words"), F.lit(1)), F.lit(SCALE)
    vector = (F.log(words), F.col("word_chars") / words, F.log(1 + 10 * F.col("n_symbols") / words),
              F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / words)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(*[F.col(k).alias(c) for k, c in kept.items()], "lang", "source", *COUNTS,
                       *[F.round(v * thousandths).cast("bigint").alias(x) for v, x in zip(vector, VECTOR, strict=True)],
                       failed.alias("base_failed"))


def _key(*columns: Column) -> Column:
    """A text that is equal for equal columns, nulls included."""
    return F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit("="), c), F.lit("-")) for c in columns])


def _groups(usable: DataFrame) -> DataFrame:
    """(pair, group): the group in which each pair of language and source is estimated."""
    pairs = usable.groupBy(_key(F.col("lang"), F.col("source")).alias("pair"), _key(F.col("lang")).alias("language")) \
        .agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") < MIN_ROWS, F.col("n")).otherwise(F.lit(0))
    pooled = F.sum(small).over(Window.partitionBy("language"))
    group = (F.when(F.col("n") >= MIN_ROWS, F.concat(F.lit("pair "), "pair"))
             .when(pooled >= MIN_ROWS, F.concat(F.lit("language "), "language")).otherwise(F.lit("rest")))
    return pairs.select("pair", group.alias("group"))


PRODUCTS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _sums() -> list[Column]:
    """Count, sums and products of the vector, exact."""
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    return [F.count(F.lit(1)).cast("decimal(20,0)").alias("n"),
            *[exact(F.col(x)).alias(f"s{i}") for i, x in enumerate(VECTOR)],
            *[exact(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"p{i}{j}") for i, j in PRODUCTS]]


SUMS = ["n", *[f"s{i}" for i in range(DIMS)], *[f"p{i}{j}" for i, j in PRODUCTS]]


def _whitened(scatter: DataFrame, keep: list[str]) -> DataFrame:
    """Adds the inverse of the lower Cholesky factor of a00.., row by row, as
    an array: a step per column of the factor, then per row of the inverse."""
    for j in range(DIMS):
        square = F.col(f"a{j}{j}") - sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        scatter = scatter.withColumn(f"l{j}{j}", F.sqrt(F.greatest(square, F.lit(1e-9))))
        scatter = scatter.select("*", *[
            ((F.col(f"a{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0)))
             / F.col(f"l{j}{j}")).alias(f"l{i}{j}") for i in range(j + 1, DIMS)])
    for i in range(DIMS):
        scatter = scatter.select("*", (1 / F.col(f"l{i}{i}")).alias(f"w{i}{i}"), *[
            (-sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
             / F.col(f"l{i}{i}")).alias(f"w{i}{j}") for j in range(i)])
    return scatter.select(*keep, F.array(*[F.col(f"w{i}{j}") for i, j in PRODUCTS]).alias("whitening"))


def _estimate(sums: DataFrame, factor: float) -> DataFrame:
    """(group, m0.., whitening) from per-group sums."""
    n = F.col("n").cast("double")
    mean = [F.col(f"s{i}").cast("double") / n / SCALE for i in range(DIMS)]
    means = sums.select("group", *[F.col(f"p{i}{j}").cast("double").alias(f"p{i}{j}") for i, j in PRODUCTS],
                        n.alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(mean)])

    def covariance(i, j):
        value = (F.col(f"p{i}{j}") / F.col("n") / (SCALE * SCALE) - F.col(f"m{i}") * F.col(f"m{j}")) * factor
        return value + F.lit(FLOORS[i] ** 2) if i == j else value

    centers = ["group", *[f"m{i}" for i in range(DIMS)]]
    return _whitened(means.select(*centers, *[covariance(i, j).alias(f"a{i}{j}") for i, j in PRODUCTS]), centers)


def _distance() -> Column:
    """Squared Mahalanobis distance of the vector from its group's estimate."""
    apart = [F.col(x) / SCALE - F.col(f"m{i}") for i, x in enumerate(VECTOR)]
    w = {p: F.element_at("whitening", k + 1) for k, p in enumerate(PRODUCTS)}
    total = F.lit(0.0)
    for i in range(DIMS):
        z = sum((w[i, j] * apart[j] for j in range(i + 1)), F.lit(0.0))
        total = total + F.pow(z, F.lit(2.0))
    return total


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges per group, from exact counts per value."""
    values = rows.select("group", F.posexplode(F.array(*VECTOR)).alias("dim", "x"))
    counts = values.groupBy("group", "dim", "x").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("group", "dim")
    ranked = counts.withColumn("upto", F.sum("n").over(of.orderBy("x"))).withColumn("all", F.sum("n").over(of))
    quantile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("x"))) / SCALE
    by_dim = ranked.groupBy("group", "dim").agg(quantile(0.5).alias("middle"),
                                                ((quantile(0.75) - quantile(0.25)) / 1.349).alias("spread"))
    of_dim = lambda c, i: F.max(F.when(F.col("dim") == i, F.col(c)))
    whitening = [F.lit(0.0) if i != j else 1 / F.greatest(of_dim("spread", i), F.lit(FLOORS[i])) for i, j in PRODUCTS]
    return by_dim.groupBy("group").agg(*[of_dim("middle", i).alias(f"m{i}") for i in range(DIMS)],
                                       F.array(*whitening).alias("whitening"))


def _concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step: the estimate from the `COVERED` nearest rows of each group."""
    binned = rows.join(estimate, "group").select(
        "group", *VECTOR, F.floor(F.log(_distance() + F.lit(1e-6)) * BINS_PER_E).alias("bin"))
    sums = binned.groupBy("group", "bin").agg(*_sums())
    by_bin = Window.partitionBy("group").orderBy("bin")
    upto = sums.select("group", "bin", *[F.sum(c).over(by_bin).alias(c) for c in SUMS],
                       F.sum("n").over(Window.partitionBy("group")).alias("all"))
    nearest = (upto.where(F.col("n").cast("double") >= F.col("all").cast("double") * COVERED)
               .withColumn("nearest", F.row_number().over(by_bin)).where("nearest = 1"))
    return _estimate(nearest.select("group", *SUMS), _consistency(COVERED))


def fit(stats: DataFrame) -> DataFrame:
    """(pair, group, m0.., whitening): the estimate for each pair of language
    and source, from all rows that pass the base rules. `stats` is read once
    per step, so give a written table."""
    usable = stats.where(~F.col("base_failed")).withColumn("pair", _key(F.col("lang"), F.col("source")))
    groups = written(_groups(usable), "quality-groups")
    rows = usable.select("pair", *VECTOR).join(groups, "pair").drop("pair")
    estimate = _start(rows)
    for _ in range(STEPS):
        estimate = written(_concentrate(rows, estimate), "quality-step")
    near = rows.join(estimate, "group").where(_distance() <= _chi2_quantile(0.975, DIMS))
    final = _estimate(near.groupBy("group").agg(*_sums()), _consistency(0.975))
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= MIN_ROWS)
    return written(groups.join(final, "group").join(sizes.select("group"), "group"), "quality-estimates")


def judge(stats: DataFrame, estimates: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Adds `kept`: the base rules passed, and the vector not beyond `cutoff`
    in its group. Pairs without an estimate reject nothing."""
    known = estimates.withColumnRenamed("pair", "_pair").drop("group")
    judged = stats.withColumn("_own", _key(F.col("lang"), F.col("source"))).join(known, F.col("_own") == F.col("_pair"), "left")
    outside = F.coalesce(_distance() > cutoff, F.lit(False))
    # one sum, not a conjunction: a filter on it stays above the join, as whole statistics pushed into a filter would be computed anew
    faults = F.col("base_failed").cast("int") + outside.cast("int")
    return judged.withColumn("kept", faults == 0).select(*stats.columns, "kept")


def quality_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: id, base counts, base_failed, kept."""
    stats = written(statistics(documents, text_col, lang_col, source_col, carry=(id_col,)), "quality-statistics")
    return judge(stats, fit(stats), cutoff).select(id_col, *COUNTS, "base_failed", "kept")


def kept_documents(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                   cutoff: float = CUTOFF) -> DataFrame:
    """The rows of `documents` that quality_rules keeps, whole: fitted on the
    statistics, then judged as the rows are read again, so no text is shuffled."""
    stats = written(statistics(documents, text_col, lang_col, source_col), "quality-statistics")
    names = documents.columns
    numbered = documents.toDF(*[f"c{i}" for i in range(len(names))])
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(names)))}
    whole = numbered.select(F.struct("*").alias("row"), F.col(at[text_col]).alias("text"),
                            F.col(at[lang_col]).alias("lang"), F.col(at[source_col]).alias("source"))
    again = statistics(whole, carry=("row",))
    return judge(again, fit(stats), cutoff).where("kept").select("row.*").toDF(*names)
