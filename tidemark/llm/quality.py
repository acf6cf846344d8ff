"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Six statistics of a text are transformed into a vector: log of the mean word length, log of one plus
the symbols per word, share of repeated lines, share of words in repeated three-word windows, share
of capitals A-Z, log of one plus the punctuation marks per word.
For each language and source, centre and covariance are those of the 75 % of the vectors that
are closest to them: starting at medians and absolute deviations, concentration steps take the
closest vectors by Mahalanobis distance and estimate anew, which never raises the determinant.
Documents whose squared distance is beyond the chi-square quantile for one in 100,000 are rejected.

Everything is DataFrame functions. Distances are counted in fixed bins for each group, so that
the closest 75 % are found by sums that combine before the shuffle; a group of any size is never
gathered. Texts are read once, by each task for itself; what is shuffled are counts and moments.

Definitions: nulls are empty texts. Texts that fail the base rules (too few words, or most words
repeated) are rejected and take no part in the estimates. Groups of fewer than ``LEAST`` vectors
are pooled by language, and languages that are still smaller altogether; null languages and
sources are groups like others. ``FLOORS`` (the resolution of each statistic) is added to the
variances, so that constant statistics do no harm: repeated rows and ties change nothing else.
An empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, packed, table

SPACE = r"[\x20\x09-\x0D]+"
#: Share of a group's vectors that its estimates come from, and the fall of the log determinant below which a group has settled.
SHARE, SETTLED = 0.75, 0.02
#: Vectors that a group needs for estimates of its own.
LEAST = 50
#: Chance of a clean document to be rejected, under a normal distribution.
TAIL = 1e-5
#: Standard deviations that each transformed statistic has at least: guards for statistics that are constant in most of a group,
#: low enough that one strongly deviating statistic (0.41 of the lines or words repeated, 0.41 symbols a word) rejects by itself.
FLOORS = (0.05, 0.06, 0.07, 0.07, 0.05, 0.08)
P = len(FLOORS)
X = [f"x{i}" for i in range(P)]
#: Bins of squared distances: so many to each doubling.
FINE = 32


def _even_chi_square(dof: int, x: float) -> float:
    """Distribution function of chi-square for an even number of degrees of freedom."""
    y = x / 2
    return 1 - math.exp(-y) * sum(y**k / math.factorial(k) for k in range(dof // 2))


def _quantile(dof: int, p: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _even_chi_square(dof, mid) < p else (lo, mid)
    return hi


def windows(words: Column, n: Column) -> Column:
    """The three-word windows of the array ``words`` of ``n`` words as (hash, place), sorted, so that equal ones are neighbours."""
    found = F.transform(F.sequence(F.lit(0), n.cast("int") - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")))
    return F.when(n >= 3, F.sort_array(found)).otherwise(F.array().cast("array<struct<h: bigint, i: int>>"))


def with_statistics(docs: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """``docs`` with the base statistics of its texts and the transformed vector, in columns that begin with ``prefix``."""
    c = lambda name: F.col(f"{prefix}{name}")
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn(f"{prefix}words", F.array_remove(F.split(t, SPACE), ""))
    docs = docs.withColumn(f"{prefix}n_words", F.size(c("words")).cast("long"))
    docs = docs.withColumn(f"{prefix}windows", windows(c("words"), c("n_words")))
    hash_at = lambda i: F.get(c("windows"), i)["h"]
    again = F.filter(c("windows"), lambda x, i: F.coalesce(hash_at(i - 1) == x["h"], F.lit(False)) | F.coalesce(hash_at(i + 1) == x["h"], F.lit(False)))
    docs = docs.withColumn(f"{prefix}again", F.sort_array(F.transform(again, lambda x: x["i"].cast("long"))))
    # a place adds those of its three words that the one before has not covered
    covered = F.aggregate(c("again"), F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(x.alias("at"), (s["n"] + F.least(F.lit(3).cast("long"), x - s["at"])).alias("n")), lambda s: s["n"])
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumn(f"{prefix}n_repeat_words", F.when(F.size(c("again")) > 0, covered).otherwise(F.lit(0).cast("long"))).withColumn(f"{prefix}lines", lines)
    docs = (
        docs.withColumn(f"{prefix}word_chars", F.length(F.array_join(c("words"), "")).cast("long"))
        .withColumn(f"{prefix}n_symbols", F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn(f"{prefix}n_capitals", F.regexp_count(t, F.lit(r"[A-Z]")).cast("long"))
        .withColumn(f"{prefix}n_marks", F.regexp_count(t, F.lit(r"[!-/:-@\[-`{-~]")).cast("long"))
        .withColumn(f"{prefix}n_lines", F.size(c("lines")).cast("long"))
        .withColumn(f"{prefix}n_dup_lines", (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"))
        .drop(*(f"{prefix}{x}" for x in ("words", "windows", "again", "lines")))
        .withColumn(f"{prefix}base_failed", (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words")))
    )
    per_word = lambda x: c(x) / F.greatest(c("n_words"), F.lit(1))
    vector = (F.log(F.greatest(per_word("word_chars"), F.lit(1.0))), F.log1p(per_word("n_symbols")), c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)), per_word("n_repeat_words"), c("n_capitals") / F.greatest(c("word_chars"), F.lit(1)), F.log1p(per_word("n_marks")))
    for name, x in zip(X, vector, strict=True):
        docs = docs.withColumn(f"{prefix}{name}", x.cast("double"))
    return docs


def _group(lang: str, source: str) -> Column:
    part = lambda x: F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("-"))
    return F.concat(part(lang), F.lit("\n"), part(source))


def _beside(rows: DataFrame, groups: DataFrame, n_groups: int, key: str = "g") -> DataFrame:
    """Rows joined with what is known of their group: broadcast while groups are few, else an ordinary join."""
    return rows.join(F.broadcast(groups) if n_groups <= 100_000 else groups, key, "left")


def _distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance from centre m* and Cholesky factor l** of the row's group."""
    y: list[Column] = []
    for i in range(P):
        rest = F.col(f"{prefix}{X[i]}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _factored(groups: DataFrame, scale: float) -> DataFrame:
    """g, m*, l** from g, m*, covariances s**: scaled, with the floors added, as a Cholesky factor."""
    for i in range(P):
        for j in range(i + 1):
            s = F.col(f"s{i}{j}") * scale + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(FLOORS[i] ** 2 / 4))) if i == j else s / F.col(f"l{j}{j}"))
    return groups.select("g", *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i in range(P) for j in range(i + 1)))


def fit(stats: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "q_") -> tuple[DataFrame, DataFrame, int]:
    """Names of the groups that languages and sources belong to, the estimates of those groups, and how many names there are.

    ``stats`` is read several times; it should be a checkpointed table without texts.
    """
    own = _group(lang, source)
    able = stats.where(f"NOT {prefix}base_failed")
    counts = stats.groupBy(own.alias("own"), F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("-")).alias("lang")).agg(F.count_if(~F.col(f"{prefix}base_failed")).alias("n"))
    counts = counts.withColumn("pool", F.when(F.col("n") >= LEAST, F.col("own")).otherwise(F.col("lang")))
    pools = counts.groupBy("pool").agg(F.sum("n").alias("pool_n"))
    names = checkpointed(counts.join(pools, "pool").select("own", F.when(F.col("pool_n") >= LEAST, F.col("pool")).otherwise("").alias("g")))
    n = names.count()
    rows = _beside(able.select(own.alias("own"), *(F.col(f"{prefix}{x}").alias(x) for x in X)), names, n, "own").drop("own")

    middle = rows.groupBy("g").agg(*(F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(X)))
    middle = checkpointed(middle)
    spread = _beside(rows, middle, n).groupBy("g").agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i, x in enumerate(X)))
    start = middle.join(spread, "g")
    for i in range(P):
        for j in range(i + 1):
            start = start.withColumn(f"s{i}{j}", F.pow(F.col(f"d{i}") * 1.4826, 2) if i == j else F.lit(0.0))
    groups = checkpointed(_factored(start, 1.0))

    # the share of a normal distribution that is closest has smaller variances, by this factor
    scale = SHARE / _even_chi_square(P + 2, _quantile(P, SHARE))
    while True:
        binned = _beside(rows, groups, n).withColumn("bin", F.floor(F.log2(1 + 1024 * _distance()) * FINE)).select("g", "bin", *X)
        tally = binned.groupBy("g", "bin").agg(F.count("*").alias("n"))
        order = Window.partitionBy("g").orderBy("bin")
        tally = tally.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("g")))
        reach = tally.where(F.col("upto") >= SHARE * F.col("all")).groupBy("g").agg(F.min("bin").alias("reach"))
        moments = [F.avg(x).alias(f"m{i}") for i, x in enumerate(X)] + [F.covar_pop(X[i], X[j]).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)]
        closest = _beside(binned, checkpointed(reach), n).where("bin <= reach").groupBy("g").agg(*moments)
        # steps go on until no group's determinant falls any more
        best = groups.withColumn("fresh", F.lit(False)).union(_factored(closest, scale).withColumn("fresh", F.lit(True)))
        volume = sum((F.log(F.col(f"l{i}{i}")) * 2 for i in range(1, P)), F.log("l00") * 2) + F.when(F.col("fresh"), SETTLED).otherwise(0.0)
        kept = best.groupBy("g").agg(F.min_by(F.struct(*best.columns[1:]), volume).alias("e")).select("g", "e.*")
        kept = checkpointed(kept)
        groups = kept.drop("fresh")
        if not kept.where("fresh").limit(1).count():
            return names, groups, n


def judge(docs: DataFrame, names: DataFrame, groups: DataFrame, n: int, lang: str = "lang", source: str = "source", prefix: str = "q_") -> DataFrame:
    """``docs`` (with statistics) and whether they are kept, in the column ``prefix`` kept."""
    found = docs.withColumn("own", _group(lang, source))
    found = _beside(_beside(found, names, n, "own"), groups, n)
    verdict = F.coalesce(_distance(prefix) <= _quantile(P, 1 - TAIL), F.lit(True))
    return found.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & verdict).drop("own", "g", *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i in range(P) for j in range(i + 1)))


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every document."""
    columns = [f"q_{x}" for x in (*STATISTICS, *X)]
    stats = checkpointed(with_statistics(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", *columns))
    found = judge(stats, *fit(stats))
    return found.select("doc_id", *(F.col(f"q_{x}").alias(x) for x in (*STATISTICS, "kept")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns, whatever the names of others than text, lang and source."""
    columns = [f"q_{x}" for x in (*STATISTICS, *X)]
    full = with_statistics(packed(docs, "text", "lang", "source"))
    stats = checkpointed(full.select("lang", "source", *columns))
    # the row number keeps the optimizer from writing the statistics out again in the filter
    numbered = full.withColumn("q_row", F.monotonically_increasing_id())
    return judge(numbered, *fit(stats)).where("q_kept AND q_row >= 0").select("packed.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))
