"""Quality rules: base statistics of a text and robust multivariate outliers (minimum covariance determinant).

DataFrame functions only.  Per language and source a centre and a scatter are estimated by C-steps: the
half-sample of the documents nearest in Mahalanobis distance gives the next centre and scatter, from two
deterministic starts (median and MAD; mean and covariance), and the smaller determinant wins.  The sums are
taken over fixed-point integers, so that the result does not depend on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let, materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
#: Fixed-point steps of a transformed statistic.
SCALE = 1000
#: Share of a group's documents in the half-sample, C-steps at most, documents below which a group is pooled.
SUBSET, STEPS, MIN_GROUP = 0.5, 6, 100
#: Share of normal vectors within the last step's cut, by which the centre and scatter are taken again.
REWEIGHT = 0.975
#: Least standard deviation, by statistic given those before it: log words, log word length, symbols, repeated words and
#: repeated lines.  It takes the place of a smaller scatter only, as most documents have no symbols or repeats at all.
FLOORS = (0.15, 0.08, 0.04, 0.12, 0.12)
#: Chance, under the normal model, of a document beyond the cutoff.
TAIL = 1e-5
NAMES = ("z_words", "z_length", "z_symbols", "z_repeats", "z_lines")
P = range(len(NAMES))
#: The sums that moments need: of each statistic, and of each product.
SUMS = [str(i) for i in P] + [f"{i}_{j}" for i in P for j in range(i + 1)]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words which occurs at least twice."""
    def windows(ids: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ids) - WINDOW), lambda i: F.xxhash64(*[F.get(ids, i + k) for k in range(WINDOW)]))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(starts, i - 1)))),
            F.lit(0),
            lambda a, x: a + x,
        )

    def repeated(pairs: Column) -> Column:
        same = lambda x, i: F.get(pairs, i)["h"].eqNullSafe(x["h"])
        return F.array_sort(F.transform(F.filter(pairs, lambda x, i: ((i > 0) & same(x, i - 1)) | same(x, i + 1)), lambda x: x["p"]))

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, lambda s: let(repeated(s), covered)))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda ids: let(windows(ids), count)))


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null or empty text has zeroes and fails.  Columns of docs of these names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with_words = docs.withColumns(
        {
            "_words": F.filter(F.split(text, SPACE), lambda w: w != ""),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
        }
    )
    out = with_words.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_words")).cast("long"),
            "_n_lines": F.size("_lines"),
        }
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).drop("_words", "_lines")


def transformed(stats: DataFrame) -> DataFrame:
    """The statistic vector in fixed-point integers: logarithms and square roots of shares."""
    share = lambda n, of: F.sqrt(F.least(F.lit(1.0), F.col(n) / F.greatest(F.col(of), F.lit(1))))
    values = (
        F.log1p("n_words"),
        F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)),
        share("n_symbols", "n_words"),
        share("n_repeat_words", "n_words"),
        share("n_dup_lines", "_n_lines"),
    )
    return stats.withColumns({n: F.round(v * SCALE).cast("long") for n, v in zip(NAMES, values, strict=True)})


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(df / 2, mid / 2) < p else (low, mid)
    return high


def _estimate(moments: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Centre m_i, inverse scatter a_i_j and log determinant from sums s_i, s_i_j and n."""
    means = moments.selectExpr(*keys, *[f"CAST(s{k} AS DOUBLE) / greatest(n, 1) / {SCALE ** (1 + k.count('_'))} AS e{k}" for k in SUMS])
    cov = [f"{factor!r}D * (e{i}_{j} - e{i} * e{j}) AS c{i}_{j}" for i in P for j in range(i + 1)]
    return _inverse(means.selectExpr(*keys, *[f"e{i} AS m{i}" for i in P], *cov), keys)


def _inverse(out: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse of the scatter c_i_j by Cholesky factors l and their inverse k, column by column."""
    total = lambda terms: "(" + " + ".join(["0D", *terms]) + ")"
    for j in P:
        square = f"c{j}_{j} - {total(f'l{j}_{k} * l{j}_{k}' for k in range(j))}"
        out = out.selectExpr("*", f"sqrt(greatest({FLOORS[j] ** 2!r}D, {square})) AS l{j}_{j}")
        out = out.selectExpr("*", *[f"(c{i}_{j} - {total(f'l{i}_{k} * l{j}_{k}' for k in range(j))}) / l{j}_{j} AS l{i}_{j}" for i in P if i > j])
    out = out.selectExpr("*", *[f"1 / l{j}_{j} AS k{j}_{j}" for j in P])
    for by in range(1, len(NAMES)):
        below = [(j + by, j) for j in range(len(NAMES) - by)]
        out = out.selectExpr("*", *[f"-{total(f'l{i}_{k} * k{k}_{j}' for k in range(j, i))} / l{i}_{i} AS k{i}_{j}" for i, j in below])
    inverse = [f"{total(f'k{k}_{i} * k{k}_{j}' for k in range(i, len(NAMES)))} AS a{i}_{j}" for i in P for j in range(i + 1)]
    return out.selectExpr(*keys, *[f"m{i}" for i in P], *inverse, f"{total(f'2 * ln(l{i}_{i})' for i in P)} AS log_det")


#: Squared Mahalanobis distance of a row that carries the estimate of its group.
DISTANCE = " + ".join(f"a{i}_{j} * ({NAMES[i]} / {SCALE}D - m{i}) * ({NAMES[j]} / {SCALE}D - m{j}) * {1 if i == j else 2}" for i in P for j in range(i + 1))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n and the sums of the statistics and of their products, in integers."""
    of = lambda k: " * ".join(NAMES[int(i)] for i in k.split("_"))
    sums = [F.expr(f"CAST(sum({of(k)}) AS DECIMAL(38,0)) AS s{k}") for k in SUMS]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)


def _joined(z: DataFrame, estimates: DataFrame) -> DataFrame:
    return z.join(estimates, "grp").withColumn("d2", F.expr(DISTANCE))


def consistency(share: float) -> float:
    """What the scatter of the nearest share of normal vectors must be multiplied by."""
    return share / max(1e-9, _gamma_p(len(NAMES) / 2 + 1, chi2_quantile(share, len(NAMES)) / 2))


def _c_step(z: DataFrame, estimates: DataFrame, share: float) -> DataFrame:
    """The next estimates: moments of the documents within the share-quantile of distances.

    One aggregation gives the moments of bins of distances, one hundredth of a log unit each (at most about
    4,000 bins a group); those of the bins up to the quantile, all their documents with them, are added up.
    """
    keys = ["grp", "start"]
    bin_ = F.greatest(F.lit(-700), F.least(F.lit(3300), F.floor(F.log(F.col("d2") + 1e-3) * 100))).cast("int")
    bins = _moments(_joined(z, estimates).withColumn("bin", bin_), [*keys, "bin"])
    w = W.partitionBy(*keys)
    near = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)}).where(F.col("upto") - F.col("n") < share * F.col("all"))
    sums = near.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum("s" + k).alias("s" + k) for k in SUMS])
    return materialize(_estimate(sums, keys, consistency(share)), "mcd")


def _medians(z: DataFrame) -> DataFrame:
    """Coordinate-wise median and MAD by group, over the fixed-point values' bins of ten steps."""
    v = lambda i: F.round(F.col(NAMES[i]) / 10)
    med = materialize(z.groupBy("grp").agg(*[F.percentile(v(i), F.lit(0.5)).alias(f"med{i}") for i in P]), "mcd-medians")
    both = z.join(med, "grp").groupBy("grp").agg(*[F.max(f"med{i}").alias(f"med{i}") for i in P], *[F.percentile(F.abs(v(i) - F.col(f"med{i}")), F.lit(0.5)).alias(f"mad{i}") for i in P])
    diag = [((1.4826 * F.col(f"mad{i}") * 10 / SCALE) ** 2 if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i in P for j in range(i + 1)]
    return _inverse(both.select("grp", F.lit(0).alias("start"), *[(F.col(f"med{i}") * 10.0 / SCALE).alias(f"m{i}") for i in P], *diag), ["grp", "start"])


def _grouped(z: DataFrame) -> DataFrame:
    """grp: language and source; groups of fewer than MIN_GROUP documents are pooled by language, then over all.

    A scatter of five statistics needs more documents than that to have a half-sample at all.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    z = z.withColumns({"_l": name("lang"), "_s": name("source")})
    sizes = z.groupBy("_l", "_s").agg(F.count("*").alias("n"))
    few = F.col("n") < MIN_GROUP
    pooled = F.sum(F.when(few, F.col("n")).otherwise(0)).over(W.partitionBy("_l"))
    key = F.when(~few, F.concat_ws("\u0001", "_l", "_s")).when(F.col("pooled") >= MIN_GROUP, F.col("_l")).otherwise(F.lit("\u0001"))
    groups = materialize(sizes.withColumn("pooled", pooled).select("_l", "_s", key.alias("grp")), "mcd-keys")
    return z.join(groups, ["_l", "_s"]).drop("_l", "_s")


def mcd_distances(stats: DataFrame, subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """Rows of stats (lang, source and the base statistics) with grp and the robust squared distance d2.

    C-steps go on until no group's determinants change, steps times at most.
    """
    rows = _grouped(transformed(stats))
    z = materialize(rows.select("grp", *NAMES), "mcd-z")
    start = _medians(z).unionByName(_estimate(_moments(z, ["grp"]), ["grp"], 1.0).withColumn("start", F.lit(1)))
    estimates, seen = materialize(start, "mcd"), None
    for _ in range(steps):
        estimates = _c_step(z, estimates, subset)
        now = estimates.agg(F.sum(F.xxhash64("grp", "start", F.round("log_det", 3)).cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    best = estimates.withColumn("r", F.row_number().over(W.partitionBy("grp").orderBy("log_det", "start"))).where("r = 1").drop("r")
    near = _joined(z, best).where(F.col("d2") <= chi2_quantile(REWEIGHT, len(NAMES)))
    final = materialize(_estimate(_moments(near, ["grp"]), ["grp"], consistency(REWEIGHT)), "mcd")
    return _joined(rows, final)


def _judged(packed: DataFrame, tail: float) -> DataFrame:
    """Rows of packed (doc, text, lang, source), text excepted, with all statistics, mcd_group, d2 and kept."""
    stats = materialize(base_statistics(packed).drop("text"), "quality")
    level = F.when(F.col("grp") == "\u0001", "all").when(F.contains("grp", F.lit("\u0001")), "language and source").otherwise("language")
    cutoff = F.col("d2") <= chi2_quantile(1 - tail, len(NAMES))
    passed = mcd_distances(stats.where("NOT base_failed")).select(*stats.columns, level.alias("mcd_group"), "d2", cutoff.alias("kept"))
    null = lambda t: F.lit(None).cast(t)
    failed = stats.where("base_failed").select(*stats.columns, null("string").alias("mcd_group"), null("double").alias("d2"), F.lit(False).alias("kept"))
    return passed.unionByName(failed)


def quality_rules(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, mcd_group, the robust distance d2, kept.

    docs has doc_id, text, lang and source; null languages and sources form groups of their own; further
    columns are ignored.  Repeated rows are scored each; an empty table gives an empty result.  mcd_group tells
    whether a document was held against its language and source, its language, or all; documents that fail the
    base rules take no part in the estimates and have a null mcd_group and d2.  kept is false for them and for
    documents beyond the cutoff.
    """
    out = _judged(docs.select(F.struct("doc_id").alias("doc"), "text", "lang", "source"), tail)
    return out.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "mcd_group", "d2", "kept")


def passing(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of docs that quality_rules keeps, each judged by its own text, with all their columns."""
    return _judged(docs.select(F.struct(*docs.columns).alias("doc"), "text", "lang", "source"), tail).where("kept").select("doc.*")
