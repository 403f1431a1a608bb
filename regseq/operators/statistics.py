"""Statistics per group on columns: tails in closed form, selection tests, q-values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regseq.operators import scan

# Lanczos' series for the gamma function, g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)

# The Kolmogorov tail of large samples, and from where on it counts as such.
KS_TAIL = (2.000071, 0.331, 1.409)
KS_LARGE, KS_MIDDLE, KS_MANY = 7.24, 3.76, 99


def _let(name: str, value: str, body: str) -> str:
    """SQL of a body in which a name stands for a value that is worked out once a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _log_gammas(*xs: str) -> str:
    """SQL of the array of ln gamma(x) for each x of at least 1, by one series whatever their number."""
    terms = ", ".join(f"struct({i}D AS i, {c!r}D AS c)" for i, c in enumerate(LANCZOS[1:], 1))
    series = f"aggregate(array({terms}), {LANCZOS[0]!r}D, (acc, u) -> acc + u.c / (z + u.i))"
    of = f"{0.5 * math.log(2 * math.pi)!r}D + (z + 0.5D) * ln(z + 7.5D) - (z + 7.5D) + ln({series})"
    return f"transform(array({', '.join(f'cast({x} AS double) - 1' for x in xs)}), z -> {of})"


def _signed_log_gammas(plus: list[str], minus: list[str]) -> str:
    """SQL of the sum of some ln gamma(x) less that of others."""
    signs = ", ".join(["1D"] * len(plus) + ["-1D"] * len(minus))
    return f"aggregate(zip_with({_log_gammas(*plus, *minus)}, array({signs}), (g, sign) -> g * sign), 0D, (acc, g) -> acc + g)"


def log_gamma(x: str) -> Column:
    """ln gamma(x) of a column or SQL expression of at least 1."""
    return F.expr(f"element_at({_log_gammas(x)}, 1)")


#: The continued fraction of the incomplete beta function of v.a, v.b and v.x, read from its end; x up to
#: about a / (a + b).  It settles within 12 + 1.1 sqrt(max(a, b)) steps to eleven digits.
_ODD = "(-(v.a + {m}) * (v.a + v.b + {m}) * v.x / ((v.a + 2 * {m}) * (v.a + 2 * {m} + 1)))"
_EVEN = "({m} * (v.b - {m}) * v.x / ((v.a + 2 * {m} - 1) * (v.a + 2 * {m})))"
_FRACTION = f"1 / (1 + {_ODD.format(m='0')} / (1 + aggregate(sequence(cast(16 + 1.25D * sqrt(greatest(v.a, v.b)) AS int), 1, -1), 0D, (t, m) -> {_EVEN.format(m='m')} / (1 + {_ODD.format(m='m')} / (1 + t)))))"


def binomial_tail(n: str, k: str, p: str) -> Column:
    """P(X >= k) of X ~ Binomial(n, p): the regularised incomplete beta function I_p(k, n - k + 1).

    Arguments are columns' names or SQL expressions.  p of 0 and 1, and k of 0 and above n, are
    exact; a null argument gives null.
    """
    one = lambda x: f"greatest(cast({x} AS double), 1D)"
    args = f"struct({one(n)} AS n, least({one(k)}, {one(n)}) AS k, least(greatest(cast({p} AS double), 1e-300D), {1 - 1e-16!r}D) AS x)"
    # The fraction settles on the side of the mean that x is on.
    turned = "struct(u.n - u.k + 1 AS a, u.k AS b, 1 - u.x AS x, u.x AS y, true AS turn)"
    sides = f"if(u.x > (u.k + 1) / (u.n + 3), {turned}, struct(u.k AS a, u.n - u.k + 1 AS b, u.x AS x, 1 - u.x AS y, false AS turn))"
    front = f"exp({_signed_log_gammas(['v.a + v.b'], ['v.a', 'v.b'])} + v.a * ln(v.x) + v.b * ln(v.y)) / v.a"
    tail = _let("s", f"{front} * {_FRACTION}", "least(1D, greatest(0D, if(v.turn, 1 - s, s)))")
    inside = _let("u", args, _let("v", sides, tail))
    return F.expr(f"CASE WHEN {n} IS NULL OR {k} IS NULL OR {p} IS NULL THEN NULL WHEN {k} <= 0 THEN 1D WHEN {k} > {n} THEN 0D WHEN {p} <= 0 THEN 0D WHEN {p} >= 1 THEN 1D ELSE {inside} END")


def binom_sf(df: DataFrame, out: str = "p_value") -> DataFrame:
    """P(X >= k) of X ~ Binomial(n, p) for each row (n, k, p)."""
    return df.withColumn(out, binomial_tail("n", "k", "p"))


def best_binomial(pvalues: DataFrame, n: int, by: str = "group_id") -> DataFrame:
    """Per group the least P(X >= i; n, p_i) over the ordered p-values, and the first i that gives it."""
    order = ["pvalue", *(c for c in pvalues.columns if c not in (by, "pvalue"))]
    rows = scan.ranked(pvalues, [by], order, "k").select(by, F.col("pvalue").alias("p"), "k", F.lit(n).alias("n"))
    return binom_sf(rows).groupBy(by).agg(F.min(F.struct("p_value", "k")).alias("b")).select(by, "b.p_value", F.col("b.k").alias("index"))


def hypergeometric_tail(q: str, m: str, n: str, k: str, lower: bool) -> Column:
    """Of k drawn from m marked and n others, P(at most q marked) or, if not lower, P(at least q).

    Terms are summed from q outwards on the side that falls away from the mode, each from the
    one before by its ratio, for as many as eleven standard deviations hold; the other side is
    1 less that.  Arguments are columns' names or SQL expressions; a null one gives null.
    """
    args = "struct(" + ", ".join(f"cast({e} AS double) AS {c}" for c, e in zip("qmnk", (q, m, n, k), strict=True)) + ")"
    mode = "floor((u.k + 1) * (u.m + 1) / (u.m + u.n + 2))"
    sd = "sqrt(u.k * u.m * u.n * greatest(u.m + u.n - u.k, 0D) / (power(greatest(u.m + u.n, 1D), 2) * greatest(u.m + u.n - 1, 1D)))"
    # Beyond the mode q's own side is summed, before it the other side, up to the place beside q.
    rest, beside = (f"u.q > {mode}", "u.q + 1") if lower else (f"u.q < {mode}", "u.q - 1")
    least, top = "greatest(0D, u.k - u.n)", "least(u.k, u.m)"
    known = f"struct(u.q AS q, u.m AS m, u.n AS n, u.k AS k, {least} AS least, {top} AS top, ceil(11 * {sd}) + 60 AS far, {rest} AS rest, {rest if lower else f'NOT ({rest})'} AS up, least(greatest(if({rest}, {beside}, u.q), {least}), {top}) AS j)"
    first = f"exp({_signed_log_gammas(['v.m + 1', 'v.n + 1', 'v.k + 1', 'v.m + v.n - v.k + 1'], ['v.j + 1', 'v.m - v.j + 1', 'v.k - v.j + 1', 'v.n - v.k + v.j + 1', 'v.m + v.n + 1'])})"
    ratio = _let("j", "if(v.up, v.j + i, v.j - i)", "if(v.up, (v.m - j) * (v.k - j) / ((j + 1) * (v.n - v.k + j + 1)), j * (v.n - v.k + j) / ((v.m - j + 1) * (v.k - j + 1)))")
    steps = "cast(least(if(v.up, v.top - v.j, v.j - v.least), v.far) AS int)"
    grow = _let("t", f"acc.t * {ratio}", "struct(t AS t, acc.s + t AS s)")
    walk = f"aggregate(if({steps} > 0, sequence(0, {steps} - 1), cast(array() AS array<int>)), struct(f AS t, f AS s), (acc, i) -> {grow}).s"
    inside = _let("f", first, _let("s", f"least(1D, {walk})", "if(v.rest, 1 - s, s)"))
    ends = "WHEN v.q < v.least THEN 0D WHEN v.q >= v.top THEN 1D" if lower else "WHEN v.q > v.top THEN 0D WHEN v.q <= v.least THEN 1D"
    tail = _let("u", args, _let("v", known, f"CASE {ends} ELSE {inside} END"))
    return F.expr(f"CASE WHEN {q} IS NULL OR {m} IS NULL OR {n} IS NULL OR {k} IS NULL THEN NULL ELSE {tail} END")


def phyper(df: DataFrame, lower: bool, out: str = "p_value") -> DataFrame:
    """Hypergeometric tails for rows (q, m, n, k): q marked of k drawn from m marked and n others.
    lower: P(X <= q), else P(X >= q)."""
    return df.withColumn(out, hypergeometric_tail("q", "m", "n", "k", lower))


def cluster_enrichment(universe: DataFrame, positives: DataFrame, clusters: DataFrame) -> DataFrame:
    """(pattern, cluster_id, q, m, n, k, p_value): are positives (pattern, gene_id) frequent in a cluster.

    Members outside the universe and repeats do not count.  p is 1 where a cluster or the
    positives are empty.
    """
    genes = universe.select("gene_id").distinct()
    members = clusters.select("cluster_id", "gene_id").distinct().join(genes, "gene_id", "left_semi")
    called = positives.select("pattern", "gene_id").distinct().join(genes, "gene_id", "left_semi")
    total = genes.count()
    size = clusters.select("cluster_id").distinct().join(members.groupBy("cluster_id").agg(F.count("*").alias("m")), "cluster_id", "left").fillna(0, ["m"])
    drawn = positives.select("pattern").distinct().join(called.groupBy("pattern").agg(F.count("*").alias("k")), "pattern", "left").fillna(0, ["k"])
    both = called.join(members, "gene_id").groupBy("pattern", "cluster_id").agg(F.count("*").alias("q"))
    # Patterns x clusters: each pair is a row of the result.
    rows = drawn.crossJoin(size).join(both, ["pattern", "cluster_id"], "left").fillna(0, ["q"])
    out = phyper(rows.withColumn("n", F.lit(total) - F.col("m")), False)
    return out.withColumn("p_value", F.when((F.col("m") == 0) | (F.col("k") == 0), 1.0).otherwise(F.col("p_value"))).select("pattern", "cluster_id", "q", "m", "n", "k", "p_value")


def ks_uniform(df: DataFrame, steps: int, by: str = "group_id") -> DataFrame:
    """Per group the largest distance of the values' distribution from the uniform one on the grid i / steps of [0, 1]."""
    place = F.least(F.greatest(F.ceil(F.round(F.col("value") * steps, 9)), F.lit(0)), F.lit(steps)).cast("int")
    counts = df.groupBy(by, place.alias("i")).agg(F.count("*").alias("c"))
    spine = df.select(by).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    # A group has steps + 1 rows here, whatever the data.
    w = Window.partitionBy(by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    run = spine.join(counts, [by, "i"], "left").fillna(0, ["c"]).withColumn("f", F.sum("c").over(w) / F.sum("c").over(Window.partitionBy(by)))
    return run.groupBy(by).agg(F.max(F.abs(F.col("f") - F.col("i") / steps)).alias("d"), F.sum("c").alias("n"))


def ks_pvalue(d: Column, n: Column) -> Column:
    """Large samples by the closed form, others by twenty terms of the Kolmogorov series."""
    s = n * d * d
    large = 2 * F.exp(-(KS_TAIL[0] + KS_TAIL[1] / F.sqrt(n) + KS_TAIL[2] / n) * s)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * s))
    return F.when((s > KS_LARGE) | ((s > KS_MIDDLE) & (n > KS_MANY)), large).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def strand_bias(sites: DataFrame, by: str = "motif_id") -> DataFrame:
    """Binomial tail at 1/2 of the larger strand count."""
    rows = sites.groupBy(by).agg(F.count_if(F.col("strand") == "+").alias("plus"), F.count_if(F.col("strand") == "-").alias("minus"))
    rows = rows.withColumns({"n": F.col("plus") + F.col("minus"), "k": F.greatest("plus", "minus"), "p": F.lit(0.5)})
    return binom_sf(rows).select(by, "plus", "minus", "p_value")


def overrep_none(hits: DataFrame, threshold: float) -> DataFrame:
    return hits.filter(F.col("pvalue") < threshold)


def _ranked(hits: DataFrame, by: list[str]) -> DataFrame:
    return scan.ranked(hits, by, ["pvalue", "hit_id"])


def _first_best(ranked: DataFrame, tails: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Hits up to the rank of the least tail, where that is below the threshold."""
    best = tails.groupBy(*by).agg(F.min(F.struct("p_value", "rank")).alias("b")).select(*by, F.col("b.rank").alias("best"), F.col("b.p_value").alias("test_p")).filter(F.col("test_p") < threshold)
    return ranked.join(best, by).filter("rank <= best").drop("best")


def overrep_binomial(hits: DataFrame, n: int, threshold: float, by: list[str]) -> DataFrame:
    """Over the ordered p_i the i of the least P(X > i; n, p_i); its first i hits, if that is below the threshold."""
    ranked = _ranked(hits, by)
    rows = ranked.select(*by, "rank", F.lit(n).alias("n"), (F.col("rank") + 1).alias("k"), F.col("pvalue").alias("p"))
    return _first_best(ranked, binom_sf(rows), by, threshold)


def _normal_sf(z: Column) -> Column:
    """Upper tail of the normal distribution by Abramowitz and Stegun 26.2.17."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def overrep_poisbinom(hits: DataFrame, n: int, threshold: float, by: list[str]) -> DataFrame:
    """As overrep_binomial for a sum of unequal trials p_1 ... p_i and n - i of p_i, by the refined normal approximation."""
    p, i = F.col("pvalue"), F.col("rank")
    moments = {"__mu": p, "__var": p * (1 - p), "__third": p * (1 - p) * (1 - 2 * p)}
    rows = scan.prefix_scan(hits, by, ["pvalue", "hit_id"], {"rank": ("sum", F.lit(1).cast("long"))} | {c: ("sum", e) for c, e in moments.items()})
    ranked = rows.withColumn("rank", i.cast("int")).withColumns({c: F.col(c) + F.greatest(F.lit(n) - i, F.lit(0)) * e for c, e in moments.items()})
    sd = F.sqrt(F.greatest("__var", F.lit(1e-300)))
    z = (i + 0.5 - F.col("__mu")) / sd
    # Certain trials have no spread, and nothing to refine.
    cubed = F.when(F.col("__var") > 1e-100, sd * sd * sd)
    refined = _normal_sf(z) + F.coalesce(F.col("__third") / cubed * (z * z - 1) * F.exp(-z * z / 2) / (6 * F.sqrt(F.lit(2 * math.pi))), F.lit(0.0))
    tails = ranked.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), refined)))
    return _first_best(ranked.drop(*moments), tails, by, threshold)


def qvalues(hits: DataFrame, by: list[str], pi0: float = 1.0, threshold: float | None = None) -> DataFrame:
    """hits with rank and qvalue; with a threshold only those not above it.

    No task holds a group: ranks are counted forwards over ranges of p-values, and the least
    p m / rank of what is behind comes backwards over the same ranges.
    """
    order = ["pvalue", "hit_id"]
    parts = scan.scanned(scan.dealt(hits, by, order), by, order, {"rank": ("sum", F.lit(1).cast("long"))}).withColumn("rank", F.col("rank").cast("int"))
    size = hits.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.count("*").alias("__m"))
    parts = parts.join(size, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]).withColumn("__q", F.col("pvalue") * pi0 * F.col("__m") / F.col("rank"))
    back = scan.scanned(parts, by, [F.desc(c) for c in order], {"qvalue": ("min", F.col("__q"))}, back=True)
    out = back.withColumn("qvalue", F.least(F.lit(1.0), "qvalue")).select(*hits.columns, "rank", "qvalue")
    return out.filter(F.col("qvalue") <= threshold) if threshold is not None else out


def storey_pi0(hits: DataFrame, by: list[str], cut: float = 0.5) -> DataFrame:
    """Share of true nulls: p-values above the cut over what uniform ones would give."""
    return hits.groupBy(*by).agg(F.least(F.lit(1.0), F.count_if(F.col("pvalue") > cut) / (F.count("*") * (1 - cut))).alias("pi0"))


def overrepresented(hits: DataFrame, presence: DataFrame, test: str, threshold: float, n: int = 100, by: list[str] | None = None) -> DataFrame:
    """Presence rows with the number of hits that the test (none, binomial, poisbinom, qvalue) keeps, and their least p-value."""
    by = by or ["seq_id", "motif"]
    if test == "none":
        kept = overrep_none(hits, threshold)
    elif test == "binomial":
        kept = overrep_binomial(hits, n, threshold, by)
    elif test == "poisbinom":
        kept = overrep_poisbinom(hits, n, threshold, by)
    elif test == "qvalue":
        kept = qvalues(hits, by, 1.0, threshold)
    else:
        raise ValueError(test)
    found = kept.groupBy(*by).agg(F.count("*").alias("count"), F.min("pvalue").alias("pvalue"))
    return presence.select(*by).distinct().join(found, by, "left").select(*by, F.lit(test).alias("test"), F.coalesce("count", F.lit(0)).alias("count"), "pvalue")
