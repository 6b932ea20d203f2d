"""Distribution shift between a reference and a current side.

Inputs have a ``side`` column, 'ref' or 'cur'. Every statistic is counts per (bin or category,
side) combined map-side; what reaches the last step has a row per bin or category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import stats
from docspark.functions.bind import let
from docspark.operators.ordered import running_counts

# Fixed values of the reports.
BINS = 10
PSI_EPS = 1e-4
DENSITY_EPS = 1e-5
PSI_ALERT, P_ALERT, JS_ALERT = 0.15, 0.05, 0.1
MIN_VECTORS = 10
FEATURES = [
    ("embeddings", "embedding_psi"),
    ("text_lengths", "text_length_ks_p"),
    ("languages", "language_chi2_p"),
    ("predicted_classes", "predicted_classes_js"),
    ("confidence_scores", "confidence_scores_js"),
    ("entity_extraction_rates", "entity_extraction_rates_js"),
]


def _is(side: str) -> Column:
    return F.when(F.col("side") == side, 1).otherwise(0)


def _bin(x: Column, lo: Column, hi: Column) -> Column:
    """Equal-width bin, the last one closed; NULL outside the range."""
    step = (hi - lo) / BINS
    at = sum(((x >= lo + i * step).cast("int") for i in range(1, BINS)), F.lit(0))
    return F.when((x >= lo) & (x <= hi), at)


def _psi_rows(counted: DataFrame, keys: list[str]) -> DataFrame:
    """PSI from (keys, bin, r, c); rows without a bin count in the totals only."""
    e = F.collect_list(F.struct("bin", "r", "c"))
    one = counted.groupBy(*keys).agg(F.sum("r").alias("n_r"), F.sum("c").alias("n_c"), e.alias("bins"))
    share = lambda v, n: F.when(v == 0, F.lit(PSI_EPS)).otherwise(v / n)
    term = lambda b: (share(b["c"], F.col("n_c")) - share(b["r"], F.col("n_r"))) * F.log(
        share(b["c"], F.col("n_c")) / share(b["r"], F.col("n_r"))
    )
    placed = F.array_sort(F.filter("bins", lambda b: b["bin"].isNotNull()))
    total = F.aggregate(F.transform(placed, term), F.lit(0.0), lambda s, t: s + t)
    return one.select(*keys, total.alias("psi"))


def psi(df: DataFrame, x: str) -> DataFrame:
    """Population stability index of one number (DRF1): one row."""
    ref = df.where(F.col("side") == "ref").agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    lo = ref.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))).scalar()
    hi = ref.select(F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))).scalar()
    counted = (
        df.select("side", _bin(F.col(x).cast("double"), lo, hi).alias("bin"))
        .groupBy("bin").agg(F.sum(_is("ref")).alias("r"), F.sum(_is("cur")).alias("c"))
    )
    return _psi_rows(counted, [])


def psi_vectors(df: DataFrame, vec: str = "embedding", dims: int = 10) -> DataFrame:
    """PSI of each principal component fitted on the reference (DRF2): (dim, psi).

    With ``MIN_VECTORS`` rows or fewer on a side nothing can be told, and there are no rows.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    sizes = df.agg(F.sum(_is("ref")).alias("r"), F.sum(_is("cur")).alias("c")).first()
    if min(sizes["r"] or 0, sizes["c"] or 0) <= MIN_VECTORS:
        return df.sparkSession.createDataFrame([], "dim int, psi double")
    data = df.select("side", array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    model = PCA(k=dims, inputCol="v", outputCol="p").fit(data.where(F.col("side") == "ref"))
    proj = model.transform(data).select("side", vector_to_array("p").alias("p"))
    ref = proj.where(F.col("side") == "ref")
    lo = ref.agg(F.array(*(F.min(F.col("p")[i]) for i in range(dims)))).scalar()
    hi = ref.agg(F.array(*(F.max(F.col("p")[i]) for i in range(dims)))).scalar()
    zipped = F.arrays_zip("p", lo.alias("lo"), hi.alias("hi"))
    bins = F.transform(F.col("z"), lambda e: _bin(e["p"], e["lo"], e["hi"]))
    binned = proj.select("side", zipped.alias("z")).select("side", F.posexplode(bins).alias("dim", "bin"))
    counted = binned.groupBy("dim", "bin").agg(F.sum(_is("ref")).alias("r"), F.sum(_is("cur")).alias("c"))
    return _psi_rows(counted, ["dim"])


def psi_largest(df: DataFrame, vec: str = "embedding", dims: int = 10) -> DataFrame:
    """The largest of ``psi_vectors``, 0 where there are none (DRF2): one row."""
    return psi_vectors(df, vec, dims).agg(F.coalesce(F.max("psi"), F.lit(0.0)).alias("psi"))


def ks_two_sample(df: DataFrame, x: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and asymptotic p-value (DRF3): one row."""
    sides = df.select(F.col(x), _is("ref").alias("r"), _is("cur").alias("c"))
    run = running_counts(sides, [], x, ["r", "c"])
    gap = F.abs(F.col("cum_r") / F.col("all_r") - F.col("cum_c") / F.col("all_c"))
    one = run.agg(F.max(gap).alias("statistic"), F.max("all_r").alias("n_ref"), F.max("all_c").alias("n_cur"))
    return one.withColumn("p_value", stats.ks_pvalue("statistic", "n_ref", "n_cur"))


def _by_category(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy(F.col(x).alias("cat")).agg(F.sum(_is("ref")).alias("r"), F.sum(_is("cur")).alias("c"))


def chi2_two_sides(df: DataFrame, x: str) -> DataFrame:
    """Chi-square of category counts, add-one smoothed (DRF4): one row.

    With two categories Yates' correction moves each count half a step towards its expectation.
    """
    counts = _by_category(df, x).select((F.col("r") + 1).alias("r"), (F.col("c") + 1).alias("c"))
    totals = counts.agg(F.sum("r").alias("n_r"), F.sum("c").alias("n_c"), F.count("*").alias("k"))
    n_r, n_c, k = (totals.select(n).scalar() for n in ("n_r", "n_c", "k"))
    with_totals = counts.select("r", "c", n_r.alias("n_r"), n_c.alias("n_c"), k.alias("k"))

    def term(o: Column, side_total: Column) -> Column:
        e = side_total * (F.col("r") + F.col("c")) / (F.col("n_r") + F.col("n_c"))
        d = F.abs(o - e)
        d = F.when(F.col("k") == 2, d - F.least(F.lit(0.5), d)).otherwise(d)
        return d * d / e

    one = with_totals.agg(
        F.sum(term(F.col("r"), F.col("n_r")) + term(F.col("c"), F.col("n_c"))).alias("chi2"),
        (F.count("*") - 1).alias("dof"),
    )
    return one.withColumn("p_value", stats.chi2_pvalue("chi2", "dof"))


def _js_sum(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    part = lambda a: F.when(a > 0, a * F.log(a / m)).otherwise(0.0)
    return F.coalesce(F.sum((part(p) + part(q)) / 2), F.lit(0.0))


def js_categorical(df: DataFrame, x: str) -> DataFrame:
    """Jensen-Shannon divergence of category shares, natural log (DRF5): one row; 0 for an empty side."""
    counts = _by_category(df.where(F.col(x).isNotNull()), x)
    totals = counts.agg(F.sum("r").alias("n_r"), F.sum("c").alias("n_c"))
    n_r, n_c = totals.select("n_r").scalar(), totals.select("n_c").scalar()
    shares = counts.select("r", "c", n_r.alias("n_r"), n_c.alias("n_c")).where((F.col("n_r") > 0) & (F.col("n_c") > 0))
    return shares.agg(_js_sum(F.col("r") / F.col("n_r"), F.col("c") / F.col("n_c")).alias("js"))


def js_scores(df: DataFrame, x: str) -> DataFrame:
    """Jensen-Shannon divergence of score histograms on ten bins of 0..1 (DRF6): one row.

    Empty bins get a small density before shares are brought back to one.
    """
    at = _bin(F.col(x).cast("double"), F.lit(0.0), F.lit(1.0))
    counted = (
        df.select("side", at.alias("bin")).groupBy("bin").agg(F.sum(_is("ref")).alias("ref"), F.sum(_is("cur")).alias("cur"))
    )
    # Rows without a bin go after the aggregation; a filter here would be pushed below it and
    # compute the score many times per row.
    placed = F.filter(F.collect_list(F.struct("bin", F.struct("ref", "cur").alias("n"))), lambda e: e["bin"].isNotNull())
    one = counted.agg(F.map_from_entries(placed).alias("m"))

    def shares(side: str) -> Column:
        n = F.transform(
            F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at("m", b)[side], F.lit(0).cast("long"))
        )
        density = lambda v: let(_sum(v), lambda t: F.transform(v, lambda x: F.when(x == 0, DENSITY_EPS).otherwise(x / t * BINS)))
        return let(let(n, density), lambda d: let(_sum(d), lambda t: F.transform(d, lambda x: x / t)))

    part = lambda p, q: (p * F.log(p / ((p + q) / 2)) + q * F.log(q / ((p + q) / 2))) / 2
    pq = one.select(shares("ref").alias("p"), shares("cur").alias("q"))
    return pq.select(_sum(F.zip_with("p", "q", part)).alias("js"))


def _sum(v: Column) -> Column:
    return F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x)


def split_window(df: DataFrame, ts: str, cut: Column) -> DataFrame:
    """Rows before ``cut`` are the reference, the rest current (DRF8)."""
    return df.withColumn("side", F.when(F.col(ts) < cut, "ref").otherwise("cur"))


def report(scores: dict[str, DataFrame], spark) -> DataFrame:
    """One report row from one-row score frames, keyed by score name (DRF7).

    Frames hold the score in their first column; absent features score as undrifted.
    """
    default = {"embedding_psi": 0.0, "text_length_ks_p": 1.0, "language_chi2_p": 1.0}
    limit = {"embedding_psi": PSI_ALERT, "text_length_ks_p": P_ALERT, "language_chi2_p": P_ALERT}
    row = spark.range(1).select(
        *(
            (F.coalesce(scores[name].scalar(), F.lit(default.get(name, 0.0))) if name in scores else F.lit(default.get(name, 0.0))).alias(name)
            for _, name in FEATURES
        )
    )
    hit = lambda name: (F.col(name) < limit[name]) if name.endswith("_p") else F.col(name) > limit.get(name, JS_ALERT)
    flags = F.array(*(F.when(hit(name), F.lit(label)) for label, name in FEATURES))
    affected = F.array_compact(flags)
    return row.select(
        (F.size(affected) > 0).alias("drift_detected"), *(name for _, name in FEATURES),
        affected.alias("affected_features"),
        F.create_map(*(x for _, name in FEATURES for x in (F.lit(name), F.col(name)))).alias("drift_scores"),
    )
