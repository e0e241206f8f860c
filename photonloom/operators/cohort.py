"""Cohort construction: quality masks, reasons, checked joins and set checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from photonloom.functions.scalars import finite, lookup

# Quality codes of the spectroscopic catalogue.
QC_GROUP = {0: "OK", 1: "BAD", 2: "BAD", 3: "WARNING", 4: "WARNING", 5: "WARNING", 6: "WARNING", 7: "WARNING"}
QC_MEANING = {0: "all checks passed", 1: "wrong redshift", 2: "low S/N or empty field", 3: "fit and/or strong AGN",
              4: "mass differs from the reference catalogue", 5: "redshift differs from the reference catalogue",
              6: "foreground star", 7: "merging system"}
UNKNOWN_GROUP = "UNKNOWN"

# Open bounds of the published sample.
MASS_RANGE = (8.0, 12.0)
SFR_RANGE = (-4.0, 2.0)


# --- predicates ----------------------------------------------------------------------------------------------------------
def inside_open(c: str, bounds: tuple[float, float]) -> Column:
    return F.coalesce((F.col(c) > bounds[0]) & (F.col(c) < bounds[1]), F.lit(False))


def published_cuts(mass: str = "log_mstar", sfr: str = "log_sfr", d4000: str = "d4000") -> Column:
    """P01"""
    return finite(d4000).isNotNull() & inside_open(mass, MASS_RANGE) & inside_open(sfr, SFR_RANGE)


def validity_state(c: str, cap: float) -> Column:
    """P04"""
    return F.when(finite(c).isNull(), "missing").when(F.col(c) > cap, "above cap").otherwise("valid")


def by_ranges(c: str, ranges: Mapping[str, tuple[float | None, float | None]], default: str) -> Column:
    """First class whose half-open range [lo, hi) holds the value."""
    out = None
    for name, (lo, hi) in ranges.items():
        hit = F.lit(True)
        if lo is not None:
            hit = hit & (F.col(c) >= lo)
        if hi is not None:
            hit = hit & (F.col(c) < hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def valid_coordinates(ra: str, dec: str) -> Column:
    """P10"""
    return F.coalesce((finite(ra) >= 0) & (finite(ra) < 360) & finite(dec).between(-90, 90), F.lit(False))


def specific_rate(sfr: str, mass: str) -> Column:
    """P11"""
    return F.col(sfr) - F.col(mass)


def coverage_flags(zero_fractions: Sequence[str], partial: float = 0.05, empty: float = 0.999) -> tuple[Column, Column]:
    """(any band beyond the partial limit, any band empty)."""
    worst = F.greatest(*zero_fractions) if len(zero_fractions) > 1 else F.col(zero_fractions[0])
    return worst > partial, worst >= empty


def add_reasons(df: DataFrame, rules: Mapping[str, Column], column: str = "reason") -> DataFrame:
    """Text of every rule that holds, joined by '; '; empty when the row is kept."""
    return df.withColumn(column, F.concat_ws("; ", *[F.when(c, F.lit(text)) for text, c in rules.items()]))


def apply_qc(df: DataFrame, groups: Sequence[str], flag: str = "qcflag", group: str = "qc_group") -> tuple[DataFrame, DataFrame]:
    """(included, excluded with a formatted reason)."""
    keep = F.coalesce(F.col(group).isin(list(groups)), F.lit(False))
    text = F.concat(F.lit("QCFLAG="), F.coalesce(F.col(flag).cast("string"), F.lit("NA")), F.lit(" ("), F.col(group), F.lit(": "),
                    lookup(flag, QC_MEANING, "no data"), F.lit(")"))
    return df.where(keep), df.where(~keep).withColumn("reason", text)


def with_qc_group(df: DataFrame, flag: str = "qcflag") -> DataFrame:
    """P07"""
    return df.withColumn("qc_group", lookup(flag, QC_GROUP, UNKNOWN_GROUP))


def to_number(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double, bad text to missing."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def common_cohort(split: str, splits: Sequence[str], *flags: str) -> Column:
    """P15"""
    out = F.col(split).isin(list(splits))
    for f in flags:
        out = out & F.coalesce(F.col(f), F.lit(False))
    return out


def geometry_reason(naxis: str, bands: str, crpix: str, scale: str, rotated: str, side: int, wanted_bands: Sequence[str],
                    pixscale: float, tolerance: float = 0.01) -> Column:
    """Reason an image header is unusable, or NULL."""
    centre = (side + 1) / 2
    off = F.exists(crpix, lambda v: F.abs(v - centre) > 1.0)
    return (F.when(F.col(naxis) != F.array(F.lit(side), F.lit(side), F.lit(len(wanted_bands))), "shape")
            .when(F.col(bands) != F.array(*[F.lit(b) for b in wanted_bands]), "band order")
            .when(off, "centre").when(F.abs(F.col(scale) - pixscale) > tolerance * pixscale, "pixel scale")
            .when(F.col(rotated), "rotated"))


# --- joins ---------------------------------------------------------------------------------------------------------------
def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key under an order; min_by combines before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def manifest(catalogue: DataFrame, labels: DataFrame, obj: str, *order: Column | str, limit: int = 0) -> DataFrame:
    """Left join of labels, first row per id, optional head by id."""
    d = first_per_key(catalogue.join(labels, obj, "left"), [obj], *order)
    return d.orderBy(obj).limit(limit) if limit else d


def indicator_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with `matched` telling 'both' from 'left_only'."""
    right = right.withColumn("_hit", F.lit(True))
    return (left.join(right, list(keys), "left")
            .withColumn("matched", F.when(F.col("_hit"), "both").otherwise("left_only")).drop("_hit"))


def closest_match(left: DataFrame, right: DataFrame, key: str, pairs: Mapping[str, str], payload: Sequence[str],
                  tie: Sequence[str]) -> DataFrame:
    """Among the rows of `right` with the same key keep the one at the smallest L1 distance; a missing part counts as
    infinite; ties go by `tie`, nulls last. min_by keeps one candidate per task, so a key with many observations never gathers."""
    dist = sum((F.abs(F.col(a) - F.col(b)) for a, b in pairs.items()), F.lit(0.0))
    d = left.join(right, key, "left").withColumn("dist", F.coalesce(dist, F.lit(float("inf"))))
    best = F.min_by(F.struct(*payload, "dist"), F.struct("dist", *[x for c in tie for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])).alias("_b")
    return d.groupBy(key).agg(best).select(key, *[F.col(f"_b.{c}").alias(c) for c in [*payload, "dist"]])


def cross_check(a: DataFrame, b: DataFrame, key: str, numeric: Sequence[str], exact: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """One row with the number of differences per field. A missing number never counts, a missing text does."""
    r = b.select(key, *[F.col(c).alias(f"_{c}") for c in [*numeric, *exact]], F.lit(True).alias("_hit"))
    d = a.join(r, key, "left")
    aggs = [F.count_if(F.col("_hit").isNull()).alias("unmatched")]
    aggs += [F.count_if(F.coalesce(F.abs(finite(c) - finite(f"_{c}")) > tol, F.lit(False))).alias(f"{c}_diff") for c in numeric]
    aggs += [F.count_if(~F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))).alias(f"{c}_diff") for c in exact]
    return d.agg(*aggs)


def key_set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys known to one side only, with the side."""
    x = a.select(key).distinct().withColumn("_a", F.lit(True))
    y = b.select(key).distinct().withColumn("_b", F.lit(True))
    return (x.join(y, key, "full_outer").where("_a IS NULL OR _b IS NULL")
            .select(key, F.when(F.col("_a"), "left").otherwise("right").alias("side")))


def attach_unique(df: DataFrame, extra: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Left join after the right side is reduced to one row per key."""
    return df.join(first_per_key(extra, [key], *order), key, "left")


def content_leaks(df: DataFrame, content: Column | str, split: str) -> DataFrame:
    """Hashes of content that occurs in more than one split."""
    h = F.sha2(F.col(content) if isinstance(content, str) else content, 256)
    return (df.select(h.alias("content_hash"), split).groupBy("content_hash")
            .agg(F.count("*").alias("n"), F.countDistinct(split).alias("n_splits")).where("n_splits > 1"))


def design_gaps(observed: DataFrame, dims: Sequence[DataFrame]) -> DataFrame:
    """Expected cells that are missing and observed cells that are not expected.

    The expected design is the product of the dimensions' distinct values, spread over the cluster: each further dimension is one
    array, a scalar subquery, exploded in every row of the product so far. Missing values of a dimension count as a value.
    """
    names = [d.columns[0] for d in dims]
    want = dims[0].distinct()
    for c, d in zip(names[1:], dims[1:]):
        values = d.select(F.struct(F.col(c).alias("v")).alias("s")).agg(F.array_sort(F.collect_set("s"))).scalar()
        want = want.select("*", F.explode(values).alias("_s")).select(*want.columns, F.col("_s.v").alias(c))
    want = want.select(*[F.col(c).alias(f"_w_{c}") for c in names], F.lit(True).alias("_want"))
    got = observed.groupBy(*names).agg(F.count("*").alias("n"))
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    return (want.join(got, on, "full_outer").where("_want IS NULL OR n IS NULL")
            .select(*[F.coalesce(c, f"_w_{c}").alias(c) for c in names], F.when(F.col("n").isNull(), "missing").otherwise("extra").alias("gap")))


def top_n(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first n rows per key under an order. Spark pushes the rank limit below the shuffle, so each task sends at
    most n rows per key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("position", rank).where(F.col("position") <= n)


# --- data dictionary -----------------------------------------------------------------------------------------------------
# Feature columns by group, as produced by the photometry, the morphology and the physical variables.
FEATURE_GROUPS = {
    "photometry": ("flux_g", "flux_r", "flux_z", "m_g", "m_r", "m_z", "R20", "R50", "R80", "R90"),
    "morphology": ("concentration", "asymmetry", "smoothness", "gini", "m20", "axis_ratio"),
    "physical": ("g_r", "r_z", "g_z", "log_lum_r", "log_r50_kpc", "log_sigma_lum", "log_mass_phot", "log_mass_colour"),
    "catalogue": ("redshift", "log_mstar", "log_sfr", "d4000"),
}


def feature_columns(group: str) -> list[str]:
    """Columns of a dictionary group."""
    return list(FEATURE_GROUPS[group])


def project_group(df: DataFrame, obj: str, group: str) -> DataFrame:
    """The id and the columns of a group; what the table lacks is an error, not a silent gap."""
    lacking = sorted(set(feature_columns(group)) - set(df.columns))
    if lacking:
        raise ValueError(f"columns of group {group} are missing: {lacking}")
    return df.select(obj, *feature_columns(group))
