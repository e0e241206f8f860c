"""Physical variables from magnitudes (F03) and the Hubble-law scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extinction per unit reddening, solar magnitude, published mass calibrations.
EXTINCTION = {"g": 3.214, "r": 2.165, "z": 1.211}
SOLAR_R = 4.65
MASS_CALIBRATION = (0.673, -1.108, 0.996)
MASS_TO_LIGHT_R = (-0.306, 1.097)
HUBBLE_KMS, LIGHT_KMS, ARCSEC_PER_RAD = 70.0, 299792.0, 206265.0
BANDS = ("g", "r", "z")


def hubble_kpc_per_px(z: Column, arcsec_per_px: float) -> Column:
    """F05"""
    return F.lit(arcsec_per_px) * (LIGHT_KMS * z / HUBBLE_KMS) * 1e6 / ARCSEC_PER_RAD / 1e3


def positive_log10(c: Column) -> Column:
    return F.log10(F.when(c > 0, c))


def physical_variables(df: DataFrame) -> DataFrame:
    """F03. Needs m_*, m_in_*, m_out_* for g, r, z, R50, R90, ebv, distance_modulus and kpc_per_arcsec; each step is one
    projection, so the whole chain stays in one code-generated stage."""
    steps: dict[str, Column] = {}
    for b in BANDS:
        a = EXTINCTION[b] * F.col("ebv")
        steps |= {f"m_{b}0": F.col(f"m_{b}") - a, f"m_in_{b}0": F.col(f"m_in_{b}") - a, f"m_out_{b}0": F.col(f"m_out_{b}") - a}
    d = df.withColumns(steps)
    half_area = positive_log10(2 * F.pi() * F.col("R50") * F.col("R50"))
    second = {f"mu50_{b}": F.col(f"m_{b}0") + 2.5 * half_area for b in BANDS}
    second |= {f"abs_{b}": F.col(f"m_{b}0") - F.col("distance_modulus") for b in BANDS}
    for a, b in (("g", "r"), ("r", "z"), ("g", "z")):
        second[f"{a}_{b}"] = F.col(f"m_{a}0") - F.col(f"m_{b}0")
    for a, b in (("g", "r"), ("r", "z")):
        second[f"{a}_{b}_in"] = F.col(f"m_in_{a}0") - F.col(f"m_in_{b}0")
        second[f"{a}_{b}_out"] = F.col(f"m_out_{a}0") - F.col(f"m_out_{b}0")
    second |= {"size_ratio": F.col("R90") / F.nullif(F.col("R50"), F.lit(0.0)), "r50_kpc": F.col("R50") * F.col("kpc_per_arcsec")}
    d = d.withColumns(second)
    area = positive_log10(2 * F.pi() * F.col("r50_kpc") * F.col("r50_kpc"))
    a, b, c = MASS_CALIBRATION
    third = {f"delta_{p}": F.col(f"{p}_in") - F.col(f"{p}_out") for p in ("g_r", "r_z")}
    third |= {"log_lum_r": 0.4 * (SOLAR_R - F.col("abs_r")), "log_r50_kpc": positive_log10(F.col("r50_kpc")), "log_area": area,
              "log_mass_phot": a * F.col("abs_g") + b * F.col("abs_r") + c}
    d = d.withColumns(third)
    return d.withColumns({"log_sigma_lum": F.col("log_lum_r") - F.col("log_area"),
                          "log_mass_colour": F.col("log_lum_r") + MASS_TO_LIGHT_R[0] + MASS_TO_LIGHT_R[1] * F.col("g_r"),
                          "log_sigma_mass": F.col("log_mass_phot") - F.col("log_area")})
