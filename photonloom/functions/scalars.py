"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")

# AB zero point of fluxes in nanomaggies.
ZERO_POINT = 22.5


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value as double, or NULL when it is missing, NaN or infinite."""
    d = col(c).cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(INF)), d)


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(col(c), digits)


def round_scaled(c: Column | str, digits: int) -> Column:
    """Half away from zero of the double times 10^digits, divided again. `F.round` goes by the shortest decimal text instead, which gives
    another double where neighbours lie about as far apart as the last digit."""
    x, scale = col(c), float(10 ** digits)
    y = F.abs(x) * scale
    whole = F.floor(y).cast("double")
    r = F.when(y < 2.0 ** 52, whole + (y - whole >= 0.5).cast("double")).otherwise(y) / scale
    return F.when(r == INF, x).otherwise(F.signum(x) * r)


def safe_div(a: Column | str, b: Column | str) -> Column:
    return col(a) / F.nullif(col(b), F.lit(0.0))


def clip(c: Column | str, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(c)))


# --- F01 stretches -------------------------------------------------------------------------------------------------
def stretch01(x: Column | str, method: str, softening: float = 0.1) -> Column:
    """Linear, log or asinh stretch of a value already scaled to [0, 1]."""
    x = col(x)
    if method == "linear":
        return x
    if method == "asinh":
        return F.asinh(x / softening) / F.asinh(F.lit(1.0 / softening))
    if method == "log":
        return F.log1p(x / softening) / F.log1p(F.lit(1.0 / softening))
    raise ValueError(f"unknown stretch {method}")


def rescale01(x: Column | str, lo: Column | str, hi: Column | str) -> Column:
    x, lo, hi = col(x), col(lo), col(hi)
    return clip((x - lo) / F.greatest(hi - lo, F.lit(1e-8)), 0.0, 1.0)


# --- F02 magnitudes ------------------------------------------------------------------------------------------------
def magnitude(flux: Column | str) -> Column:
    f = col(flux)
    return F.when(f > 0, ZERO_POINT - 2.5 * F.log10(f))


def surface_brightness(flux_per_px: Column | str, pixscale: float) -> Column:
    f = col(flux_per_px)
    return F.when(f > 0, ZERO_POINT - 2.5 * F.log10(f / (pixscale * pixscale)))


def flux_limit(surface_brightness_limit: float, pixscale: float) -> float:
    """Flux per pixel at a surface brightness limit (inverse of `surface_brightness`)."""
    return pixscale**2 * 10 ** (-0.4 * (surface_brightness_limit - ZERO_POINT))


# --- F06 pixel geometry --------------------------------------------------------------------------------------------
def radius(y: Column | str, x: Column | str, cy, cx) -> Column:
    """Distance to the centre, from squares so that every engine rounds it alike."""
    dy = col(y) - (cy if isinstance(cy, Column) else F.lit(float(cy)))
    dx = col(x) - (cx if isinstance(cx, Column) else F.lit(float(cx)))
    return F.sqrt(dy * dy + dx * dx)


def equivalent_radius(area: Column | str) -> Column:
    return F.sqrt(col(area) / F.pi())


# --- F07 header radius ---------------------------------------------------------------------------------------------
def pixel_radius(radius_arcsec: float, pixscale: Column, cdelt2: Column, cd2_2: Column, fallback: float,
                 minimum: int = 8) -> Column:
    """Radius in pixels; the first usable header key wins, degrees become arcseconds."""
    def usable(c: Column, factor: float) -> Column:
        return F.nullif(F.abs(c), F.lit(0.0)) * F.lit(factor)

    scale = F.coalesce(usable(pixscale, 1.0), usable(cdelt2, 3600.0), usable(cd2_2, 3600.0), F.lit(fallback))
    return F.greatest(F.rint(F.lit(radius_arcsec) / scale).cast("int"), F.lit(minimum))


# --- F09/F10 transforms --------------------------------------------------------------------------------------------
def log10_pair(x: Column | str) -> tuple[Column, Column]:
    """(forward, inverse) of the log10 / power-of-ten transform."""
    return F.log10(F.when(col(x) > 0, col(x))), F.pow(F.lit(10.0), col(x))


def box_cox(x: Column | str, lam: Column | float) -> Column:
    x = F.greatest(col(x), F.lit(1e-12))
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.when(F.abs(lam) < 1e-12, F.ln(x)).otherwise((F.pow(x, lam) - 1) / lam)


def yeo_johnson(x: Column | str, lam: Column | float) -> Column:
    x = col(x)
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    mirror = F.lit(2.0) - lam
    down = F.when(F.abs(mirror) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, mirror) - 1) / mirror)
    return F.when(x >= 0, up).otherwise(down)


def clipped_log10(x: Column | str) -> Column:
    return F.log10(F.greatest(col(x), F.lit(1e-12)))


# --- F11 tone mapping ----------------------------------------------------------------------------------------------
def colour_map(g: Column, r: Column, z: Column, q: float = 8.0, stretch: float = 0.5) -> tuple[Column, Column, Column]:
    """(red, green, blue) in [0, 1] with red = z, green = r, blue = g; the hue is kept when a channel overflows."""
    red, green, blue = (F.greatest(c, F.lit(0.0)) for c in (z, r, g))
    mean = (red + green + blue) / 3
    gain = F.asinh(q * mean / stretch) / q / F.greatest(mean, F.lit(1e-12))
    red, green, blue = red * gain, green * gain, blue * gain
    top = F.greatest(red, green, blue, F.lit(1.0))
    return red / top, green / top, blue / top


def eight_bit(c: Column | str) -> Column:
    return F.floor(clip(c, 0.0, 1.0) * 255).cast("int")


# --- F12 strings ---------------------------------------------------------------------------------------------------
ID_PATTERN = r"^\d+-\d+$"


def normal_id(c: Column | str) -> Column:
    return F.trim(col(c).cast("string"))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def run_name(family: Column, seed: Column) -> Column:
    return F.concat_ws("_", F.lit("pred"), family, F.format_string("s%02d", seed))


# --- F14 arrays ----------------------------------------------------------------------------------------------------
def vector_half(v: Column | str, first: bool) -> Column:
    v = col(v)
    half = F.floor(F.size(v) / 2).cast("int")
    return F.slice(v, F.lit(1), half) if first else F.slice(v, half + 1, half)


def vector_mean(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


# --- F15 / P07 lookups ---------------------------------------------------------------------------------------------
def lookup(code: Column | str, table: Mapping, default=None) -> Column:
    """Map lookup with a default, for code tables fixed in the source."""
    pairs: list[Column] = []
    for k, v in table.items():
        pairs += [F.lit(k), F.lit(v)]
    found = F.create_map(*pairs)[col(code)]
    return found if default is None else F.coalesce(found, F.lit(default))


def band_order(wanted: Sequence[str], stored: Sequence[str] = ("g", "r", "z")) -> list[int]:
    return [stored.index(b) for b in wanted]
