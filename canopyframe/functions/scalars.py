"""Forest formulas and plane geometry as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Published coefficients of the inventory equations.
HYPSOMETRIC = (2.6939602, -9.9588349, 0.3348264)
MEAN_TREE_VOLUME = (-4.90367e-03, 1.40300e-04, 3.21600e-05, 3.57810e-04)
DIAMETER_RANGE_CM = (4.0, 45.0)
Z_975 = 1.959963984540054


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v))


def clip(v, lo, hi) -> Column:
    return F.least(F.greatest(_c(v), _c(lo)), _c(hi))


def sq(v) -> Column:
    return _c(v) * _c(v)


def hyp(a, b) -> Column:
    return F.sqrt(sq(a) + sq(b))


def hypsometric_height(d, hdom, coef=HYPSOMETRIC) -> Column:
    b0, b1, b2 = coef
    return F.exp(F.lit(b0) + F.lit(b1) / _c(d) + F.lit(b2) * F.log(_c(hdom)))


def hypsometric_diameter(h, hdom, coef=HYPSOMETRIC, bounds=DIAMETER_RANGE_CM) -> Column:
    """Diameter whose height is ``h``; a vanishing denominator counts as -0.001."""
    b0, b1, b2 = coef
    den = F.log(_c(h)) - b0 - F.lit(b2) * F.log(_c(hdom))
    den = F.when(F.abs(den) < 1e-3, F.lit(-1e-3)).otherwise(den)
    return clip(F.lit(b1) / den, *bounds)


def mean_tree_volume(d, h, coef=MEAN_TREE_VOLUME) -> Column:
    c0, c1, c2, c3 = coef
    return F.lit(c0) + F.lit(c1) * sq(d) + F.lit(c2) * sq(d) * _c(h) + F.lit(c3) * _c(h)


def volume_from_height(h, a, b) -> Column:
    return F.exp(_c(a) + _c(b) * F.log(F.greatest(_c(h), F.lit(1e-3))))


def volume_from_diameter_height(d, h, a, b, c) -> Column:
    return F.exp(_c(a) + _c(b) * F.log(_c(d)) + _c(c) * F.log(_c(h)))


def form_factor_volume(d_cm, h_m, form=0.5) -> Column:
    return F.pi() * sq(_c(d_cm) / 200.0) * _c(h_m) * F.lit(form)


def stem_biomass(d_cm, h_m, density=0.5) -> Column:
    ok = (_c(d_cm) > 0) & (_c(h_m) > 0) & F.lit(density > 0)
    return F.when(ok, F.exp(F.lit(-2.977) + F.log(F.lit(density) * sq(d_cm) * _c(h_m))))


def smalian(d1_cm, d2_cm, length) -> Column:
    return F.pi() / 8 * (sq(_c(d1_cm) / 100.0) + sq(_c(d2_cm) / 100.0)) * _c(length)


def huber(d_mid_cm, length) -> Column:
    return F.pi() / 4 * sq(_c(d_mid_cm) / 100.0) * _c(length)


def site_index(hdom, age, ref_age=7.0, b=1.0) -> Column:
    return _c(hdom) * F.pow(F.lit(ref_age) / _c(age), F.lit(b))


def above_ground_biomass(vol_ha, basic_density=0.5, expansion=1.0) -> Column:
    return _c(vol_ha) * F.lit(basic_density) * F.lit(expansion)


def density_per_ha(count, area_ha) -> Column:
    return _c(count) / _c(area_ha)


def adaptive_radius(spacing, fraction=0.8, lo=1.0, hi=2.0, default=1.5) -> Column:
    known = _c(spacing).isNotNull() & ~F.isnan(_c(spacing))
    return F.when(known, clip(_c(spacing) * F.lit(fraction), lo, hi)).otherwise(F.lit(float(default)))


def diameter_from_volume(v, h, form=0.5) -> Column:
    return F.when((_c(h) > 0) & (_c(v) > 0), F.sqrt(_c(v) / (F.pi() / 4 * _c(h) * F.lit(form))) * 100)


def circle_overlap(d, r, big) -> Column:
    """Area shared by circles of radii ``r`` and ``big`` whose centres are ``d`` apart."""
    d, r, big = _c(d), _c(r), _c(big)

    def part(own: Column, other: Column) -> Column:
        a = F.acos(clip((d * d + own * own - other * other) / (F.lit(2.0) * d * own), -1.0, 1.0))
        return own * own * (a - F.sin(F.lit(2.0) * a) / 2)

    inside = F.pi() * sq(F.least(r, big))
    return (F.when(d >= r + big, F.lit(0.0)).when(d <= F.abs(big - r), inside)
            .otherwise(part(r, big) + part(big, r)))


def circumcircle(ax, ay, bx, by, cx, cy) -> tuple[Column, Column, Column]:
    """Centre and radius through three points, null when they are (nearly) collinear.

    Coordinates are taken relative to the first point to keep digits.
    """
    px, py, qx, qy = _c(bx) - _c(ax), _c(by) - _c(ay), _c(cx) - _c(ax), _c(cy) - _c(ay)
    det = F.lit(2.0) * (px * qy - py * qx)
    det = F.when(F.abs(det) >= 1e-12, det)
    p2, q2 = px * px + py * py, qx * qx + qy * qy
    ux, uy = (qy * p2 - py * q2) / det, (px * q2 - qx * p2) / det
    return _c(ax) + ux, _c(ay) + uy, F.sqrt(ux * ux + uy * uy)


def wrapped(v, period) -> Column:
    """Distance to the nearest multiple of ``period``."""
    m = F.pmod(_c(v), _c(period))
    return F.least(m, _c(period) - m)


def ratio(a, b) -> Column:
    """a / b, and 0 when b is 0."""
    return F.when(_c(b) != 0, _c(a) / _c(b)).otherwise(F.lit(0.0))


def precision_recall_f1(tp, n_pred, n_ref) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, n_pred), ratio(tp, n_ref)
    return p, r, ratio(F.lit(2.0) * p * r, p + r)


def rotate(x, y, px, py, angle, flip) -> tuple[Column, Column]:
    """Turn by ``angle`` radians about (px, py), mirroring x first where ``flip``."""
    dx, dy = _c(x) - _c(px), _c(y) - _c(py)
    dx = F.when(flip, -dx).otherwise(dx)
    c, s = F.cos(_c(angle)), F.sin(_c(angle))
    return _c(px) + c * dx - s * dy, _c(py) + s * dx + c * dy


def unrotate(x, y, px, py, angle, flip) -> tuple[Column, Column]:
    dx, dy = _c(x) - _c(px), _c(y) - _c(py)
    c, s = F.cos(_c(angle)), F.sin(_c(angle))
    ux, uy = c * dx + s * dy, c * dy - s * dx
    return _c(px) + F.when(flip, -ux).otherwise(ux), _c(py) + uy
