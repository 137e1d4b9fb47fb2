"""Readers, schema guards and ingest normalisation for inventory tables."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

GROUND, NOISE = 2, 18


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def is_canopy(classification: str = "classification") -> Column:
    return ~F.col(classification).isin(GROUND, NOISE)


def canopy_scan(points: DataFrame) -> DataFrame:
    return require_columns(points, ["x", "y", "z", "classification"]).where(is_canopy())


def panoptic_scan(points: DataFrame) -> DataFrame:
    """Labelled returns of segmented trees; an unlabelled part counts as leaf (2)."""
    return (require_columns(points, ["inst", "semantic"]).where("inst >= 0")
            .withColumn("semantic", F.coalesce("semantic", F.lit(2))))


def scaled_volumes(df: DataFrame) -> DataFrame:
    return require_columns(df, ["arv", "talhao", "v", "d_cm", "h_m"])


def surveyed_positions(df: DataFrame) -> DataFrame:
    """Positions whose name is a plain number, with that number as ``arv``."""
    require_columns(df, ["name", "easting", "northing"])
    return df.where(F.trim("name").rlike("^[0-9]+$")).withColumn("arv", F.trim("name").cast("int"))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """CSV with separator ``,``, ``;`` or tab (the commonest in its header), names trimmed.

    Falls back to latin-1 when any line is not valid UTF-8.
    """
    lines = spark.read.text(path)
    head = lines.first()[0]
    charset = "UTF-8" if lines.where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"
    sep = max([",", ";", "\t"], key=head.count)
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=True, encoding=charset)
    return df.toDF(*[c.strip() for c in df.columns])


def reconcile(metrics: DataFrame, inventory: DataFrame, keys: Sequence[str], target: str, tol: float = 0.5) -> DataFrame:
    """Metrics joined with the inventory on ``keys``; fails on lost rows or a target mismatch above ``tol``."""
    inv = inventory.select(*keys, F.col(target).alias("__t"))
    both = metrics.join(inv, list(keys))
    check = (metrics.join(inv, list(keys), "left")
             .agg(F.count(F.lit(1)).alias("n"), F.count("__t").alias("m"),
                  F.max(F.abs(F.col(target) - F.col("__t"))).alias("d")).first())
    n = metrics.count()
    if check.n != n or check.m != n:
        raise ValueError(f"{n} metric rows, {check.m} matched in the inventory")
    if check.d is not None and check.d > tol:
        raise ValueError(f"{target} differs by {check.d} (tolerance {tol})")
    return both.drop("__t").withColumn("plot_id", F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))


def census_counts(census: DataFrame, keys: Sequence[str] = ("plot",)) -> DataFrame:
    """Live stems (non-null diameter) per plot with mean diameter and height."""
    return (census.where(F.col("d_cm").isNotNull()).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_live"), F.avg("d_cm").alias("d_mean"), F.avg("h_m").alias("h_mean")))


def check_counts(census: DataFrame, reported: DataFrame, keys: Sequence[str] = ("plot",), most: int = 1) -> DataFrame:
    """Raises unless totals agree and no plot is off by more than ``most``."""
    both = census_counts(census, keys).join(reported, list(keys), "full")
    d = F.coalesce("n_live", F.lit(0)) - F.coalesce("n_arv", F.lit(0))
    r = both.agg(F.sum(d).alias("t"), F.max(F.abs(d)).alias("m")).first()
    if r.t or (r.m or 0) > most:
        raise ValueError(f"census and report differ: total {r.t}, worst plot {r.m}")
    return both


def tile_parts(tile: str | Column) -> tuple[Column, Column, Column]:
    """Stand, plot and view numbers out of ``t<stand>_p<plot>[_v<view>]``."""
    t = F.col(tile) if isinstance(tile, str) else tile
    def num(p: str) -> Column:
        s = F.regexp_extract(t, p, 1)
        return F.when(s != "", s.cast("int"))
    return num(r"^t(\d+)"), num(r"_p(\d+)"), num(r"_v(\d+)")


def species_key(name: str | Column, width: int = 3) -> Column:
    """Letters and zero-padded number of a file name such as ``FS7_x`` -> ``FS_007``."""
    c = F.col(name) if isinstance(name, str) else name
    return F.concat(F.upper(F.regexp_extract(c, r"^([A-Za-z]+)", 1)), F.lit("_"),
                    F.lpad(F.regexp_extract(c, r"^[A-Za-z]+_?(\d+)", 1), width, "0"))


def spacing_pair(text: str | Column) -> tuple[Column, Column]:
    """The two numbers of a spacing text with decimal commas: (larger, smaller)."""
    c = F.col(text) if isinstance(text, str) else text
    nums = F.transform(F.regexp_extract_all(F.replace(c, F.lit(","), F.lit(".")), F.lit(r"\d+\.?\d*"), F.lit(0)),
                       lambda s: s.cast("double"))
    two = F.sort_array(F.slice(nums, 1, 2), asc=False)
    ok = F.size(nums) >= 2
    return F.when(ok, F.get(two, F.lit(0))), F.when(ok, F.get(two, F.lit(1)))


def relabel(points: DataFrame, least: int = 50) -> DataFrame:
    """External labels 1/2/3 to 0/1/2, background 0 dropped, then trees under ``least`` returns dropped."""
    p = points.where("label between 1 and 3").withColumn("semantic", F.col("label") - 1)
    big = p.groupBy("inst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return p.join(big.select("inst"), "inst", "left_semi")


def litres_to_m3(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) / 1000.0 for c in columns})


def distil(points: DataFrame) -> DataFrame:
    """One row per segmented instance; a batch with no instance is an error upstream."""
    return (points.where("inst >= 0").groupBy("tile", "inst")
            .agg(F.min("x").alias("base_x"), F.min("y").alias("base_y"), F.avg("x").alias("cent_x"),
                 F.avg("y").alias("cent_y"), F.max("z").alias("z_max"), F.count(F.lit(1)).alias("n_pts")))


def distil_parts(points: DataFrame) -> DataFrame:
    """What ``distil`` needs of a part of the points, in a form that adds up."""
    return (points.where("inst >= 0").groupBy("tile", "inst")
            .agg(F.min("x").alias("base_x"), F.min("y").alias("base_y"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"),
                 F.max("z").alias("z_max"), F.count(F.lit(1)).alias("n_pts")))


def distil_merge(parts: DataFrame) -> DataFrame:
    """``distil`` of all points from any split of them into parts."""
    n = F.sum("n_pts")
    return parts.groupBy("tile", "inst").agg(
        F.min("base_x").alias("base_x"), F.min("base_y").alias("base_y"), (F.sum("sum_x") / n).alias("cent_x"), (F.sum("sum_y") / n).alias("cent_y"),
        F.max("z_max").alias("z_max"), n.alias("n_pts"))


def drop_replays(df: DataFrame, keys: Sequence[str] = ("tile", "inst")) -> DataFrame:
    return df.dropDuplicates(list(keys))


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n, t in df.dtypes if t in ("double", "float")})


def assert_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raises when any listed value is null, NaN or infinite."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in columns]
    found = {c: n for c, n in df.agg(*bad).first().asDict().items() if n}
    if found:
        raise ValueError(f"non-finite values: {found}")
    return df


def select_features(df: DataFrame, excluded: Sequence[str], crown_only: bool = False,
                    stem_words: Sequence[str] = ("d_at", "trunk", "stem", "dbh")) -> DataFrame:
    """Numeric columns not excluded and at most half null (one null-count aggregate)."""
    numeric = [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    cols = [c for c in numeric if c not in set(excluded)
            and not (crown_only and any(w in c.lower() for w in stem_words))]
    r = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in cols]).first()
    return df.select(*[c for c in cols if r[c] > 0 and (r["__n"] - r[c]) <= 0.5 * r["__n"]])
