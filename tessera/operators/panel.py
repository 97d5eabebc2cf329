"""Panel operators: completeness, closure, log ratios, seasonal adjustment, node features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.sources import files
from tessera.sources.adapters import MONTHS, SUFFIXES

CLIP = 1e-4
EARTH_KM = 6371.0088


def month_grid(spark, first: str, last: str) -> DataFrame:
    dates = F.sequence(F.to_date(F.lit(first + "-01")), F.to_date(F.lit(last + "-01")), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(dates).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))


def completeness(panel: DataFrame, months: int = MONTHS) -> DataFrame:
    """core: all months; else where the gap is: left, right or internal."""
    g = panel.groupBy("entity").agg(F.countDistinct("month_idx").alias("n"), F.min("month_idx").alias("lo"), F.max("month_idx").alias("hi"))
    kind = (
        F.when(F.col("n") == months, "core")
        .when((F.col("lo") > 0) & (F.col("n") == F.col("hi") - F.col("lo") + 1) & (F.col("hi") == months - 1), "left")
        .when((F.col("hi") < months - 1) & (F.col("n") == F.col("hi") - F.col("lo") + 1) & (F.col("lo") == 0), "right")
        .when((F.col("lo") == 0) & (F.col("hi") == months - 1), "internal")
        .otherwise("mid")
    )
    return g.select("entity", F.col("n").alias("n_months"), kind.alias("kind"))


def core(panel: DataFrame, months: int = MONTHS) -> DataFrame:
    full = panel.groupBy("entity").agg(F.countDistinct("month_idx").alias("n")).filter(F.col("n") == months)
    return panel.join(full.select("entity"), "entity", "left_semi")


def closed(panel: DataFrame) -> DataFrame:
    """Shares of the parts; the last is one minus the others."""
    first = {f"share_{s}": F.col(f"val_{s}") / F.col("val_all") for s in SUFFIXES[:-1]}
    out = panel.withColumns(first)
    return out.withColumn(f"share_{SUFFIXES[-1]}", F.lit(1.0) - sum(F.col(c) for c in first))


def clr(shares: DataFrame, clip: float = CLIP) -> DataFrame:
    logs = {s: F.log(F.greatest(F.col(f"share_{s}"), F.lit(clip))) for s in SUFFIXES}
    mean = sum(logs.values()) / len(SUFFIXES)
    return shares.withColumns({f"clr_{s}": x - mean for s, x in logs.items()})


def seasonal(panel: DataFrame) -> DataFrame:
    """log_all, sa_all (less the entity's mean of the calendar month), yoy_all."""
    cal = W.partitionBy("entity", F.col("month_idx") % 12)
    by = W.partitionBy("entity").orderBy("month_idx")
    out = panel.withColumn("log_all", F.log("val_all"))
    year_ago = F.when(F.lag("month_idx", 12).over(by) == F.col("month_idx") - 12, F.col("log_all") - F.lag("log_all", 12).over(by))
    return out.withColumns({"sa_all": F.col("log_all") - F.avg("log_all").over(cal), "yoy_all": year_ago})


def growth(panel: DataFrame) -> DataFrame:
    """Month-on-month change of sa_all, less its mean over the entities of the month."""
    by = W.partitionBy("entity").orderBy("month_idx")
    g = seasonal(core(panel)).withColumn("g", F.col("sa_all") - F.lag("sa_all").over(by)).filter("g is not null")
    return g.withColumn("resid", F.col("g") - F.avg("g").over(W.partitionBy("month_idx")))


def node_features(panel: DataFrame) -> DataFrame:
    p = clr(closed(seasonal(core(panel))))
    return p.groupBy("entity").agg(
        F.avg("log_all").alias("level_mean"),
        F.max_by("log_all", "month_idx").alias("level_end"),
        F.median("yoy_all").alias("yoy_median"),
        (F.percentile("yoy_all", 0.75) - F.percentile("yoy_all", 0.25)).alias("yoy_iqr"),
        *[F.avg(f"clr_{s}").alias(f"clr_{s}_mean") for s in SUFFIXES],
        *[(F.max_by(f"clr_{s}", "month_idx") - F.min_by(f"clr_{s}", "month_idx")).alias(f"clr_{s}_delta") for s in SUFFIXES],
    )


def amplitude(panel: DataFrame) -> DataFrame:
    """December over the year's other months, July-August over the year, profile deviation."""
    cal, year = F.col("month_idx") % 12, F.floor(F.col("month_idx") / 12)
    p = core(panel).withColumns({"cal": cal, "year": year})
    per_year = p.groupBy("entity", "year").agg(
        (F.avg(F.when(F.col("cal") == 11, F.col("val_all"))) / F.avg(F.when(F.col("cal") < 11, F.col("val_all")))).alias("dec"),
        (F.avg(F.when(F.col("cal").isin(6, 7), F.col("val_all"))) / F.avg("val_all")).alias("summer"),
    )
    profile = p.groupBy("entity", "cal").agg(F.avg("val_all").alias("m")).groupBy("entity").agg((F.stddev_pop("m") / F.avg("m")).alias("season_sd"))
    return per_year.groupBy("entity").agg(F.avg("dec").alias("dec_amp"), F.avg("summer").alias("summer_amp")).join(profile, "entity")


def impute(nodes: DataFrame, value: str, group: str) -> DataFrame:
    """Group median, then the median of all; with a flag."""
    per = nodes.groupBy(group).agg(F.median(value).alias("_g"))
    whole = nodes.agg(F.median(value).alias("_a"))
    out = nodes.join(F.broadcast(per), group, "left").crossJoin(F.broadcast(whole))
    return out.withColumns({f"{value}_missing": F.col(value).isNull(), value: F.coalesce(value, "_g", "_a")}).drop("_g", "_a")


def impute_scaled(nodes: DataFrame, value: str, group: str) -> DataFrame:
    """``impute``, and z by the mean and sample deviation of the observed rows only."""
    seen = nodes.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    full = impute(nodes, value, group).crossJoin(F.broadcast(seen))
    return full.withColumn("z", F.coalesce(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")


def zscore(x: str, sample: bool = False) -> Column:
    w = W.partitionBy(F.lit(0))
    sd = (F.stddev_samp(x) if sample else F.stddev_pop(x)).over(w)
    return F.coalesce(F.try_divide(F.col(x) - F.avg(x).over(w), sd), F.lit(0.0))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def resolve_validity(rows: DataFrame, key: str, until: str, open_end: int = 9999) -> DataFrame:
    """One row per key: the open-ended one, else the latest."""
    w = W.partitionBy(key).orderBy((F.col(until) == open_end).desc(), F.col(until).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rolling(panel: DataFrame, value: str, n: int = 6) -> DataFrame:
    """Slope, its t statistic (0 for a perfect fit) and population deviation of the last n months."""
    w = W.partitionBy("entity").orderBy("month_idx").rowsBetween(-(n - 1), 0)
    x, full = F.col("month_idx").cast("double"), F.count(value).over(w) == n
    sxx, syy, sxy = F.regr_sxx(value, x).over(w), F.regr_syy(value, x).over(w), F.regr_sxy(value, x).over(w)
    slope = sxy / sxx
    sse = F.greatest(syy - slope * sxy, F.lit(0.0))
    t = F.when(sse < 1e-12, 0.0).otherwise(slope / F.sqrt(sse / (n - 2) / sxx))
    return panel.withColumns({"slope": F.when(full, slope), "t": F.when(full, t), "vol": F.when(full, F.stddev_pop(value).over(w))})


def left_one(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join that fails if ``table`` has a key twice."""
    if not table.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return rows.join(table, key, "left")


def nearest_known(points: DataFrame, known: DataFrame) -> DataFrame:
    """entity, nearest, km: for each point the closest known one (the smallest id on ties). The
    points are the few that have no match of their own; the known ones are dealt in blocks."""
    k = known.select(F.col("entity").alias("nearest"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    far = points.crossJoin(k).withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    best = far.groupBy("entity").agg(F.min(F.struct("km", "nearest")).alias("b"))
    return best.select("entity", "b.nearest", "b.km")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows in a total order with their place from 1: a range partition sorts in parts, whose sizes
    give the first place of each part."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.reread(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per part
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_place", place).join(starts, "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_before", "_place")


def aligned(panel: DataFrame, value: str, months: int = MONTHS) -> DataFrame:
    """entity, m0, m1, ...: one column a month; an entity with a missing month is an error."""
    wide = panel.groupBy("entity").pivot("month_idx", list(range(months))).agg(F.first(value))
    if not wide.filter(" or ".join(f"`{k}` is null" for k in range(months))).isEmpty():
        raise ValueError("series are not complete")
    return wide.withColumnsRenamed({str(k): f"m{k}" for k in range(months)})


def placed(points: DataFrame, group: str, lat: float, lon: float) -> DataFrame:
    """Coordinates with gaps filled by the group's median, else by a fixed point."""
    mid = points.groupBy(group).agg(F.median("lat").alias("_lat"), F.median("lon").alias("_lon"))
    out = points.join(mid, group, "left").withColumn("filled", F.col("lat").isNull())
    return out.withColumns({"lat": F.coalesce("lat", "_lat", F.lit(lat)), "lon": F.coalesce("lon", "_lon", F.lit(lon))}).drop("_lat", "_lon")


def first_year(totals: DataFrame, preference: list[int]) -> DataFrame:
    """k, v: the value of the first year of ``preference`` that has a positive one."""
    rank = F.array_position(F.array(*map(F.lit, preference)), F.col("y"))
    return totals.filter((rank > 0) & (F.col("v") > 0)).groupBy("k").agg(F.min_by("v", rank).alias("v"))


def cascade(a: DataFrame, b: DataFrame, rules: list) -> DataFrame:
    """a, b, how: for each a the first rule (from 1) whose form of the name some b shares, then the
    smallest b."""
    found = None
    for n, rule in enumerate(rules, 1):
        one = a.select("a", rule(F.col("name")).alias("_n")).join(b.select("b", rule(F.col("name")).alias("_n")), "_n").select("a", "b", F.lit(n).alias("how"))
        one = one.groupBy("a").agg(F.min(F.struct("how", "b")).alias("m"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("a").agg(F.min("m").alias("m")).select("a", "m.b", "m.how")
