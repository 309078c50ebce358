"""Registered queries: name -> (Spark query, SQL that gives the same rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nested
from ..functions import values as V
from ..operators import audit, federated, lifetime, metrics, places, quantiles, roles, rules, runlog, sampling, trajectories, windows
from ..sources import archives, footers, records, samples, sensors, store
from ..streaming import follow
from . import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and without a negative zero, so that sums in another order compare equal."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


@query(f"""with {T.EVENTS}, len as (select dataset, split, unit, count(*) as n from obs group by all)
select dataset, split, sum(n)::bigint as n_rows, count(*) as n_units, min(n) as len_min, floor(quantile_cont(n, 0.25))::bigint as len_q25, floor(quantile_cont(n, 0.5))::bigint as len_median,
  floor(quantile_cont(n, 0.75))::bigint as len_q75, max(n) as len_max, 2 as n_channels, (sum(n) * 8)::bigint as float32_bytes from len group by 1, 2""")
def audit_shape(spark: SparkSession, d: str) -> DataFrame:
    return audit.shape(T.event_rows(spark, d))


_CHANNELS = f"""{T.EVENTS}, stats as (
  select dataset, channel, count(*) as n, round(avg((value is null)::int) * 100, 2) as missing_pct, coalesce(var_samp(value), 0) as variance, avg(value) as mean, min(value) as low, max(value) as high from long group by 1, 2
), q as (
  select s.dataset, s.channel, any_value(s.n) as n, any_value(missing_pct) as missing_pct, any_value(variance) as variance, any_value(low) as low, any_value(high) as high,
    avg(case when abs(value - mean) > 5 * sqrt(variance) and variance > 0 then 1.0 else 0.0 end) * 100 as outlier_pct
  from long l join stats s on s.channel = l.channel group by 1, 2
)"""


@query(f"with {_CHANNELS} select dataset, channel, n, missing_pct, round(variance, 6) as variance, low, high, round(outlier_pct, 6) as outlier_pct from q")
def audit_channels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.channel_quality(T.event_rows(spark, d)))


@query(f"""with {_CHANNELS} select dataset, max(missing_pct) as missing_max_pct, quantile_cont(missing_pct, 0.5) as missing_median_pct, count(*) filter (variance < 1e-10) as n_constant,
  avg((variance < 1e-10)::int) * 100 as constant_pct, min(low) as global_min, max(high) as global_max, round(avg(outlier_pct), 6) as outlier_pct from q group by 1""")
def audit_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.quality(T.event_rows(spark, d)))


@query(f"""with {T.EVENTS}, m as (select dataset, channel, unit, avg(value) as m from long group by all), c as (select dataset, channel, var_samp(m) as v, kurtosis(m) as k from m group by all)
select dataset, round(avg(v), 6) as drift_variance, round(avg(k), 6) as drift_kurtosis from c group by 1""")
def audit_drift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.drift(T.event_rows(spark, d)))


@query(f"""with {T.EVENTS}, c as (select dataset, target, count(*) as n from obs group by all)
select dataset, round(sum(n) filter (target is not null) * 100 / sum(n), 4) as label_coverage_pct, count(target) as n_classes, round(min(n) / max(n), 4) as class_balance from c group by 1""")
def audit_labels(spark: SparkSession, d: str) -> DataFrame:
    return audit.labels(T.event_rows(spark, d))


@query(f"""with {T.EVENTS}, steps as (select dataset, unit, time, time - lag(time) over (partition by unit order by pos) as d from obs),
per as (select dataset, unit, count(*) as n, quantile_cont(d, 0.5) filter (d > 0) as median, quantile_cont(d, 0.25) filter (d > 0) as q25, quantile_cont(d, 0.75) filter (d > 0) as q75,
  stddev_pop(d) filter (d > 0) as deviation, count(time) - count(distinct time) as duplicates, coalesce(min(d), 0) > 0 as increasing from steps group by 1, 2 having count(*) >= 2),
gaps as (select s.dataset, count(*) filter (d > 3 * median) as gaps, max(d) filter (d > 3 * median) as gap_max from steps s join per p on p.unit = s.unit group by 1)
select p.dataset, round(quantile_cont(median, 0.5), 6) as delta_median, round(quantile_cont(q25, 0.5), 6) as delta_q25, round(quantile_cont(q75, 0.5), 6) as delta_q75, round(avg(deviation / median), 6) as irregularity,
  sum(duplicates)::bigint as duplicates, avg(increasing::int) * 100 as increasing_pct, any_value(gaps) as gaps, round(any_value(gap_max), 6) as gap_max,
  round(case when avg(deviation / median) < 0.05 then 1 / quantile_cont(median, 0.5) end, 6) as inferred_rate
from per p join gaps g on g.dataset = p.dataset group by 1""")
def audit_time(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.time_regularity(T.event_rows(spark, d)))


def _windows_sql(source: str, channels: int, w: int, s: int, p: int, pad: bool) -> str:
    """The counts by cutting the windows, which the query avoids."""
    return f"""with {source}, len as (select dataset, split, unit, count(*) as n from obs group by all),
full_ as (select *, case when n <= {w} then 0 else (n - {w}) // {s} + 1 end as f from len),
r as (select *, case when n <= {w} then n else n - ((f - 1) * {s} + {w}) end as rest from full_),
t as (select *, case when n <= {w} then 1 when rest > 0 then {int(pad)} else 0 end as tail from r),
c as (select dataset, split, f + tail as n_windows, case when tail = 1 and rest < {w} then 1 else 0 end as n_padded, f * {w // p} + tail * ((rest + {p - 1}) // {p}) as valid_patches, (f + tail) * {w // p} as dense_patches,
  case when n <= {w} then 0 else rest * (1 - tail) end as dropped_rows from t),
g as (select dataset, split, sum(n_windows)::bigint as n_windows, sum(n_padded)::bigint as n_padded, sum(valid_patches)::bigint as valid_patches, sum(dense_patches)::bigint as dense_patches, sum(dropped_rows)::bigint as dropped_rows from c group by 1, 2)
select *, {channels} as n_channels, valid_patches * {channels} as channel_patches, round(n_padded / n_windows, 6) as padding_ratio, round(1 - valid_patches / dense_patches, 6) as invalid_ratio,
  round(dense_patches / valid_patches, 6) as dense_over_valid, ceil(n_windows / 5000)::bigint as n_shards, round(n_windows * {channels * w * 4} / 1e6, 6) as size_mb from g"""


@query(_windows_sql(T.EVENTS, 2, 64, 32, 8, True))
def audit_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.window_estimate(T.event_rows(spark, d), 64, 32, 8))


@query(_windows_sql(T.EVENTS, 2, 64, 32, 8, False))
def audit_windows_drop(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.window_estimate(T.event_rows(spark, d), 64, 32, 8, "drop"))


@query(_windows_sql(T.LINEITEM, 4, 512, 256, 16, True))
def audit_windows_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.window_estimate(T.lineitem_rows(spark, d), 512, 256, 16))


@query(f"""with {T.NATIONS} select dataset, case when dataset = 'NATION_3' then 'drop' when channel_patches / patches > 26 then 'drop' when client = 'ASIA' then 'target' when length_median < 200 then 'drop' when n_units < 2 then 'drop' else 'source' end as role from nations""")
def dataset_roles(spark: SparkSession, d: str) -> DataFrame:
    n = T.nation_table(spark, d)
    role, _ = audit.decide_role(F.col("dataset") == "NATION_3", F.when(F.col("channel_patches") / F.col("patches") > 26, 100.0).otherwise(0.0), F.lit(0.0), F.col("client") == "ASIA", F.col("length_median").cast("long"), F.when(F.col("n_units") < 2, 1).otherwise(1000))
    return n.select("dataset", role.alias("role"))


@query(f"""with {T.NATIONS} select dataset, unnest(list_filter([case when n_units < 4 then 'few_units' end, case when length_median < 590 then 'short_median' end, case when patches > 3000 then 'dominance' end], lambda x: x is not null)) as warning from nations""")
def dataset_warnings(spark: SparkSession, d: str) -> DataFrame:
    rules = {"few_units": F.col("n_units") < 4, "short_median": F.col("length_median") < 590, "dominance": F.col("patches") > 3000}
    return audit.warnings(T.nation_table(spark, d), rules)


@query(f"with {T.NATIONS} select dataset, round(patches / sum(patches) over (), 6) as w_patches, round(channel_patches / sum(channel_patches) over (), 6) as w_channel_patches from nations where client <> 'ASIA'")
def dataset_shares(spark: SparkSession, d: str) -> DataFrame:
    return audit.shares(T.nation_table(spark, d), ["patches", "channel_patches"], F.col("client") != "ASIA").select("dataset", "w_patches", "w_channel_patches")


@query(f"""with {T.NATIONS}, g as (select client, count(*) as n_datasets, sum(patches)::bigint as patches, sum(n_units)::bigint as n_units, string_agg(dataset, ',' order by patches desc, n_units desc, dataset desc) as names from nations group by 1)
select *, round(patches * 100 / sum(patches) over (), 2) as patches_pct, round(n_units * 100 / sum(n_units) over (), 2) as n_units_pct from g""")
def client_groups(spark: SparkSession, d: str) -> DataFrame:
    grouped = audit.group_clients(T.nation_table(spark, d).withColumnRenamed("client", "domain"), ["EUROPE"])
    out = audit.client_summary(grouped, ["patches", "n_units"])
    return out.withColumn("names", F.array_join(F.transform("datasets", lambda x: x["dataset"]), ",")).drop("datasets")


@query(f"with {T.NATIONS} select dataset, patches, n_units from nations order by patches desc, dataset limit 10")
def top_datasets(spark: SparkSession, d: str) -> DataFrame:
    return T.nation_table(spark, d).select("dataset", "patches", "n_units").orderBy(F.desc("patches"), "dataset").limit(10)


@query(f"""with {T.EVENTS}, m as (select unit, max(m) as m from (select unit, channel, avg((value is null)::int) as m from long group by 1, 2) group by 1),
k as (select o.* from obs o join m using (unit) where m.m <= 0.05),
f as (select *, last_value(x0 ignore nulls) over b as v0, last_value(case when x0 is not null then pos end ignore nulls) over b as p0, first_value(x0 ignore nulls) over a as v1, first_value(case when x0 is not null then pos end ignore nulls) over a as p1,
    last_value(x1 ignore nulls) over b as w0, last_value(case when x1 is not null then pos end ignore nulls) over b as q0, first_value(x1 ignore nulls) over a as w1, first_value(case when x1 is not null then pos end ignore nulls) over a as q1
  from k window b as (partition by unit order by pos rows between unbounded preceding and current row), a as (partition by unit order by pos rows between current row and unbounded following))
select unit, pos, x0, x1, round(coalesce(x0, v0 + (v1 - v0) * (pos - p0) / (p1 - p0), v0, v1), 6) as x0_filled, round(coalesce(x1, w0 + (w1 - w0) * (pos - q0) / (q1 - q0), w0, w1), 6) as x1_filled from f""")
def clean_series(spark: SparkSession, d: str) -> DataFrame:
    kept = trajectories.drop_sparse(T.event_rows(spark, d), ["unit"], 0.05)
    wide = kept.select("unit", F.col("pos").cast("long").alias("pos"), F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))
    return rounded(trajectories.interpolate(wide, ["unit"], ["x0", "x1"]))


@query(f"""with {T.EVENTS}, u as (select distinct unit, unit % 4 as subset from obs), r as (select *, row_number() over (partition by subset order by md5(concat('42:', subset, ':', unit)), unit) as r, count(*) over (partition by subset) as n from u)
select unit, subset, r <= greatest(1, round_even(n * 0.2, 0)) as held from r""")
def validation_units(spark: SparkSession, d: str) -> DataFrame:
    units = T.event_rows(spark, d).select("unit", (F.col("unit") % 4).alias("subset")).distinct()
    return trajectories.hold_out(units, ["unit"], 0.2, 42, ["subset"])


@query(f"with {T.EVENTS} select unit from (select distinct unit from obs) order by md5(concat('42:', unit)), unit limit 40")
def sampled_units(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.sample_units(T.event_rows(spark, d).select("unit").distinct(), ["unit"], 40, 42)


@query(f"""with {T.EVENTS}, i as (select distinct split, 'k' || (unit % 12) as trajectory_id from obs), s as (select distinct split from i)
select a.split as split_a, b.split as split_b, (select count(*) from i x join i y on x.trajectory_id = y.trajectory_id where x.split = a.split and y.split = b.split) as n_shared from s a join s b on a.split < b.split""")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    ids = T.event_rows(spark, d).select("split", F.concat(F.lit("k"), F.col("unit") % 12).alias("trajectory_id"))
    return trajectories.split_overlap(ids)


@query(f"""with {T.EVENTS}, l as (select split, unit, count(*) as n from obs group by 1, 2), m as (select split, quantile_cont(n, 0.5) as m from l group by 1)
select l.split, arg_min(unit, (abs(n - m), unit)) as unit from l join m on m.split = l.split group by 1""")
def representative_units(spark: SparkSession, d: str) -> DataFrame:
    lengths = T.event_rows(spark, d).groupBy("split", "unit").agg(F.count("*").alias("n"))
    return trajectories.representative(lengths, ["split"])


@query(f"""with {T.EVENTS}, n as (select split, count(distinct unit) as u, count(*) as r from obs group by 1), t as (select sum(u) as u, sum(r) as r, count(*) as s from n)
select 'splits' as name, s::varchar as observed, '3' as expected, s = 3 as passed from t union all select 'rows', r::bigint::varchar, (select count(*) from events)::varchar, r = (select count(*) from events) from t
union all select 'units', u::bigint::varchar, (select count(distinct user_id) from events)::varchar, true from t""")
def corpus_checks(spark: SparkSession, d: str) -> DataFrame:
    per = T.event_rows(spark, d).groupBy("split").agg(F.count_distinct("unit").alias("u"), F.count("*").alias("r"))
    raw = T.read(spark, d, "events").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"))
    totals = per.agg(F.sum("u").alias("u"), F.sum("r").alias("r"), F.count("*").alias("s")).crossJoin(raw)
    return trajectories.check_table(totals, splits=(F.col("s"), F.lit(3).cast("long")), rows=(F.col("r"), F.col("rows")), units=(F.col("u"), F.col("users")))


_TILES = f"""{T.EVENTS}, n as (select unit, count(*) as n from obs group by 1), f as (select unit, n, case when n <= 64 then 1 else (n - 64) // 32 + 1 end as f from n),
starts as (select unit, i as w_idx, i * 32 as w_start from (select unit, unnest(range(f)) as i from f) union all select unit, f, (f - 1) * 32 + 64 from f where n > 64 and n > (f - 1) * 32 + 64),
tiles as (select s.unit, w_idx, w_start, pos - w_start as w_pos, x0, x1, target from starts s join obs o on o.unit = s.unit and pos between w_start and w_start + 63)"""


@query(f"with {_TILES} select unit, w_idx, w_start, count(*) as n_rows, sum(w_pos)::bigint as pos_sum, arg_max(target, w_pos) as target from tiles group by 1, 2, 3")
def tiling_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.tile(T.event_rows(spark, d), ["unit"], 64, 32)
    return rows.groupBy("unit", F.col("w_idx").cast("long").alias("w_idx"), F.col("w_start").cast("long").alias("w_start")).agg(F.count("*").alias("n_rows"), F.sum("w_pos").alias("pos_sum"), F.max_by("target", "w_pos").alias("target"))


_CHANNEL_TILES = f"{_TILES}, l as (select unit, w_idx, w_pos, 0 as channel, x0 as value from tiles union all select unit, w_idx, w_pos, 1, x1 from tiles)"


@query(f"""with {_CHANNEL_TILES}, s as (select unit, w_idx, channel, count(value) as n, avg(value) as m, var_pop(value) as v from l group by 1, 2, 3),
z as (select l.unit, l.w_idx, w_pos, l.channel, value, n as n_values, case when n < 2 then value else (value - m) / (case when v < 1e-6 then 1 else sqrt(v) end) end as z, n >= 2 and v < 1e-6 as constant from l join s on s.unit = l.unit and s.w_idx = l.w_idx and s.channel = l.channel)
select unit, w_idx, w_pos, channel, value, round(z, 6) + 0.0 as z, constant, n_values, round(coalesce(sum(abs(z)) over (partition by unit, w_idx, channel), 0), 5) as size from z""")
def normalized_windows(spark: SparkSession, d: str) -> DataFrame:
    """Each value of all windows and channels before and after normalization, beside its channel's known values and size."""
    rows = windows.tile(T.event_rows(spark, d), ["unit"], 64, 32)
    out = windows.normalize(rows, ["unit", "w_idx"])
    group = Window.partitionBy("unit", "w_idx", "channel")
    size = F.round(F.coalesce(F.sum(F.abs("z")).over(group), F.lit(0.0)), 5).alias("size")
    return out.select("unit", F.col("w_idx").cast("long").alias("w_idx"), F.col("w_pos").cast("long").alias("w_pos"), "channel", "value", (F.round("z", 6) + 0.0).alias("z"), "constant", F.count("value").over(group).alias("n_values"), size)


@query(f"""with {_CHANNEL_TILES}, s as (select unit, w_idx, channel, count(*) as r, count(value) as n, avg(value) as m, var_pop(value) as v from l group by 1, 2, 3),
z as (select l.unit, l.w_idx, l.channel, w_pos // 8 as p, case when n < 2 then value else (value - m) / (case when v < 1e-6 then 1 else sqrt(v) end) end as z from l join s on s.unit = l.unit and s.w_idx = l.w_idx and s.channel = l.channel),
t as (select unit, w_idx, channel, p, sum(z) as total from z group by 1, 2, 3, 4),
w as (select s.unit, s.w_idx, count(*) as n_channels, max(ceil(r / 8))::bigint as valid_patches, max(r) as n_rows, any_value(size) as size from s left join (select unit, w_idx, sum(abs(z)) as size from z group by 1, 2) using (unit, w_idx) group by 1, 2)
select s.unit, s.w_idx, s.channel, k.p as patch, 8 as width, round(coalesce(t.total, 0), 6) + 0.0 as total, r > k.p * 8 as valid, greatest(0, least(8, r - k.p * 8)) as n_valid, n_channels, 8 as n_patches, valid_patches, n_rows, round(coalesce(w.size, 0), 5) as size
from s join w using (unit, w_idx) cross join range(8) k(p) left join t on t.unit = s.unit and t.w_idx = s.w_idx and t.channel = s.channel and t.p = k.p""")
def window_patches(spark: SparkSession, d: str) -> DataFrame:
    """Each patch of all windows and channels, beside its window's channels, valid patches, real rows and size."""
    rows = windows.tile(T.event_rows(spark, d), ["unit"], 64, 32)
    p = windows.patches(windows.normalize(rows, ["unit", "w_idx"]), ["unit", "w_idx"], 64, 8)
    added = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))
    true = lambda c: F.size(F.filter(c, lambda x: x)).cast("long")
    counts = [F.size("patches").cast("long").alias("n_channels"), F.size(F.col("patches")[0]).alias("n_patches"), true("valid_patch").alias("valid_patches"), true("valid_time").alias("n_rows")]
    size = F.round(added(F.flatten(F.flatten("patches")), F.abs), 5).alias("size")
    each = p.select("unit", F.col("w_idx").cast("long").alias("w_idx"), "valid_time", "valid_patch", *counts, size, F.posexplode("patches").alias("channel", "values"))
    one = each.select("*", F.posexplode(F.arrays_zip("values", F.col("valid_patch").alias("valid"))).alias("patch", "c"))
    real = true(F.slice("valid_time", F.col("patch") * 8 + 1, 8)).alias("n_valid")
    total = (F.round(added("c.values", lambda x: x), 6) + 0.0).alias("total")
    return one.select("unit", "w_idx", "channel", F.col("patch").cast("long").alias("patch"), F.size("c.values").alias("width"), total, F.col("c.valid").alias("valid"), real, "n_channels", "n_patches", "valid_patches", "n_rows", "size")


@query(f"""with {_CHANNEL_TILES}, s as (select unit, w_idx, channel, count(value) as n, avg(value) as m, var_pop(value) as v from l group by 1, 2, 3)
select l.unit, l.w_idx, w_pos, l.channel, round(case when n < 2 then value else (value - m) / (case when v < 1e-6 then 1 else sqrt(v) end) end, 6) as z, n >= 2 and v < 1e-6 as constant from l join s on s.unit = l.unit and s.w_idx = l.w_idx and s.channel = l.channel""")
def normalized_windows_all(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.tile(T.event_rows(spark, d), ["unit"], 64, 32)
    out = windows.normalize(rows, ["unit", "w_idx"])
    return rounded(out.select("unit", F.col("w_idx").cast("long").alias("w_idx"), F.col("w_pos").cast("long").alias("w_pos"), "channel", "z", "constant"))


@query(f"""with {_CHANNEL_TILES}, s as (select unit, w_idx, channel, count(*) as r, count(value) as n, avg(value) as m, var_pop(value) as v from l group by 1, 2, 3),
z as (select l.unit, l.w_idx, l.channel, w_pos // 8 as p, sum(case when n < 2 then value else (value - m) / (case when v < 1e-6 then 1 else sqrt(v) end) end) as z from l join s on s.unit = l.unit and s.w_idx = l.w_idx and s.channel = l.channel group by 1, 2, 3, 4)
select s.unit, s.w_idx, s.channel, k.p as patch, 8 as width, round(coalesce(z.z, 0), 6) + 0.0 as total, r > k.p * 8 as valid, greatest(0, least(8, r - k.p * 8)) as n_valid from s cross join range(8) k(p) left join z on z.unit = s.unit and z.w_idx = s.w_idx and z.channel = s.channel and z.p = k.p""")
def window_patches_all(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.tile(T.event_rows(spark, d), ["unit"], 64, 32)
    p = windows.patches(windows.normalize(rows, ["unit", "w_idx"]), ["unit", "w_idx"], 64, 8)
    each = p.select("unit", "w_idx", "valid_time", "valid_patch", F.posexplode("patches").alias("channel", "values"))
    one = each.select("unit", "w_idx", "channel", "valid_time", F.posexplode(F.arrays_zip("values", "valid_patch")).alias("patch", "c"))
    total = F.aggregate("c.values", F.lit(0.0), lambda a, x: a + x)
    real = F.size(F.filter(F.slice("valid_time", F.col("patch") * 8 + 1, 8), lambda x: x))
    return rounded(one.select("unit", F.col("w_idx").cast("long").alias("w_idx"), "channel", F.col("patch").cast("long").alias("patch"), F.size("c.values").alias("width"), (total + 0.0).alias("total"), F.col("c.valid_patch").alias("valid"), real.cast("long").alias("n_valid")))


_CONFIG = {"window": 64, "stride": 32, "patch": 8}


def _event_samples(spark: SparkSession, d: str, by: str = "'events'") -> DataFrame:
    rows = windows.tile(T.event_rows(spark, d).withColumn("dataset", F.expr(by)), ["unit"], 64, 32)
    return windows.sample_rows(rows, 64, 8)


@query(f"""with {_CHANNEL_TILES}, s as (select unit, w_idx, channel, count(*) as r, count(value) as n, avg(value) as m, var_pop(value) as v from l group by 1, 2, 3),
d as (select *, case when n < 2 then 0.0 else m end as mean, case when n < 2 or v < 1e-6 then 1.0 else sqrt(v) end as dev from s),
z as (select l.unit, l.w_idx, l.channel, sum((value - mean) / dev) as total from l join d on d.unit = l.unit and d.w_idx = l.w_idx and d.channel = l.channel group by 1, 2, 3),
w as (select unit, w_idx, any_value(w_start) as start, arg_max(target, w_pos) as label from tiles group by 1, 2)
select 'events-' || case when d.unit % 10 < 7 then 'train' when d.unit % 10 < 9 then 'val' else 'test' end || '-' || d.unit || '-' || d.w_idx as key, d.channel, round(mean, 6) + 0.0 as mean, round(dev, 6) as std_used, n >= 2 and v < 1e-6 as constant,
  round(coalesce(total, 0), 6) + 0.0 as total, r as n_rows, ceil(r / 8)::int as n_patches, start, label
from d join z on z.unit = d.unit and z.w_idx = d.w_idx and z.channel = d.channel join w on w.unit = d.unit and w.w_idx = d.w_idx""")
def written_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples from rows to files and back, a row for each sample and channel."""
    path = T.scratch(spark)
    samples.write_samples(_event_samples(spark, d), path)
    back = samples.read_samples(spark, path)
    each = back.select("*", F.posexplode(F.arrays_zip("patches", "mean", "std_used", "constant")).alias("channel", "c"))
    total = F.aggregate(F.flatten("c.patches"), F.lit(0.0), lambda a, x: a + x)
    valid = lambda c: F.size(F.filter(c, lambda x: x))
    counts = [valid("valid_time_mask").cast("long").alias("n_rows"), valid(F.col("valid_patch_mask")[0]).alias("n_patches")]
    return rounded(each.select("key", "channel", "c.mean", "c.std_used", "c.constant", total.alias("total"), *counts, F.col("meta.start").alias("start"), F.col("target.label").alias("label")))

@query(f"""with {_CHANNEL_TILES}, s as (select unit, w_idx, channel, count(*) as r, count(value) as n, var_pop(value) as v from l group by 1, 2, 3),
w as (select unit, w_idx, any_value(w_start)::bigint as start, arg_max(target, w_pos) as label from tiles group by 1, 2)
select 'events-' || case when unit % 10 < 7 then 'train' when unit % 10 < 9 then 'val' else 'test' end || '-' || unit || '-' || w_idx as key, channel,
  label, start, n >= 2 and v < 1e-6 as constant, r as n_rows, ceil(r / 8)::int as n_patches, 8 as n, 8 as p from s join w using (unit, w_idx)""")
def archived_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples written as archives, read by offsets and decoded, a row for each channel."""
    path = T.scratch(spark)
    rows = _event_samples(spark, d)
    archives.write_archives(rows, path, 500)
    back = archives.decode_samples(archives.read_archives(spark, path, range_bytes=1 << 20))
    each = back.select("*", F.posexplode(F.arrays_zip("patches", "valid_patch_mask", "constant")).alias("channel", "c"))
    valid = lambda c: F.size(F.filter(c, lambda x: x))
    shape = [F.size("c.patches").alias("n"), F.size(F.col("c.patches")[0]).alias("p")]
    facts = [F.get_json_object("target", "$.label").alias("label"), F.get_json_object("meta", "$.start").cast("long").alias("start")]
    return each.select("key", "channel", *facts, "c.constant", valid("valid_time_mask").cast("long").alias("n_rows"), valid("c.valid_patch_mask").alias("n_patches"), *shape)



def _samples_at_rest(spark: SparkSession, d: str) -> DataFrame:
    """Samples of four datasets, written once."""
    path = T.scratch(spark)
    samples.write_samples(_event_samples(spark, d, "concat('client', unit % 4)"), path)
    return samples.read_samples(spark, path)


_SPLITS = f"""{_TILES}, w as (select 'client' || unit % 4 as dataset, case when unit % 10 < 7 then 'train' when unit % 10 < 9 then 'val' else 'test' end as split, unit, w_idx, arg_max(target, w_pos) as label from tiles group by all)"""


@query(f"""with {_SPLITS}, per_set as (select dataset, count(*) as n_all, min(unit) % 2 = 0 as again, count(*) filter (split <> 'val') as n_rest from w group by 1)
select dataset, split, count(*) as n_samples, count(distinct unit) as n_units, min(label) as least, max(label) as greatest, 1 + any_value(again)::int as version, any_value(case when again then n_rest else n_all end)::bigint as n_dataset
from w join per_set using (dataset) where not again or split <> 'val' group by 1, 2""")
def sample_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests after four datasets are published, asked for again, and those whose first
    unit is even published in another configuration and without one split."""
    path, rows = T.scratch(spark), _samples_at_rest(spark, d)
    other = _CONFIG | {"seed": 1}
    again = rows.groupBy("dataset").agg((F.min(F.col("unit").cast("long")) % 2 == 0).alias("again")).where("again")
    for _ in range(2):
        store.publish(rows, path, _CONFIG, V.config_hash(_CONFIG))
    for _ in range(2):
        store.publish(rows.join(again, "dataset", "left_semi").where("split <> 'val'").select(*rows.columns), path, other, V.config_hash(other))
    last = store.current(store.history(spark, path))
    per = last.select("dataset", "version", F.col("n_samples").alias("n_dataset"), F.explode("splits").alias("split", "s"))
    return per.select("dataset", "split", "s.n_samples", "s.n_units", F.col("s.target_min.label").alias("least"), F.col("s.target_max.label").alias("greatest"), F.col("version").cast("int").alias("version"), "n_dataset")


@query(f"""with {_SPLITS}, per_set as (select dataset, min(unit) % 2 = 0 as again from w group by 1)
select dataset, split, unit::varchar as unit, count(*) as n_samples, min(w_idx) as first_window, max(w_idx) as last_window from w join per_set using (dataset) where not again or split <> 'val' group by 1, 2, 3""")
def stored_samples(spark: SparkSession, d: str) -> DataFrame:
    """What readers of a store see after a second version without one split, a run that
    broke off before its commit, and a third call that has nothing to write."""
    path, rows = T.scratch(spark), _samples_at_rest(spark, d)
    other = _CONFIG | {"seed": 1}
    again = rows.groupBy("dataset").agg((F.min(F.col("unit").cast("long")) % 2 == 0).alias("again")).where("again")
    second = rows.join(again, "dataset", "left_semi").where("split <> 'val'").select(*rows.columns)
    store.publish(rows, path, _CONFIG, V.config_hash(_CONFIG))
    store.publish(second, path, other, V.config_hash(other))
    store.stage(rows, path, "broken")
    if store.publish(second, path, other, V.config_hash(other)):
        raise ValueError("what stands was written again")
    back = store.read(spark, path, rows.schema)
    return back.groupBy("dataset", "split", "unit").agg(F.count("*").alias("n_samples"), F.min("meta.w_idx").alias("first_window"), F.max("meta.w_idx").alias("last_window"))


@query(f"""with {_SPLITS}, per_set as (select dataset, count(*) as n, min(unit) % 3 as k from w group by 1)
select dataset, case when k = 0 then 'SKIP' else 'STALE' end as action, case k when 0 then 'up to date' when 1 then 'metric n_windows' else 'another configuration' end as reason, n as n_windows from per_set""")
def planned_writes(spark: SparkSession, d: str) -> DataFrame:
    """What is to be done for datasets of which the metrics agree to 0.001, differ by more, or
    which are wanted in another configuration, by the first unit's remainder by three."""
    path, rows = T.scratch(spark), _samples_at_rest(spark, d)
    per = rows.groupBy("dataset").agg(F.count("*").cast("double").alias("n"), (F.min(F.col("unit").cast("long")) % 3).alias("k"))
    metrics = per.select("dataset", F.create_map(F.lit("n_windows"), "n").alias("metrics"))
    store.publish(rows, path, _CONFIG, V.config_hash(_CONFIG), metrics)
    hashes = F.when(F.col("k") == 2, V.config_hash(_CONFIG | {"seed": 1})).otherwise(V.config_hash(_CONFIG))
    off = F.when(F.col("k") == 1, 0.01).otherwise(0.0009)
    wanted = per.select("dataset", hashes.alias("config_hash"), F.create_map(F.lit("n_windows"), F.col("n") + off).alias("expected"))
    return store.actions(spark, path, wanted).join(per.select("dataset", F.col("n").cast("long").alias("n_windows")), "dataset")


@query("""select event_id as step, event_type as dataset, case when event_id % 101 = 0 then 'NaN' when event_id % 103 = 0 then 'Infinity' end as nonfinite, case when event_id % 101 <> 0 and event_id % 103 <> 0 then round(value, 6) end as loss, event_id % 5 <> 0 as optimizer_applied from events""")
def logged_steps(spark: SparkSession, d: str) -> DataFrame:
    """A training log as lines of JSON, written and read again."""
    path = T.scratch(spark)
    k = F.col("event_id")
    loss = F.when(k % 101 == 0, F.lit(float("nan"))).when(k % 103 == 0, F.lit(float("inf"))).otherwise(F.round("value", 6))
    T.read(spark, d, "events").select(k.alias("step"), F.col("event_type").alias("dataset"), loss.alias("loss"), (k % 5 != 0).alias("optimizer_applied")).write.json(path)
    back = records.read_log(spark, path)
    finite = V.finite(F.col("loss"))
    return back.where("broken is null").select("step", "dataset", F.when(finite.isNull(), F.col("loss").cast("string")).alias("nonfinite"), finite.alias("loss"), "optimizer_applied")


_LIFE = f"{T.EVENTS}, life as (select *, max(pos) over (partition by unit) - pos as rul, unit % 4 as subset, split as part, count(*) over (partition by unit) as n from obs)"


@query(f"with {_LIFE}, err as (select user_id as unit, count(*) as official from events where event_type = 'error' group by 1) select l.unit, pos, rul, rul + official as test_rul, least(rul, 50) as capped from life l join err e on e.unit = l.unit")
def remaining_life(spark: SparkSession, d: str) -> DataFrame:
    obs = T.event_rows(spark, d).select("unit", F.col("pos").cast("long").alias("pos"))
    official = T.read(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("unit")).agg(F.count("*").alias("rul"))
    train = lifetime.train_life(obs, ["unit"], "pos")
    test = lifetime.test_life(obs, official, ["unit"], "pos").select("unit", "pos", F.col("rul").alias("test_rul"))
    return train.join(test, ["unit", "pos"]).select("unit", "pos", "rul", "test_rul", V.capped(F.col("rul"), 50).cast("long").alias("capped"))


_EMIT = f"{_LIFE}, emit as (select * from life where (n > 19 and pos >= 19 and (pos - 19) % 5 = 0) or pos = n - 1)"


@query(f"""with {_EMIT}, u as (select subset, unit, any_value(n) as n, count(*) as w from emit group by 1, 2),
a as (select subset, count(*) as n_units, sum(w)::bigint as n_windows, sum(case when n <= 19 then 0 else 4 end)::bigint as n_dropped, sum(case when n <= 19 or (n - 20) % 5 <> 0 then 1 else 0 end)::bigint as n_last_added, min(n) as cycles_min, quantile_cont(n, 0.5) as cycles_median, max(n) as cycles_max from u group by rollup (subset)),
b as (select subset, min(least(rul, 50)) as rul_min, quantile_cont(least(rul, 50), 0.5) as rul_median, max(least(rul, 50)) as rul_max, count(*) filter (pos + 1 >= 32) as n_full, count(*) filter (pos + 1 < 32) as n_padded, round(sum(least(pos + 1, 32)) / (count(*) * 32), 6) as valid_share from emit group by rollup (subset))
select a.*, rul_min::double as rul_min, rul_median, rul_max::double as rul_max, n_full, n_padded, valid_share from a join b on a.subset is not distinct from b.subset""")
def life_preview(spark: SparkSession, d: str) -> DataFrame:
    obs = T.event_rows(spark, d).select("unit", (F.col("unit") % 4).alias("subset"), "pos")
    life = lifetime.train_life(obs, ["unit"], "pos")
    out = lifetime.preview(life, ["subset"], "unit", 32, 5, 20, 50.0)
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("cycles_min", "cycles_max")}))


@query(f"""with {_EMIT}, w as (select e.unit, e.pos as w_end, o.pos, 31 - e.pos + o.pos as w_pos, o.x1 from emit e join obs o on o.unit = e.unit and o.pos between e.pos - 31 and e.pos)
select unit, w_end, count(*) as n_rows, min(w_pos) as first_pos, max(w_pos) as last_pos, round(avg(x1), 6) as mean from w group by 1, 2""")
def rolling_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.roll(T.event_rows(spark, d), ["unit"], 32, 5, 20)
    return rounded(rows.groupBy("unit", F.col("w_end").cast("long").alias("w_end")).agg(F.count("*").alias("n_rows"), F.min("w_pos").cast("long").alias("first_pos"), F.max("w_pos").cast("long").alias("last_pos"), F.avg(F.col("x")[1]).alias("mean")))


@query(f"""with {T.NATIONS}, r as (select dataset, patches / sum(patches) over () as w, 0.05 as cap from nations), o as (select *, sum(cap) over (order by cap / w, dataset) - cap as before, sum(w) over (order by cap / w desc, dataset desc) as rest, row_number() over (order by cap / w, dataset) as i from r),
f as (select *, (1 - before) / rest as f, (1 - before) / rest * w <= cap + 1e-12 as free from o), k as (select arg_min(f, i) as f from f where free)
select dataset, round(w, 9) as raw, round(case when cap * count(*) over () < 1 - 1e-12 then 1.0 / count(*) over () else least(cap, k.f * w) end, 9) as capped from f, k""")
def capped_weights(spark: SparkSession, d: str) -> DataFrame:
    t = sampling.normalized(T.nation_table(spark, d), "patches", out="raw")
    return rounded(sampling.cap_weights(t, "raw", F.lit(0.05), "dataset").select("dataset", "raw", "capped"), 9)


def _halved(name: str, table: str, by: str, total: str, value: str) -> str:
    """SQL that finds by halving the factor x with which the sum of `value` is `total`."""
    key, comma = (by, by + ", ") if by else ("1", "")
    return f"""{name}({comma}k, lo, hi) as (
  select {f'distinct {by}, ' if by else ''}0, 0.0::double, 1e6::double {f'from {table}' if by else ''} union all
  select {comma}k + 1, case when s < t then x else lo end, case when s < t then hi else x end
  from (select {f'b.{by}, ' if by else ''}k, lo, hi, (lo + hi) / 2 as x, sum({value}) as s, max({total}) as t from {name} b join {table} v on {f'v.{by} = b.{by}' if by else 'true'} where k < 110 group by {f'b.{by}, ' if by else ''}k, lo, hi)
)"""


@query(f"""with recursive {T.NATIONS}, raw as (select dataset, client, patches, patches / sum(patches) over () as w from nations),
{_halved('b1', 'raw', '', '1.0', 'least(0.1, (lo + hi) / 2 * w)')},
capped as (select raw.*, case when count(*) over () * 0.1 < 1 - 1e-12 then 1.0 / count(*) over () else least(0.1, hi * w) end as c from raw, b1 where k = 110),
sums as (select client, sum(c) as s, count(*) as n, sum(w) as r, least(0.25, 0.1 * count(*)) as cap from capped group by 1),
{_halved('b2', 'sums', '', '1.0', 'least(cap, (lo + hi) / 2 * v.s)')},
limited as (select sums.*, case when sum(cap) over () < 1 - 1e-12 then 1.0 / count(*) over () else least(cap, hi * s) end as cc from sums, b2 where k = 110),
{_halved('b3', 'limited', '', '1.0', 'greatest(0.005, (lo + hi) / 2 * cc)')},
targets as (select limited.*, greatest(0.005, hi * cc) as goal from limited, b3 where k = 110),
wanted as (select capped.*, goal from capped join targets using (client)),
{_halved('b4', 'wanted', 'client', 'goal', 'least(0.1, (lo + hi) / 2 * c)')},
last as (select wanted.*, case when count(*) over (partition by wanted.client) * 0.1 < goal - 1e-12 then goal / count(*) over (partition by wanted.client) else least(0.1, hi * c) end as f from wanted join b4 on b4.client = wanted.client where k = 110),
shares as (select *, f / sum(f) over () as share from last)
select dataset, s.client, patches, round(w, 9) as raw_dataset_weight, round(c, 9) as capped_dataset_weight, round(share, 9) as final_dataset_weight, round(r, 9) as raw_client_weight, round(sum(share) over (partition by s.client), 9) as final_client_weight,
  round(share * 1000, 9) as expected_batches, c < w - 1e-9 as dataset_capped, false as dataset_lifted, cc < t.s - 1e-9 as client_capped, goal_ > cc + 1e-9 as client_lifted
from shares s join (select client, r, cc, s, goal as goal_ from targets) t on t.client = s.client""")
def sampling_plan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.sampling_plan(T.nation_table(spark, d), steps=1000), 9)


@query(f"with {T.NATIONS} select dataset, client, round(patches / sum(patches) over (partition by client), 9) as share from nations")
def client_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.normalized(T.nation_table(spark, d), "patches", ["client"]).select("dataset", "client", "share"), 9)


@query("""with r as (select event_type as dataset, event_id, row_number() over (partition by event_type order by md5(concat('7:', event_id)), event_id) - 1 as r, count(*) over (partition by event_type) as n, case when length(event_type) > 5 then 16 else 24 end as b from events)
select dataset, event_id, r // b as batch from r where (r // b + 1) * b <= n""")
def sample_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = T.read(spark, d, "events").select(F.col("event_type").alias("dataset"), "event_id")
    size = V.adaptive_batch(F.when(F.length("dataset") > 5, 32).otherwise(20), 24, 512)
    return sampling.number_batches(rows, ["dataset"], "event_id", size, seed=7).select("dataset", "event_id", "batch")


@query(f"""with {T.NATIONS}, p as (select dataset, patches / sum(patches) over () as share from nations), c as (select *, sum(share) over (order by dataset) as upper, row_number() over (order by dataset) - 1 as i, count(*) over () as n from p),
s as (select event_id as step, ('0x' || substr(md5(concat('3:', event_id)), 1, 8))::bigint / 4294967296.0 as u from events), dr as (select step, dataset from s join c on (u >= upper - share and u < upper) or (i = n - 1 and u >= upper)),
o as (select dataset, count(*) as k from dr group by 1)
select p.dataset, round(share, 6) as expected, round(coalesce(k, 0) / (select count(*) from dr), 6) as observed, round(abs(coalesce(k, 0) / (select count(*) from dr) - share), 6) as error from p left join o on o.dataset = p.dataset""")
def draw_shares(spark: SparkSession, d: str) -> DataFrame:
    plan = sampling.normalized(T.nation_table(spark, d), "patches").select("dataset", "share")
    steps = T.read(spark, d, "events").select(F.col("event_id").alias("step"))
    return rounded(sampling.draw_shares(sampling.draw_schedule(plan, steps, seed=3), plan))


@query(f"with {T.NATIONS}, c as (select dataset, row_number() over (order by dataset) - 1 as i, count(*) over () as n from nations) select event_id as step, dataset from events join c on event_id % n = i")
def draw_in_turn(spark: SparkSession, d: str) -> DataFrame:
    steps = T.read(spark, d, "events").select(F.col("event_id").alias("step"))
    return sampling.draw_schedule(T.nation_table(spark, d).select("dataset"), steps, strategy="round_robin")


_CELLS = """cells as (select vec_id, i as patch, i % 4 as channel, (vec_id + i) % 5 <> 0 as valid, embedding[i + 1]::double as value, label from (select *, unnest(range(64)) as i from embeddings)),
marked as (select *, valid and row_number() over (partition by vec_id, channel order by valid desc, md5(concat('5:', vec_id, ':', channel, ':', patch)), patch) <= least(n, greatest(1, round_even(n * 0.3, 0))) as masked from (select *, sum(valid::int) over (partition by vec_id, channel) as n from cells))"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("patch", "value"))
    return e.select(F.col("vec_id"), "label", F.col("patch").cast("long").alias("patch"), (F.col("patch") % 4).cast("long").alias("channel"), ((F.col("vec_id") + F.col("patch")) % 5 != 0).alias("valid"), F.col("value").cast("double").alias("value"))


@query(f"with {_CELLS} select vec_id, patch, valid, masked from marked")
def hidden_patches(spark: SparkSession, d: str) -> DataFrame:
    return windows.choose_masks(_cells(spark, d), ["vec_id", "channel"], 0.3, seed=5).select("vec_id", "patch", "valid", "masked")


@query(f"""with {_CELLS}, e as (select label, case when masked and valid then value - 0.01 * channel end as d, masked and not valid as p, masked and valid as k, valid from marked)
select label, round(coalesce(sum(d * d), 0) / greatest(sum(k::int), 1), 6) as mse, round(coalesce(sum(abs(d)), 0) / greatest(sum(k::int), 1), 6) as mae, sum(k::int)::bigint as n_elements, count(*) filter (p) as padding_ignored, round(sum(k::int) / sum(valid::int), 6) as mask_ratio from e group by 1""")
def masked_errors(spark: SparkSession, d: str) -> DataFrame:
    cells = windows.choose_masks(_cells(spark, d), ["vec_id", "channel"], 0.3, seed=5)
    rows = cells.withColumn("target", F.col("channel") * 0.01).withColumn("prediction", F.col("value"))
    return rounded(windows.reconstruction_error(rows, "label").join(windows.mask_ratio(cells, "label"), "label"))


@query("""with t as (select vec_id, i // 16 as channel, (i % 16) // 4 as patch, i % 4 as dim, embedding[i + 1]::double as value, (vec_id + i // 4) % 3 <> 0 as valid, (vec_id + i // 16) % 4 = 0 as constant from (select *, unnest(range(64)) as i from embeddings)),
p as (select vec_id, channel, dim, avg(value) filter (valid) as v, bool_or(constant) as c from t group by 1, 2, 3)
select vec_id, dim, round(coalesce(avg(v) filter (not c), avg(v), 0), 6) as value from p group by 1, 2""")
def pooled_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "value"))
    i = F.col("i").cast("long")
    tokens = e.select("vec_id", F.floor(i / 16).alias("channel"), F.floor(i % 16 / 4).alias("patch"), (i % 4).alias("dim"), F.col("value").cast("double").alias("value"), ((F.col("vec_id") + F.floor(i / 4)) % 3 != 0).alias("valid"), ((F.col("vec_id") + F.floor(i / 16)) % 4 == 0).alias("constant"))
    return rounded(windows.pool(tokens, ["vec_id"]))


@query(f"with {T.FLAGS} select y, yhat, n from matrix")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(T.flag_pairs(spark, d), 4)


@query(f"with {T.FLAGS} select class, support, predicted, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from classes")
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_class(metrics.confusion(T.flag_pairs(spark, d), 4)))


@query(f"with {T.FLAGS} select (select count(*) from pairs) as n_samples, round((select avg((y = yhat)::int) from pairs), 6) as accuracy, round(avg(recall), 6) as balanced_accuracy, round(avg(f1), 6) as macro_f1 from classes")
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.classification(metrics.confusion(T.flag_pairs(spark, d), 4)))


@query(f"with {T.FLAGS} select label, row_number() over (order by label) - 1 as class, n from (select label, count(*) as n from pairs group by 1)")
def label_map(spark: SparkSession, d: str) -> DataFrame:
    return metrics.label_map(T.flag_pairs(spark, d))


@query("""with m as (select avg(l_extendedprice / l_quantity) as u from lineitem), p as (select l_returnflag as flag, l_extendedprice / 1000 as y, l_quantity * u / 1000 as yhat from lineitem, m)
select flag, count(*) as test_n, round(avg(abs(yhat - y)), 6) as test_mae, round(sqrt(avg((yhat - y) ** 2)), 6) as test_rmse, round(1 - sum((yhat - y) ** 2) / (var_pop(y) * count(y)), 6) as test_r2,
  round(sum(case when yhat < y then exp((y - yhat) / 13) - 1 else exp((yhat - y) / 10) - 1 end), 2) as test_score from p group by 1""")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    li = T.read(spark, d, "lineitem")
    unit = li.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("u"))
    rows = li.crossJoin(unit).select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * F.col("u") / 1000).alias("yhat"))
    return rounded(metrics.regression(rows, "flag", prefix="test_").withColumn("test_score", F.round("test_score", 2)))


@query(f"""with {T.LOG}, g as (select case when grouping(dataset) = 0 then 'dataset' when grouping(client) = 0 then 'client' else 'all' end as level, dataset, client, count(*) as n_batches, count(*) filter (x is null) as n_nonfinite, coalesce(sum(n_elements) filter (x is not null), 0)::bigint as n_elements,
  round(sum(x * n_elements) / sum(n_elements) filter (x is not null), 6) as loss, count(distinct dataset) as n_datasets, round(avg(batch_cost), 6) as cost_mean, max(batch_cost) as cost_max from fin group by grouping sets ((), (dataset), (client))) select * from g""")
def weighted_losses(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.weighted_losses(T.log_rows(spark, d)))


@query(f"""with {T.LOG}, b as (select *, case when step < 200 then '0-200' when step < 2000 then '200-2000' else '2000-' end as bucket from fin)
select dataset, bucket, count(x) as n, round(avg(x), 6) as mean, round(quantile_cont(x, 0.1), 6) as p10, round(quantile_cont(x, 0.5), 6) as median, round(quantile_cont(x, 0.9), 6) as p90, round(min(x), 6) as low, round(max(x), 6) as high,
  round(avg(x) filter (coalesce(optimizer_applied, true) and not coalesce(bad_gradient, false)), 6) as clean_mean from b group by 1, 2""")
def log_buckets(spark: SparkSession, d: str) -> DataFrame:
    log = runlog.in_buckets(T.log_rows(spark, d), [(0, 200), (200, 2000), (2000, None)])
    return rounded(runlog.loss_statistics(log, "dataset", "bucket"))


@query(f"""with {T.LOG}, b as (select *, case when step < 100 then '0-100' when step < 1000 then '100-1000' when step < 5000 then '1000-5000' else '5000-' end as bucket from fin)
select bucket, count(x) as n, round(avg(x), 6) as mean, round(quantile_cont(x, 0.1), 6) as p10, round(quantile_cont(x, 0.5), 6) as median, round(quantile_cont(x, 0.9), 6) as p90, round(min(x), 6) as low, round(max(x), 6) as high,
  round(avg(x) filter (coalesce(optimizer_applied, true) and not coalesce(bad_gradient, false)), 6) as clean_mean from b group by 1""")
def log_buckets_all(spark: SparkSession, d: str) -> DataFrame:
    log = runlog.in_buckets(T.log_rows(spark, d), [(0, 100), (100, 1000), (1000, 5000), (5000, None)])
    return rounded(runlog.loss_statistics(log, "bucket"))


@query(f"with {T.LOG}, k as (select dataset, case when isnan(loss) then 'nan' when isinf(loss) then 'inf' else noted end as kind from log) select dataset, kind, count(*) as n from k where kind is not null group by 1, 2")
def log_nonfinite(spark: SparkSession, d: str) -> DataFrame:
    return runlog.nonfinite_counts(T.log_rows(spark, d), ["loss"], "dataset", "noted")


@query(f"with {T.LOG} select step, dataset, round(loss, 6) as loss from fin where x >= 1000")
def log_huge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runlog.huge_losses(T.log_rows(spark, d)).select("step", "dataset", "loss"))


@query(f"with {T.LOG} select step, round(loss, 6) as loss from fin where x is not null order by loss desc, step limit 20")
def log_top(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runlog.top_losses(T.log_rows(spark, d)).select("step", "loss"))


@query(f"""with {T.LOG}, t as (select *, x - 20 as t from fin) select dataset as split, count(*) as n_samples, count(t) as n, count(*) - count(t) as n_missing, round(min(t), 6) as low, round(max(t), 6) as high, round(avg(t), 6) as mean, round(quantile_cont(t, 0.5), 6) as median,
  count(*) filter (t < 0) as n_negative, round(count(*) filter (t < 0) / count(t), 6) as negative_share from t group by 1""")
def target_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = T.log_rows(spark, d).select(F.col("dataset").alias("split"), (F.col("loss") - 20).alias("target"))
    return rounded(runlog.target_statistics(rows))


@query(f"""with {T.EVENTS}, p as (select split, unit, arg_max(value, pos) - arg_min(value, pos) as d from obs group by 1, 2 having count(*) > 1)
select split, count(*) as n_multi, count(*) filter (d < -1e-9) as falling, count(*) filter (d > 1e-9) as rising, count(*) filter (abs(d) <= 1e-9) as flat from p group by 1""")
def target_trends(spark: SparkSession, d: str) -> DataFrame:
    rows = T.event_rows(spark, d).select("split", "unit", F.col("pos").alias("idx"), F.col("value").alias("target"))
    return runlog.target_trends(rows)


@query("select event_type as target, greatest(0, least(20, floor(value / 25)::bigint + 1)) as bin, count(*) as n from events where value is not null group by 1, 2")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events")
    return runlog.histogram(e.withColumnRenamed("event_type", "target"), "value", 0.0, 500.0, 20, "target")


@query("select event_type as target, greatest(0, least(21, floor(value / 25)::bigint + 1)) as bin, count(*) as n from events where value is not null group by 1, 2")
def value_histogram_all(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events")
    return runlog.histogram(e.withColumnRenamed("event_type", "target"), "value", 0.0, 500.0, 20, "target", beyond=True)


_MODES = "rows as (select o_orderpriority as dataset, o_orderstatus as mode, ascii(o_orderstatus) as mode_order, avg(o_totalprice) / 1e6 as macro_f1 from orders group by all)"


def _modes(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("mode")).agg((F.avg("o_totalprice") / 1e6).alias("macro_f1"))
    return o.withColumn("mode_order", F.ascii("mode"))


@query(f"with {_MODES} select dataset, arg_max(mode, macro_f1) as mode, round(max(macro_f1), 6) as macro_f1 from rows group by 1")
def best_modes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runlog.best_mode(_modes(spark, d)))


@query(f"""with {_MODES}, b as (select dataset, macro_f1 as base from rows where mode = 'O') select r.dataset, mode, round(macro_f1, 6) as macro_f1, round(base, 6) as base, round(macro_f1 - base, 6) as delta, round((macro_f1 - base) / base, 6) as relative,
  case when macro_f1 - base < -0.001 then 'below the baseline' else '' end as notes from rows r left join b using (dataset) where mode <> 'O'""")
def mode_differences(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runlog.against_baseline(_modes(spark, d), "O", loss_limit=0.001))


@query("""with t as (select n_name as task, case when n_nationkey % 6 = 0 then 'planned' else 'ready' end as status from nation), c as (select r_name as checkpoint from region)
select task, mode, checkpoint, 'planned' as status from t, (values ('linear'), ('full')) m(mode), c where status = 'ready' union all select task, 'scratch', null, 'planned' from t where status = 'ready' union all select task, null, null, 'skipped' from t where status <> 'ready'""")
def run_matrix(spark: SparkSession, d: str) -> DataFrame:
    tasks = T.read(spark, d, "nation").select(F.col("n_name").alias("task"), F.when(F.col("n_nationkey") % 6 == 0, "planned").otherwise("ready").alias("status"))
    modes = spark.createDataFrame([("scratch", False), ("linear", True), ("full", True)], "mode string, needs_checkpoint boolean")
    return runlog.run_matrix(tasks, modes, T.read(spark, d, "region").select(F.col("r_name").alias("checkpoint")))


@query("""with r as (select o_orderpriority as suite, case when o_orderstatus = 'F' then 'ok' when o_orderstatus = 'O' then 'failed' else 'partial' end as status from orders)
select suite, count(*) filter (status = 'ok') as n_ok, count(*) filter (status = 'partial') as n_partial, count(*) filter (status = 'failed') as n_failed, 0 as n_skipped, 'ok' as status from r group by 1""")
def suite_summary(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "failed").otherwise("partial")
    return runlog.suite_summary(T.read(spark, d, "orders").select(F.col("o_orderpriority").alias("suite"), status.alias("status")), "suite")


@query(f"with {T.STATES} select param, idx, round(value, 6) as value from center")
def mean_parameters(spark: SparkSession, d: str) -> DataFrame:
    states = T.states(spark, d)
    return rounded(federated.mean_state(states, _client_weights(states)))


@query(f"with {T.ALL_STATES} select param, idx, round(value, 6) as value from center")
def mean_parameters_all(spark: SparkSession, d: str) -> DataFrame:
    states = T.all_states(spark, d)
    return rounded(federated.mean_state(states, _client_weights(states)))


def _client_weights(states: DataFrame) -> DataFrame:
    return states.select("client").distinct().select("client", (F.col("client") + 1).cast("double").alias("w"))


@query(f"""with {T.STATES} select client, round(sqrt(sum(s.value ** 2)), 6) as l2, round(sqrt(sum((s.value - c.value) ** 2)), 6) as drift from states s join center c on c.param = s.param and c.idx = s.idx group by 1""")
def parameter_norms(spark: SparkSession, d: str) -> DataFrame:
    states = T.states(spark, d)
    drift = federated.drift(states, federated.mean_state(states, _client_weights(states))).withColumnRenamed("l2", "drift")
    return rounded(federated.norm(states, "client").join(drift, "client"))


@query(f"""with {T.ALL_STATES} select client, round(sqrt(sum(s.value ** 2)), 6) as l2, round(sqrt(sum((s.value - c.value) ** 2)), 6) as drift from states s join center c on c.param = s.param and c.idx = s.idx group by 1""")
def parameter_norms_all(spark: SparkSession, d: str) -> DataFrame:
    states = T.all_states(spark, d)
    drift = federated.drift(states, federated.mean_state(states, _client_weights(states))).withColumnRenamed("l2", "drift")
    return rounded(federated.norm(states, "client").join(drift, "client"))


@query(f"""with {T.STATES}, a as (select param, idx, value from states where client = 0), d as (select a.param, a.idx, a.value, c.value - a.value as d, a.value * 0.1 as v0 from a join center c on c.param = a.param and c.idx = a.idx)
select param, idx, round(value + d + 0.9 * (0.9 * v0 + d), 6) as value, round(0.9 * v0 + d, 6) as velocity from d""")
def server_momentum(spark: SparkSession, d: str) -> DataFrame:
    states = T.states(spark, d)
    own = states.where("client = 0").select("param", "idx", "value")
    change = federated.delta(federated.mean_state(states, _client_weights(states)), own)
    return rounded(federated.momentum(own, own.select("param", "idx", (F.col("value") * 0.1).alias("velocity")), change, 0.9, nesterov=True))


@query(f"""with {T.ALL_STATES}, a as (select param, idx, value from states where client = 0), d as (select a.param, a.idx, a.value, c.value - a.value as d, a.value * 0.1 as v0 from a join center c on c.param = a.param and c.idx = a.idx)
select param, idx, round(value + d + 0.9 * (0.9 * v0 + d), 6) as value, round(0.9 * v0 + d, 6) as velocity from d""")
def server_momentum_all(spark: SparkSession, d: str) -> DataFrame:
    states = T.all_states(spark, d)
    own = states.where("client = 0").select("param", "idx", "value")
    change = federated.delta(federated.mean_state(states, _client_weights(states)), own)
    return rounded(federated.momentum(own, own.select("param", "idx", (F.col("value") * 0.1).alias("velocity")), change, 0.9, nesterov=True))


@query("""with r as (select l_linenumber as round, l_suppkey % 5 as client, avg(l_quantity) as loss, sum(l_tax) as norm, count(*)::double as w from lineitem group by 1, 2), s as (select round, count(*) as n_clients, sum(w * loss) / sum(w) as loss, avg(norm) as norm_mean, stddev_pop(norm) as norm_std, 2.0 * 800000 * 4 * 5 / 1048576 as mb from r group by 1)
select round, n_clients, round(loss, 6) as loss, round(norm_mean, 6) as norm_mean, round(norm_std, 6) as norm_std, round(mb, 6) as mb, round(sum(mb) over (order by round), 6) as mb_total from s""")
def round_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = T.read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("round"), (F.col("l_suppkey") % 5).alias("client")).agg(F.avg("l_quantity").alias("loss"), F.sum("l_tax").alias("norm"), F.count("*").cast("double").alias("w"))
    return rounded(federated.round_summary(rows, V.communication_mb(F.lit(800000), F.lit(5))))


@query("""with e as (select distinct user_id, event_type, value from events)
select user_id, regexp_replace(event_type || '.x-1', '[^\\p{L}\\p{N}]', '_', 'g') as text_slug, user_id::varchar as id_slug, case when value = floor(value) then value::bigint::varchar else replace(replace(value::varchar, '.', 'p'), '-', 'n') end as value_slug,
  'events__subset-none__split-train__unit-' || user_id as trajectory_id, 'events__subset-none__unit-' || user_id as asset_key, 'train__' || user_id as short_id, printf('s_FD%s_train_train_unit%d_w%06d', event_type, user_id, user_id) as sample_key from e""")
def series_ids(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").select("user_id", "event_type", "value").distinct()
    unit, none = V.slug(F.col("user_id"), "bigint"), V.slug(F.lit(None).cast("string"), "string")
    train = F.lit("train")
    return e.select(
        "user_id",
        V.slug(F.concat("event_type", F.lit(".x-1")), "string").alias("text_slug"),
        unit.alias("id_slug"),
        V.slug(F.col("value"), "double").alias("value_slug"),
        V.trajectory_id(F.lit("events"), none, train, unit).alias("trajectory_id"),
        V.asset_key(F.lit("events"), none, unit).alias("asset_key"),
        V.short_trajectory_id(train, None, F.col("user_id")).alias("short_id"),
        V.sample_key("s", F.concat(F.lit("FD"), F.col("event_type")), train, V.source_split(train), F.col("user_id"), F.col("user_id")).alias("sample_key"),
    )


@query(f"""with {_TILES}, s as (select split, count(*) as n_source from obs group by 1), c as (select o.split, count(distinct (t.unit, t.w_start + t.w_pos)) as n_covered, count(*) as n_valid from tiles t join (select distinct unit, split from obs) o on o.unit = t.unit group by 1)
select s.split, n_source, n_covered, n_valid, n_source - n_covered as n_dropped from s join c on c.split = s.split""")
def window_accounting(spark: SparkSession, d: str) -> DataFrame:
    rows = T.event_rows(spark, d)
    return roles.row_accounting(rows, windows.tile(rows, ["unit"], 64, 32), ["split"])


@query("""with w as (select l_suppkey as unit, l_orderkey % 200 as w_idx, 0 as channel, count(*) as n, coalesce(var_pop(round(l_discount, 1)), 0) as v from lineitem group by 1, 2
union all select l_suppkey, l_orderkey % 200, 1, count(*), coalesce(var_pop(round(l_tax)), 0) from lineitem group by 1, 2), f as (select * from w where n >= 2 and v < 1e-6), m as (select unit, min(w_idx) as w_idx from f group by 1)
select channel, count(distinct f.unit) as n_trajectories from f join m on m.unit = f.unit and m.w_idx = f.w_idx group by 1""")
def constant_channels(spark: SparkSession, d: str) -> DataFrame:
    li = T.read(spark, d, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("unit"), (F.col("l_orderkey") % 200).alias("w_idx"), F.monotonically_increasing_id().alias("w_pos"), F.array(F.round("l_discount", 1), F.round("l_tax", 0)).alias("x"))
    return roles.constant_channels(windows.normalize(rows, ["unit", "w_idx"]))


@query(f"with {T.NATIONS} select client, dataset, round(patches / sum(patches) over (), 9) as share from nations")
def fallback_plan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(roles.fallback_plan(T.nation_table(spark, d)), 9)


@query(f"with {T.NATIONS} select dataset, case when client = 'ASIA' then 'target' end as role from nations where client = 'ASIA' or client = 'EUROPE'")
def plan_guard(spark: SparkSession, d: str) -> DataFrame:
    n = T.nation_table(spark, d)
    listed = n.where("client <> 'EUROPE'").select("dataset", F.when(F.col("client") == "ASIA", "target").otherwise("source").alias("role"))
    return roles.not_sources(n, listed)


@query("""with a as (select l_returnflag as split, count(*) as n from lineitem group by 1), b as (select l_returnflag as split, count(*) as n from lineitem where l_returnflag <> 'A' and l_quantity > 0 group by 1)
select split, a.n as n_preview, b.n as n_written from a full join b using (split) where a.n is distinct from b.n""")
def written_counts(spark: SparkSession, d: str) -> DataFrame:
    li = T.read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "split")
    count = lambda df: df.groupBy("split").agg(F.count("*").alias("n"))
    return roles.count_differences(count(li), count(li.where("split <> 'A' and l_quantity > 0")), ["split"], ["n"])


@query(f"""with {T.EVENTS} select dataset, split, count(*) as n_samples, count(distinct unit) as n_units, min(value) as target_min, max(value) as target_max from obs group by 1, 2""")
def split_statistics(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.split_statistics(T.event_rows(spark, d).withColumn("target", F.col("value")))


@query(f"""with {T.EVENTS}, n as (select dataset, split, unit, count(*) as n from obs group by all)
select dataset, split, sum(n)::bigint as n_rows, string_agg(n::varchar, ',' order by unit) as lengths from n group by 1, 2""")
def unit_lengths(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.unit_lengths(T.event_rows(spark, d)).withColumn("lengths", F.array_join(F.transform("lengths", lambda n: n.cast("string")), ","))


@query("""select l_orderkey as unit, l_linenumber as pos, case when l_returnflag = 'R' then 'returned' else 'sold' end as split, case when l_returnflag = 'R' then l_discount end as discount from lineitem""")
def joined_splits(spark: SparkSession, d: str) -> DataFrame:
    li = T.read(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "unit", "l_linenumber": "pos", "l_discount": "discount"})
    out = trajectories.join_splits(returned=li.where("l_returnflag = 'R'").select("unit", "pos", "discount"), sold=li.where("l_returnflag <> 'R'").select("unit", "pos"))
    return out.select("unit", "pos", "split", "discount")


@query("""select l_orderkey, l_partkey, l_linenumber, l_discount::double || ';' || l_tax::double || ';' || l_quantity::double || ';' || l_extendedprice::double as channels from lineitem""")
def channel_vectors(spark: SparkSession, d: str) -> DataFrame:
    li = T.read(spark, d, "lineitem").withColumn("x", windows.channel_vector(["l_discount", "l_tax"], ["l_quantity", "l_extendedprice"]))
    shown = F.array_join(F.transform("x", lambda v: F.format_string("%s", v)), ";")
    return li.select("l_orderkey", "l_partkey", "l_linenumber", shown.alias("channels"))


@query(f"""with {T.EVENTS}, w as (select unit, pos // 16 as w_idx, list((x0 is not null)::int order by pos) as v from obs group by 1, 2)
select unit, w_idx, i as patch, coalesce(list_sum(v[i * 4 + 1:i * 4 + 4]), 0)::bigint as n_valid, len(v[i * 4 + 1:i * 4 + 4]) as n_steps from w, unnest(range(4)) as t(i)""")
def patch_masks(spark: SparkSession, d: str) -> DataFrame:
    o = T.event_rows(spark, d).withColumn("w_idx", F.floor(F.col("pos") / 16))
    valid = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("x")[0].isNotNull().cast("int").alias("v")))), lambda s: s["v"])
    masks = o.groupBy("unit", "w_idx").agg(valid.alias("v")).withColumn("m", windows.patch_time_mask(F.col("v"), 4, 4))
    rows = masks.select("unit", "w_idx", F.posexplode("m").alias("patch", "steps"))
    total = F.aggregate("steps", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("unit", "w_idx", "patch", total.alias("n_valid"), F.size("steps").cast("long").alias("n_steps"))


@query(f"""with {T.NATIONS}, p as (select dataset, client, patches::double / sum(patches) over () as w from nations), c as (select client, sum(w) as w from p group by 1),
v as (select count(distinct dataset) as d, sum(w) as t, max(w) as m, count(*) filter (dataset in ('NATION_3')) as x from p), k as (select count(*) as n, max(w) as m, min(w) as l from c)
select 'datasets' as name, round(d::double, 9) as observed, d = 25 as passed from v union all select 'clients', round(n::double, 9), n = 5 from k
union all select 'weights sum to 1', round(t, 9), abs(t - 1) < 1e-9 from v union all select 'dataset cap', round(m, 9), m <= 0.1 + 1e-9 from v
union all select 'client cap', round(m, 9), m <= 0.25 + 1e-9 from k union all select 'client floor', round(l, 9), l >= 0.005 - 1e-9 from k
union all select 'no target dataset', round(x::double, 9), x = 0 from v""")
def plan_checks(spark: SparkSession, d: str) -> DataFrame:
    plan = sampling.normalized(T.nation_table(spark, d), "patches", out="final_dataset_weight")
    return sampling.plan_checks(plan, 25, 5, excluded=["NATION_3"])


@query(f"""with {T.NATIONS}, a as (select sum(patches)::double as p, sum(n_units)::double as u from nations), b as (select count(*)::double as p, count(distinct l_suppkey)::double as u from lineitem join supplier on s_suppkey = l_suppkey)
select 'patches' as measure, b.p as total, a.p as expected, a.p = b.p as passed from a, b union all select 'n_units', b.u, a.u, a.u = b.u from a, b""")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    li, s = T.read(spark, d, "lineitem"), T.read(spark, d, "supplier")
    parts = li.join(s, li.l_suppkey == s.s_suppkey).groupBy("l_suppkey").agg(F.count("*").alias("patches")).withColumn("n_units", F.lit(1))
    return audit.corpus_totals(parts, T.nation_table(spark, d), ["patches", "n_units"])


@query(f"""with {T.NATIONS}, a as (select dataset, client as domain, patches, 'SOURCE' as role from nations where client <> 'ASIA' union all select dataset, client, null, 'EXCLUDED' from nations where client = 'ASIA')
select *, row_number() over (order by role, domain, dataset) as place from a""")
def audit_listing(spark: SparkSession, d: str) -> DataFrame:
    n = T.nation_table(spark, d).select("dataset", F.col("client").alias("domain"), "patches")
    whole = audit.with_excluded(n.where("domain <> 'ASIA'").withColumn("role", F.lit("SOURCE")), n.where("domain = 'ASIA'").drop("patches"))
    return _placed(audit.audit_order(whole), "role, domain, dataset").select("dataset", "domain", "patches", "role", "place")


def _placed(listed: DataFrame, order: str) -> DataFrame:
    """Adds the place in the order of a small table (a row for each dataset)."""
    return listed.withColumn("place", F.expr(f"row_number() over (order by {order})").cast("long"))


@query(f"""with {T.NATIONS}, s as (select dataset, case when client <> 'ASIA' then patches end as size from nations) select *, row_number() over (order by size nulls last, dataset) as place from s""")
def work_plan(spark: SparkSession, d: str) -> DataFrame:
    n = T.nation_table(spark, d).select("dataset", F.when(F.col("client") != "ASIA", F.col("patches")).alias("size"))
    return _placed(audit.smallest_first(n), "size nulls last, dataset")


_FILES = """files as (select p_brand as dataset, p_name || '-' || p_partkey as file, case when p_size % 7 = 0 then 'missing' when p_size % 5 = 0 then 'partial' else 'done' end as state,
  case when p_size % 7 <> 0 then (p_retailprice * 100)::bigint end as bytes from part)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    state = F.when(size % 7 == 0, "missing").when(size % 5 == 0, "partial").otherwise("done")
    name = F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string"))
    return T.read(spark, d, "part").select(F.col("p_brand").alias("dataset"), name.alias("file"), state.alias("state"), F.when(size % 7 != 0, F.round(F.col("p_retailprice") * 100).cast("long")).alias("bytes"))


@query(f"""with {_FILES} select dataset, state, count(*) as n_files, coalesce(sum(bytes), 0)::bigint as n_bytes, round(count(*) / sum(count(*)) over (partition by dataset), 6) as share from files group by 1, 2""")
def file_states(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.file_states(_files(spark, d)))


@query(f"""with {_FILES} select dataset, file, state, bytes from files where bytes is not null order by bytes desc, file limit 10""")
def largest_files(spark: SparkSession, d: str) -> DataFrame:
    return audit.largest_files(_files(spark, d))


@query("""select event_type as mode, count(*) as n, round(avg(value), 6) as score, coalesce(list_position(['purchase', 'click'], event_type), 3)::int as place from events group by 1""")
def mode_order(spark: SparkSession, d: str) -> DataFrame:
    per = T.read(spark, d, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count("*").alias("n"), F.avg("value").alias("score"))
    return runlog.ranked(rounded(per), ["purchase", "click"])


@query(f"""with {T.NATIONS}, m as (select dataset, unnest(['patches', 'channel_patches', 'n_units', 'length_median']) as measure, unnest([patches::double, channel_patches::double, n_units::double, length_median::double]) as value from nations)
select measure, dataset, round(value, 6) as value, place from (select *, row_number() over (partition by measure order by value desc, dataset) as place from m) where place <= 10""")
def top_by_measure(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.top_by_measure(T.nation_table(spark, d), ["patches", "channel_patches", "n_units", "length_median"]))


@query("""select event_type, user_id % 3 as client, count(value) as n, quantile_cont(value, 0.001) as q001, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.9) as q90, quantile_cont(value, 0.9999) as q9999 from events group by all""")
def value_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of all values of each group, in buffers of fixed size."""
    e = T.read(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("client"), "value")
    found = quantiles.exact_quantiles(e, ["event_type", "client"], F.col("value"), [0.001, 0.25, 0.5, 0.9, 0.9999])
    return found.select("event_type", "client", "n", *(F.col("q")[i].alias(c) for i, c in enumerate(("q001", "q25", "q50", "q90", "q9999"))))


# A few trajectories that hold all rows: a unit for each type of event.
_GIANTS = """
obs as (
  select event_type as unit, event_id, (epoch_us(ts) - 1704067200000000) / 1e6 as time, case when event_id % 37 not in (0, 1, 2) then value end as x,
    row_number() over (partition by event_type order by ts, event_id) - 1 as pos, count(*) over (partition by event_type) as n_rows from events
)
"""


def _giants(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events")
    time = ((T.micros("ts") - T.START_MICROS) / 1e6).alias("time")
    rows = e.select(F.col("event_type").alias("unit"), "event_id", "ts", time, F.when(~(F.col("event_id") % 37).isin(0, 1, 2), F.col("value")).alias("x"))
    return places.place_rows(rows, ["unit"], ["ts", "event_id"], T.scratch(spark), 16)


@query(f"""with {_GIANTS}, w as (
  select unit, pos, event_id, x, k as w_idx, case when k * 256 + 512 <= n_rows or k = 0 then k * 256 end as s, k * 256 as start, n_rows,
    greatest(0, (n_rows - 512) // 256 + 1) as n_full from obs, range(0, (select max(n_rows) // 256 + 2 from obs)) r(k) where k * 256 <= pos and pos < k * 256 + 512
), full_ as (select unit, w_idx, start, event_id, x, pos from w where w_idx < greatest(n_full, 1)),
tail as (
  select unit, greatest(0, (n_rows - 512) // 256 + 1) as w_idx, ((n_rows - 512) // 256) * 256 + 512 as start, event_id, x, pos from obs where n_rows > 512 and pos >= ((n_rows - 512) // 256) * 256 + 512
)
select unit, w_idx::int as w_idx, start::int as w_start, count(*) as n_rows, count(x) as n_values, arg_min(event_id, pos) as first_event, arg_max(event_id, pos) as last_event from (select * from full_ union all select * from tail) group by 1, 2, 3""")
def giant_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tiling windows of trajectories that are too long for one task."""
    rows = windows.tile(_giants(spark, d), ["unit"], 512, 256)
    return rows.groupBy("unit", "w_idx", "w_start").agg(F.count("*").alias("n_rows"), F.count("x").alias("n_values"), F.min_by("event_id", "pos").alias("first_event"), F.max_by("event_id", "pos").alias("last_event"))


@query(f"""with {_GIANTS}, ends as (select unit, n_rows, unnest(list_distinct(list_append(range(127, n_rows, 50), n_rows - 1)))::int as w_end from (select distinct unit, n_rows from obs))
select e.unit, w_end, count(*) as n_rows, count(x) as n_values, min(pos) - w_end + 199 as first_place, arg_min(event_id, pos) as first_event
from ends e join obs o on o.unit = e.unit and pos <= w_end and pos > w_end - 200 group by e.unit, w_end""")
def giant_rolls(spark: SparkSession, d: str) -> DataFrame:
    """Causal windows, padded at the left, of trajectories that are too long for one task."""
    rows = windows.roll(_giants(spark, d), ["unit"], 200, 50, 128)
    return rows.groupBy("unit", "w_end").agg(F.count("*").alias("n_rows"), F.count("x").alias("n_values"), F.min("w_pos").cast("long").alias("first_place"), F.min_by("event_id", "pos").alias("first_event"))


@query(f"""with {_GIANTS}, near as (
  select *, last_value(x ignore nulls) over a as v0, last_value(case when x is not null then pos end ignore nulls) over a as p0,
    first_value(x ignore nulls) over b as v1, first_value(case when x is not null then pos end ignore nulls) over b as p1, time - lag(time) over (partition by unit order by pos) as step from obs
  window a as (partition by unit order by pos rows between unbounded preceding and current row), b as (partition by unit order by pos rows between current row and unbounded following)
)
select unit, pos // 500 as stretch, count(*) as n_rows, count(x) as n_values, round(sum(coalesce(x, v0 + (v1 - v0) * (pos - p0) / (p1 - p0), v0, v1)), 4) as total, count(step) as n_steps, round(sum(step), 3) as span, count(*) filter (step <= 0) as n_back
from near group by 1, 2""")
def giant_steps(spark: SparkSession, d: str) -> DataFrame:
    """Interpolation and steps in time of trajectories that are too long for one task."""
    placed = _giants(spark, d)
    filled = places.interpolate_placed(places.row_before(placed, ["unit"], "time", "earlier"), ["unit"], ["x"])
    step = F.col("time") - F.col("earlier")
    out = filled.groupBy("unit", F.floor(F.col("pos") / 500).alias("stretch")).agg(
        F.count("*").alias("n_rows"), F.count("x").alias("n_values"), F.round(F.sum("x_filled"), 4).alias("total"), F.count(step).alias("n_steps"), F.round(F.sum(step), 3).alias("span"), F.count_if(step <= 0).alias("n_back")
    )
    return out


_NESTED = "named_struct('who', user_id, 'kind', event_type, 'inner', named_struct('z', value, 'a', array(value, if(event_id % 7 = 0, double('nan'), 0.5D), null)), 'by', map('y', if(event_id % 5 = 0, double('inf'), value), 'b', -1.0D), 'pipeline_version', event_id % 3)"


@query("""with t as (
  select event_id, user_id, '{"by": {"b": -1.0, "y": ' || case when event_id % 5 = 0 then 'null' else value::varchar end || '}, "inner": {"a": [' || value::varchar || ', ' || case when event_id % 7 = 0 then 'null' else '0.5' end || ', null], "z": ' || value::varchar
    || '}, "kind": "' || event_type || '"' as head, event_id % 3 as v from events
)
select event_id, substr(sha256(head || ', "pipeline_version": ' || v || ', "who": ' || user_id || '}'), 1, 16) as hash, substr(sha256(head || ', "who": ' || user_id || '}'), 1, 16) as semantic,
  substr(sha256(replace(replace(head || ', "pipeline_version": ' || v || ', "who": ' || user_id || '}', ', ', ','), ': ', ':')), 1, 16) as compact
from t""")
def nested_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Canonical hashes of nested rows, of which some leaves aren't finite."""
    rows = T.read(spark, d, "events").select("event_id", F.expr(_NESTED).alias("row"))
    kind = rows.schema["row"].dataType
    forms = {"hash": {}, "semantic": {"without": ("pipeline_version",)}, "compact": {"form": "compact"}}
    return rows.select("event_id", *(nested.canonical_hash(F.col("row"), kind, **more).alias(c) for c, more in forms.items()))


_DRAWS = f"""{T.NATIONS}, b as (select dataset, (patches % 7)::bigint as n_batches from nations), p as (select dataset, patches / sum(patches) over () as share, n_batches from nations join b using (dataset) where n_batches > 0),
c as (select dataset, n_batches, w, s, sum(w) over (partition by s order by dataset) as upper, row_number() over (partition by s order by dataset) - 1 as i, count(*) over (partition by s) as n
  from (select *, 'weighted' as s, share as w from p union all select *, 'uniform', 1.0 / count(*) over () from p union all select *, 'round_robin', 0 from p)),
st as (select event_id as step, ('0x' || substr(md5(concat('5:', event_id)), 1, 8))::bigint / 4294967296.0 as u from events),
dr as (select s as strategy, step, dataset, n_batches from st join c on case when s = 'round_robin' then step % n = i else (u >= upper - w and u < upper) or (i = n - 1 and u >= upper) end),
k as (select *, row_number() over (partition by strategy, dataset order by step) - 1 as nth from dr),
o as (select *, nth // n_batches as opening, ('0x' || substr(md5(concat('5:', dataset, ':', nth // n_batches)), 1, 8))::bigint as h from k)"""


@query(f"""with {_DRAWS} select strategy, step, dataset, opening::bigint as opening, (([2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549][h % 6 + 1] * (nth % n_batches) + h) % n_batches)::bigint as batch from o""")
def drawn_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches by step for the three strategies; some datasets have none, all are opened again."""
    nations = T.nation_table(spark, d)
    plan = sampling.normalized(nations, "patches").select("dataset", "share")
    batches = nations.select("dataset", (F.col("patches") % 7).cast("long").alias("n_batches"))
    steps = T.read(spark, d, "events").select(F.col("event_id").alias("step"))
    out = [sampling.draw_batches(plan, batches, steps, strategy=s, seed=5).select(F.lit(s).alias("strategy"), "*") for s in ("weighted", "uniform", "round_robin")]
    return out[0].unionByName(out[1]).unionByName(out[2])


# Suppliers as datasets and nations as clients, with what an audit would say of them.
_AUDITED = """
lines as (
  select l_suppkey as k, count(*) as n_rows, count(*) filter (l_quantity > 45) as dropped, min(l_quantity) - 2 as low, (count(*) filter (l_returnflag = 'R')) / count(*) as padding, count(distinct l_orderkey) as n_orders, sum(l_linenumber) as channel_patches from lineitem group by 1
), audited as (
  select 'd' || k as dataset, 'c' || s_nationkey as client, case k % 3 when 0 then 'TRANSFER_TARGET' when 1 then 'PRETRAIN_SOURCE' else 'DROP' end as role, case when k % 2 = 0 then n_orders end as n_windows, k % 9 as n_units,
    case when k % 4 > 0 then (k % 11) / 100 end as class_balance, low, case k % 5 when 0 then 'rul' when 1 then 'regression' when 2 then 'regression_or_rul' when 3 then 'binary' end as kind, case when k % 8 > 0 then padding end as padding,
    case when k % 2 = 0 then 'pad' else 'drop' end as policy, n_orders as median, n_rows, case when k % 6 > 0 then dropped end as dropped, n_rows / sum(n_rows) over () as temporal, channel_patches / sum(channel_patches) over () as share, k
  from lines join supplier on s_suppkey = k
), per_client as (select client, sum(temporal) as temporal, sum(share) as channel from audited group by 1)
"""


@query(f"""with {_AUDITED}, said as (
  select dataset, 'tt_n_windows_bajo' as rule from audited where role = 'TRANSFER_TARGET' and n_windows < 100 union all
  select dataset, 'tt_n_units_bajo' from audited where role = 'TRANSFER_TARGET' and n_units < 5 union all
  select dataset, 'class_balance_bajo' from audited where class_balance < 0.05 union all
  select dataset, case when kind = 'regression' then 'negative_target_values' else 'rul_negative_values' end from audited where low < 0 and kind in ('rul', 'regression_or_rul', 'regression') union all
  select dataset, 'padding_ratio_alto' from audited where padding > 0.15 union all
  select dataset, 'tt_padding_alto' from audited where role = 'TRANSFER_TARGET' and padding > 0.5 union all
  select dataset, 'tail_policy_pad_padding_moderado' from audited where role = 'TRANSFER_TARGET' and padding > 0.15 and padding <= 0.5 and policy = 'pad' union all
  select dataset, 'tt_median_lt_window' from audited where role = 'TRANSFER_TARGET' and median < 512 union all
  select dataset, 'tail_drop_ratio_alto' from audited where role <> 'DROP' and dropped > 0.05 * n_rows union all
  select dataset, 'dataset_dominante' from audited where share > 0.2
)
select 'dataset' as scope, dataset as name, rule from said
union all select 'client', client, 'cliente_pequeno_temporal' from per_client where temporal < 0.01
union all select 'client', client, 'cliente_pequeno_channel' from per_client where channel < 0.01
union all select 'corpus', 'corpus', 'inconsistencia_conteos' from audited group by all having count(*) <> (select count(distinct l_suppkey) + 1 from lineitem)
union all select 'corpus', 'corpus', 'inconsistencia_csv' from (select count(*) as n from supplier where s_suppkey % 2 = 0) where n <> (select count(*) + 1 from audited)""")
def warning_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of all kinds about suppliers as datasets, nations as clients, and the whole."""
    li, sup = T.read(spark, d, "lineitem"), T.read(spark, d, "supplier")
    k = F.col("k")
    per = li.groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("l_quantity") > 45).alias("d"), (F.min("l_quantity") - 2).alias("target_min"), (F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("p"), F.count_distinct("l_orderkey").alias("n_orders"), F.sum("l_linenumber").alias("channel_patches"))
    table = per.join(sup, per.k == sup.s_suppkey).select(
        F.concat(F.lit("d"), k).alias("dataset"), F.concat(F.lit("c"), "s_nationkey").alias("client"), F.when(k % 3 == 0, "TRANSFER_TARGET").when(k % 3 == 1, "PRETRAIN_SOURCE").otherwise("DROP").alias("role"),
        F.when(k % 2 == 0, F.col("n_orders")).alias("n_windows"), (k % 9).alias("n_units"), F.when(k % 4 > 0, (k % 11) / 100).alias("class_balance"), "target_min",
        F.get(F.array(*map(F.lit, ("rul", "regression", "regression_or_rul", "binary"))), (k % 5).cast("int")).alias("target_kind"), F.when(k % 8 > 0, F.col("p")).alias("padding_ratio"), F.when(k % 2 == 0, "pad").otherwise("drop").alias("tail_policy"),
        F.col("n_orders").alias("length_median"), F.lit(512).alias("window_size"), "n_rows", F.when(k % 6 > 0, F.col("d")).alias("dropped_rows"), "channel_patches",
    )
    shared = audit.shares(table, ["n_rows", "channel_patches"], digits=15)
    clients = shared.groupBy("client").agg(F.sum("w_n_rows").alias("w_temporal_patches"), F.sum("w_channel_patches").alias("w_channel_patches"))
    corpus = table.agg(F.count("*").alias("n_audited"), F.lit(0).alias("n_excluded"), (F.count("*") + 1).alias("n_downloaded")).crossJoin(sup.where("s_suppkey % 2 = 0").agg(F.count("*").alias("n_listed")))  # one row each
    return rules.all_warnings(shared, clients, corpus).select("scope", "name", "rule")


@query("""with s as (select case when l_suppkey % 5 < 3 then 'train' when l_suppkey % 5 = 3 then 'val' else 'test' end as split, l_quantity - 1 as life, least(l_quantity, 40) as capped, l_suppkey from lineitem),
f as (select split, count(*) as n, min(life)::double as low, max(capped)::double as high, case when split <> 'val' then count(*) + max(l_suppkey) % 2 end as preview from s group by 1)
select split, 'life is not negative' as "check", low as observed, low >= 0 as passed from f
union all select split, 'samples as in the preview', n, n = preview from f where preview is not null
union all select split, 'the last row has life 0', low, low = 0 from f where split <> 'test'
union all select split, 'lives are capped', high, high <= 30 from f""")
def writer_checks(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of splits before they are written; some of it doesn't."""
    k = F.col("l_suppkey") % 5
    split = F.when(k < 3, "train").when(k == 3, "val").otherwise("test")
    per = T.read(spark, d, "lineitem").groupBy(split.alias("split")).agg(F.count("*").alias("n_samples"), (F.min("l_quantity") - 1).alias("life_min"), F.max(F.least("l_quantity", F.lit(40))).alias("capped_max"), F.max("l_suppkey").alias("m"))
    per = per.withColumn("n_preview", F.when(F.col("split") != "val", F.col("n_samples") + F.col("m") % 2))
    return rules.checked(per, rules.writer_rules(30), "split").select("split", "check", F.col("observed").cast("double").alias("observed"), "passed")


@query(f"""with {_SPLITS} select dataset, split, count(*) as n_rows, 'string' as key_type, 0 as n_null, 0 as n_faults from w group by 1, 2""")
def stored_footers(spark: SparkSession, d: str) -> DataFrame:
    """Files of samples judged by their footers and the manifest, without reading them."""
    path, rows = T.scratch(spark), _samples_at_rest(spark, d)
    store.publish(rows, path, _CONFIG, V.config_hash(_CONFIG))
    found = footers.read_footers(spark, f"{path}/data")
    listed = store.current(store.history(spark, path)).select("dataset", F.inline("files"))
    types = {"key": "string", "unit": "string", "patches[][][]": "double", "valid_time_mask[]": "boolean", "target.label": "string", "meta.start": "int64"}
    faults = footers.footer_faults(found, types, listed).groupBy("path").agg(F.count("*").alias("n"))
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)
    keys = found.where("column = 'key'").join(faults, "path", "left")
    return keys.groupBy(part("dataset"), part("split")).agg(F.sum("n_rows").alias("n_rows"), F.max("type").alias("key_type"), F.sum("n_null").cast("int").alias("n_null"), F.coalesce(F.sum("n"), F.lit(0)).cast("int").alias("n_faults"))


@query("""with t as (select event_id as step, case when event_id % 101 <> 0 and event_id % 103 <> 0 then case when event_id % 13 = 0 then -value else value end end as x, event_id % 5 <> 0 as clean, case when event_id < 3000 then '0-3000' else '3000-' end as bucket from events where event_id % 17 <> 0),
b as (select *, case when abs(x) < 1e-9 then 0 else sign(x) * least(2094, floor(ln(abs(x) / 1e-9) / ln(1.02)) + 1) end as bin from t),
s as (select bucket, count(x) as n, count(*) - count(x) as n_nonfinite, avg(x) as mean, min(x) as low, max(x) as high, avg(case when clean then x end) as clean_mean from t group by 1),
c as (select bucket, bin, sum(count(*)) over (partition by bucket order by bin) as upto from b where bin is not null group by 1, 2),
q as (select bucket, min(bin) filter (upto >= ceil(0.1 * n)) as b10, min(bin) filter (upto >= ceil(0.5 * n)) as b50, min(bin) filter (upto >= ceil(0.9 * n)) as b90 from c join s using (bucket) group by 1)
select bucket, n, n_nonfinite, round(mean, 6) as mean, low, high, round(clean_mean, 6) as clean_mean, round(least(high, greatest(low, sign(b10) * 1e-9 * pow(1.02, abs(b10) - 0.5))), 6) as p10,
  round(least(high, greatest(low, sign(b50) * 1e-9 * pow(1.02, abs(b50) - 0.5))), 6) as p50, round(least(high, greatest(low, sign(b90) * 1e-9 * pow(1.02, abs(b90) - 0.5))), 6) as p90 from s join q using (bucket)""")
def followed_log(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of a log that arrives in any order, in several batches, with repeated and
    broken lines and records of another kind."""
    path, k = T.scratch(spark), F.col("event_id")
    value = F.when(k % 13 == 0, -F.col("value")).otherwise(F.col("value"))
    loss = F.when(k % 101 == 0, F.lit(float("nan"))).when(k % 103 == 0, F.lit(float("inf"))).otherwise(value)
    lines = T.read(spark, d, "events").select(k.alias("step"), F.when(k % 17 == 0, "distribution").alias("kind"), F.col("event_type").alias("dataset"), loss.alias("loss"), (k % 5 != 0).alias("optimizer_applied"))
    text = lines.select(F.to_json(F.struct("*")).alias("value"), F.explode(F.when(F.col("step") % 10 == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1)))).alias("copy"))
    broken = lines.where("step % 50 = 0").select(F.concat(F.lit('{"step": '), "step").alias("value"), F.lit(1).alias("copy"))
    text.unionByName(broken).repartition(7, F.hash("value", "copy")).select("value").write.text(f"{path}/in")
    log = follow.follow_log(spark, f"{path}/in", files_at_once=3)
    query = follow.bucket_statistics_stream(log, f"{path}/out", [(0, 3000), (3000, None)], f"{path}/checkpoint")
    query.awaitTermination()
    return rounded(follow.bucket_statistics(follow.read_pages(spark, f"{path}/out")))


@query(f"""with {T.NATIONS}, r as (select dataset, m as mode, case when hash_ % 11 > 0 then round((patches % 97) / 97.0 + (hash_ % 13) / 50.0, 6) end as macro_f1, case when hash_ % 3 > 0 then 32 end as batch_size_effective
    from (select dataset, patches::bigint as patches, m, (patches::bigint + 7 * i) as hash_ from nations, (values ('from_scratch', 0), ('linear_probing', 1), ('full_finetuning', 2)) v(m, i))),
  b as (select dataset, max(macro_f1) as base from r where mode = 'from_scratch' group by 1), c as (select dataset, case when length(dataset) <> 5 then length(dataset) end as n_channels from nations)
select r.dataset, mode, concat_ws('; ', case when batch_size_effective is null and 64 * n_channels > 512 then 'historical_uncapped_batch_v0_1' end, case when mode = 'full_finetuning' and macro_f1 < base - 0.1 then 'catastrophic_forgetting' end) as notes
from r left join b on b.dataset = r.dataset left join c on c.dataset = r.dataset""")
def run_notes(spark: SparkSession, d: str) -> DataFrame:
    nations = T.nation_table(spark, d).select("dataset", F.col("patches").cast("long").alias("p"))
    modes = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(i).alias("i")) for i, m in enumerate(("from_scratch", "linear_probing", "full_finetuning"))))).alias("m")
    runs = nations.select("dataset", "p", modes).withColumn("h", F.col("p") + 7 * F.col("m.i"))
    f1 = F.when(F.col("h") % 11 > 0, F.round((F.col("p") % 97) / 97 + (F.col("h") % 13) / 50, 6))
    runs = runs.select("dataset", "m.mode", f1.alias("macro_f1"), F.when(F.col("h") % 3 > 0, 32).alias("batch_size_effective"))
    channels = nations.select("dataset", F.when(F.length("dataset") != 5, F.length("dataset")).alias("n_channels"))
    return runlog.run_notes(runs, channels).select("dataset", "mode", F.array_join("notes", "; ").alias("notes"))


@query(f"""with {T.NATIONS}, r as (select dataset, m as mode, case when (patches::bigint + i) % 7 > 0 then round((patches::bigint % 31) + 20 - case when (patches::bigint + i) % 5 = 0 then 3.0 when (patches::bigint + i) % 5 = 1 then 0.05 else -i end, 6) end as rmse
    from nations, (values ('from_scratch', 0), ('linear_probing', 1), ('full_finetuning', 2)) v(m, i)),
  f as (select dataset, min(rmse) filter (mode = 'from_scratch') as base, min(rmse) filter (mode <> 'from_scratch') as best, arg_min(mode, rmse + case mode when 'linear_probing' then 0 else 1e-9 end) filter (mode <> 'from_scratch' and rmse is not null) as best_mode from r group by 1)
select dataset, best_mode, round((best - base)::double, 6) as delta, case when base is null or best is null then 'PENDIENTE' when best >= base then 'NO_CONFIRMADA' when (best - base) / base <= -0.01 then 'CONFIRMADA' else 'DEBIL' end as verdict from f""")
def transfer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    nations = T.nation_table(spark, d).select("dataset", F.col("patches").cast("long").alias("p"))
    modes = ["from_scratch", "linear_probing", "full_finetuning"]
    runs = nations.select("dataset", "p", F.posexplode(F.array(*map(F.lit, modes))).alias("i", "mode"))
    k = F.col("p") + F.col("i")
    off = F.when(k % 5 == 0, 3.0).when(k % 5 == 1, 0.05).otherwise(-F.col("i").cast("double"))
    runs = runs.select("dataset", "mode", F.when(k % 7 > 0, F.round(F.col("p") % 31 + 20 - off, 6)).alias("rmse"))
    return rounded(runlog.transfer_verdict(runs, modes[1:]).select("dataset", "best_mode", "delta", "verdict"))


@query(f"""with {T.EVENTS}, len as (select split, unit, count(*)::double as v from obs group by 1, 2), span as (select min(v) as a, max(v) as b from len)
select 'lengths' as plot, case when b > a then least(29, floor((v - a) / ((b - a) / 30))) else 0 end::bigint::varchar as key, count(*) as n from len, span group by 1, 2
union all select 'classes', target, count(*) from obs group by 1, 2 union all select 'missing', '0', count(*) from obs union all select 'missing', '1', count(*) from obs""")
def plot_counts(spark: SparkSession, d: str) -> DataFrame:
    return runlog.plot_tables(T.event_rows(spark, d)).select("plot", "key", "n")


@query(f"""with {T.LINEITEM}, p as (select unit, pos, x0::double as v, count(*) over (partition by unit) as n from obs), e as (select unit, n, unnest(list_distinct(list_append(range(19, n, 40), n - 1)))::int as w_end from (select distinct unit, n from p)),
w as (select e.unit, w_end, pos - w_end + 29 as w_pos, v from e join p on p.unit = e.unit and pos <= w_end and pos > w_end - 30), s as (select unit, w_end, count(*) as k, avg(v) as m, stddev_pop(v) as d from w group by 1, 2)
select s.unit, s.w_end, round(s.m, 6) as mean, round(case when k < 2 or d <= 1e-4 then 1e-6 else d end, 6) as std_used, k < 2 or d <= 1e-4 as constant, round(sum(case when k < 2 or d <= 1e-4 then 0 else abs(v - m) / d end), 5) as total
from w join s on s.unit = w.unit and s.w_end = w.w_end group by 1, 2, k, m, d""")
def rolling_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Instance normalization of causal windows by the policy for remaining life."""
    rows = T.lineitem_rows(spark, d).withColumn("x", F.array(F.get("x", F.lit(0)).cast("double")))
    scaled = windows.normalize(windows.roll(rows, ["unit"], 30, 40, 20), ["unit", "w_end"], "rolling")
    out = scaled.groupBy("unit", "w_end").agg(F.max("mean").alias("mean"), F.max("std_used").alias("std_used"), F.bool_or("constant").alias("constant"), F.sum(F.abs("z")).alias("total"))
    return out.select("unit", "w_end", F.round("mean", 6).alias("mean"), F.round("std_used", 6).alias("std_used"), "constant", F.round("total", 5).alias("total"))


@query("""select event_type as dataset, round(count(x) * 100 / count(*), 4) as label_coverage_pct, round(min(x), 4) as target_min, round(max(x), 4) as target_max, round(avg(x), 4) as target_mean from (select event_type, case when event_id % 9 > 0 then value end as x from events) group by 1""")
def target_ranges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    target = F.when(k % 9 == 0, F.when(k % 2 == 0, F.lit(float("nan")))).otherwise(F.col("value"))
    return audit.target_ranges(T.read(spark, d, "events").select(F.col("event_type").alias("dataset"), target.alias("target")))


@query("""with u as (select distinct event_type as dataset, user_id as unit, case when event_type in ('click', 'view') and user_id % 10 = 9 then 'val' when user_id % 10 < 8 then 'train' else 'test' end as split from events),
h as (select dataset, unit, row_number() over (partition by dataset order by md5(concat_ws(':', '7', dataset, dataset, unit)), dataset, unit) <= greatest(1, round_even(count(*) over (partition by dataset) * 0.1, 0)) as held from u where split = 'train' and dataset not in (select dataset from u where split = 'val'))
select u.dataset, u.unit, case when coalesce(held, false) then 'val' else split end as split, u.dataset || '__subset-none__split-' || case when coalesce(held, false) then 'val' else split end || '__unit-' || u.unit as trajectory_id from u left join h on h.dataset = u.dataset and h.unit = u.unit and u.split = 'train'""")
def validation_splits(spark: SparkSession, d: str) -> DataFrame:
    """Units of datasets of which some have a val split and the others get one."""
    last = F.when(F.col("event_type").isin("click", "view") & (F.col("user_id") % 10 == 9), "val").when(F.col("user_id") % 10 < 8, "train").otherwise("test")
    units = T.read(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("user_id").alias("unit"), last.alias("split")).distinct().withColumn("trajectory_id", F.lit(""))
    return trajectories.with_validation(units, 0.1, 7)


@query(f"""with {_TILES} select 'events' as dataset, case when unit % 10 < 7 then 'train' when unit % 10 < 9 then 'val' else 'test' end as split, any_value(r.n) as n_rows, count(distinct unit) as n_units, count(*) as n_windows, sum(ceil(t.n / 8))::bigint as n_valid_patches
from (select unit, w_idx, count(*) as n from tiles group by 1, 2) t join (select split, count(*) as n from obs group by 1) r on r.split = case when unit % 10 < 7 then 'train' when unit % 10 < 9 then 'val' else 'test' end group by 1, 2""")
def split_patches(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.split_patches(T.event_rows(spark, d), 64, 32, 8)


@query("""with r as (select l_suppkey + 1 as unit_id, l_orderkey as o, l_linenumber as k, l_quantity as q, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as n from lineitem),
f as (select *, case when o % 50 = 0 then greatest(1, n - 2) else n end as cycle, case when o % 97 = 0 then 'columns' when o % 89 = 0 then 'cycle' end as fault from r),
g as (select unit_id, n, cycle, lag(cycle) over (partition by unit_id order by n) as before from f where fault is null),
c as (select unit_id, count(*) as n_rows, count(*) filter (fault = 'columns') as n_columns, count(*) filter (fault = 'cycle') as n_cycles, round(sum(q) filter (fault is null), 2) as total from f group by 1)
select c.*, (select count(*) from g where g.unit_id = c.unit_id and cycle <= before) as n_order from c""")
def sensor_text(spark: SparkSession, d: str) -> DataFrame:
    """Line items as engine sensor text, written and read again: faults of lines, and cycles
    that don't rise in the order of the file."""
    path = T.scratch(spark)
    li = T.read(spark, d, "lineitem")
    n = F.expr("row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey)")
    rows = li.select((F.col("l_suppkey") % 8).alias("fd"), (F.col("l_suppkey") + 1).alias("u"), F.col("l_orderkey").alias("o"), F.col("l_quantity").alias("q"), n.alias("n"))
    cycle = F.when(F.col("o") % 89 == 0, "-1").otherwise(F.when(F.col("o") % 50 == 0, F.greatest(F.lit(1), F.col("n") - 2)).otherwise(F.col("n")).cast("string"))
    rest = F.when(F.col("o") % 97 == 0, "0.5").otherwise(F.concat_ws(" ", F.format_string("%.2f", F.col("q").cast("double")), F.repeat(F.lit("0.5 "), F.lit(23))))
    lines = rows.select("fd", "u", "n", F.concat_ws(" ", F.col("u").cast("string"), F.when(F.col("o") % 97 == 0, F.lit("1")).otherwise(cycle), rest).alias("value"))
    lines.repartition(8, "fd").sortWithinPartitions("fd", "u", "n").select("fd", "value").write.partitionBy("fd").text(path)
    read = sensors.numbered_lines(spark, path).select(F.regexp_extract("file", "fd=([0-9]+)", 1).alias("fd"), F.lit("train").alias("source_split"), "line", "value")
    parsed = sensors.parse_sensor_lines(read)
    fault = lambda kind: F.count_if(F.col("fault") == kind)
    good = F.when(F.col("fault").isNull(), F.col("op")[0].cast("double"))
    per = parsed.groupBy("unit_id").agg(F.count("*").alias("n_rows"), fault("columns").alias("n_columns"), fault("cycle").alias("n_cycles"), F.round(F.sum(good), 2).alias("total"))
    order = sensors.order_faults(parsed.where("fault is null")).groupBy("unit_id").agg(F.count("*").alias("n_order"))
    return per.join(order, "unit_id", "left").withColumn("n_order", F.coalesce("n_order", F.lit(0).cast("long")))


@query(f"""with {T.NATIONS}, a as (select dataset as name, patches::bigint as size, md5(dataset) as sha256 from nations where length(dataset) % 5 > 0), b as (select dataset as name, patches::bigint as size, md5(case when patches::bigint % 3 = 0 then 'x' else dataset end) as sha256 from nations where patches::bigint % 4 > 0)
select coalesce(a.name, b.name) as name, case when a.name is null then 'missing' when a.sha256 = b.sha256 then 'identical' when a.size > 2500 then 'too large' when b.name is null then 'to copy' else 'different' end as status from a full join b on a.name = b.name""")
def copy_states(spark: SparkSession, d: str) -> DataFrame:
    """Files of a source against those of its copy."""
    n = T.nation_table(spark, d).select(F.col("dataset").alias("name"), F.col("patches").cast("long").alias("size"))
    source = n.where("length(name) % 5 > 0").withColumn("sha256", F.md5("name"))
    copy = n.where("size % 4 > 0").withColumn("sha256", F.md5(F.when(F.col("size") % 3 == 0, "x").otherwise(F.col("name"))))
    return samples.copy_status(source, copy, largest=2500)


@query(f"""with {T.NATIONS} select dataset as name, patches::bigint as size, case when patches::bigint % 3 = 0 then 'pending' when patches::bigint % 3 = 1 then 'done' else 'retry' end as status from nations""")
def download_states(spark: SparkSession, d: str) -> DataFrame:
    n = T.nation_table(spark, d).select(F.col("dataset").alias("name"), F.col("patches").cast("long").alias("size"))
    files = n.where("size % 3 > 0").withColumn("size", F.when(F.col("size") % 3 == 1, F.col("size")).otherwise(F.col("size") - 1))
    return samples.download_status(n, files)


@query(f"""with {T.NATIONS} select client, dataset, case when client in ('AFRICA', 'ASIA') then 0 else patches::bigint end as n_windows, case when client in ('AFRICA', 'ASIA') then 0 else n_units end as n_temporal_patches, 0 as n_channel_patches from nations""")
def group_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Groups as JSON in their three shapes, flattened again."""
    n = T.nation_table(spark, d).select("client", "dataset", F.col("patches").cast("long").alias("w"), "n_units")
    per = n.groupBy("client").agg(F.sort_array(F.collect_list(F.struct("dataset", "w", "n_units"))).alias("d"))  # a client's datasets
    counts = lambda x: F.struct(x["w"].alias("n_windows"), x["n_units"].alias("n_temporal_patches"))
    listed = F.to_json(F.transform("d", lambda x: F.struct(x["dataset"].alias("dataset"), x["w"].alias("n_windows"), x["n_units"].alias("n_temporal_patches"))))
    mapped = F.to_json(F.map_from_entries(F.transform("d", lambda x: F.struct(x["dataset"], counts(x)))))
    named = F.to_json(F.transform("d", lambda x: x["dataset"]))
    shape = F.when(F.col("client").isin("AFRICA", "ASIA"), named).when(F.col("client") == "EUROPE", mapped).otherwise(listed)
    text = F.concat(F.lit('{"clients": {'), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('"'), "client", F.lit('": {"datasets": '), shape, F.lit("}")))), ", "), F.lit("}}"))
    return records.flatten_groups(per.agg(text.alias("json")))


@query("""with c as (select o_orderpriority as p, o_orderstatus as s, count(*) as n, avg(o_totalprice) as v, o_custkey % 7 as k from orders group by all)
select p || '/' || k as experiment_id, concat_ws(',', case when k = 0 then 'dataset' end, case when s = 'P' then 'mode' end, case when n < 3 then 'status' end) as missing from c where k = 0 or s = 'P' or n < 3""")
def lacking_results(spark: SparkSession, d: str) -> DataFrame:
    """Result rows that lack required fields, and which."""
    k = (F.col("o_custkey") % 7).alias("k")
    c = T.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), k).agg(F.count("*").alias("n"))
    rows = c.select(F.concat_ws("/", "p", "k").alias("experiment_id"), F.when(F.col("k") != 0, F.col("p")).alias("dataset"), F.when(F.col("s") != "P", F.col("s")).alias("mode"), F.when(F.col("n") >= 3, "ok").alias("status"), F.lit("f1").alias("primary_metric_name"))
    return records.missing_fields(rows).select("experiment_id", F.array_join("missing", ",").alias("missing"))


@query("""select 'value' as name, case when count(distinct value) > 20 and min(value) >= 0 and max(value) > 10 then 'regression_or_rul' else 'regression' end as kind from events
union all select 'rul_value', case when count(value) = 0 then 'sin_etiqueta' else 'rul' end from events
union all select 'anomaly', case when count(value) = 0 then 'sin_etiqueta' else 'anomaly' end from events
union all select 'event_type', case when count(distinct event_type) = 2 then 'binary' when count(distinct event_type) <= 100 then 'multiclass' else 'regression' end from events
union all select 'user_id', case when count(distinct user_id) = 2 then 'binary' when count(distinct user_id) <= 100 then 'multiclass' else 'regression' end from events
union all select 'odd', 'binary' union all select 'nothing', 'sin_etiqueta'""")
def target_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What columns of the events would be as targets."""
    e = T.read(spark, d, "events")
    columns = {"value": F.col("value"), "rul_value": F.col("value"), "anomaly": F.col("value"), "event_type": F.col("event_type"), "user_id": F.col("user_id"), "odd": F.col("event_id") % 2 == 1, "nothing": F.lit(None).cast("double")}
    kinds = dict(e.select(*(c.alias(n) for n, c in columns.items())).dtypes)
    facts = []
    for name, c in columns.items():
        number = c.cast("double") if kinds[name] not in ("string",) else F.lit(None).cast("double")
        facts.append(F.struct(F.count(c).alias("n"), F.count_distinct(c).alias("k"), F.min(number).alias("low"), F.max(number).alias("high"), F.coalesce(F.bool_and(number == F.floor(number)), F.lit(False)).alias("whole")).alias(name))
    row = e.agg(*facts)
    each = [F.struct(F.lit(n).alias("name"), V.target_kind(n, kinds[n], *(F.col(f"{n}.{x}") for x in ("n", "k", "low", "high", "whole"))).alias("kind")) for n in columns]
    return row.select(F.inline(F.array(*each)))


@query("""with b as (select event_type as dataset, user_id as batch from events group by 1, 2), r as (select *, row_number() over (partition by dataset order by batch) as k from b), t as (select *, row_number() over (order by dataset, batch) as j from r where k <= 20) select dataset, batch from t where j <= 50""")
def evaluation_batches(spark: SparkSession, d: str) -> DataFrame:
    """The batches that an evaluation takes: the first of each dataset, and so many in all."""
    batches = T.read(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("user_id").alias("batch")).distinct()
    return sampling.evaluation_order(batches, 20, 50)


@query(f"""with {T.NATIONS}, m as (select client, sum(n_units * greatest(1, patches::bigint % 4)) as work from nations group by 1), p as (select client, max(patches / 1000.0) as w from nations where client <> 'ASIA' group by 1)
select 'plan' as policy, client, round(coalesce(w, 0), 6)::double as w from m left join p using (client) union all select 'uniform', client, 1.0 from m union all select 'steps', client, work::double from m""")
def client_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of clients by three policies."""
    n = T.nation_table(spark, d)
    work = n.select("client", F.col("n_units").alias("steps"), (F.col("patches").cast("long") % 4).alias("effective_bc"))
    plan = n.where("client <> 'ASIA'").select("client", "dataset", (F.col("patches") / 1000).cast("double").alias("final_client_weight"))
    out = [federated.client_weights(work, plan, p).select(F.lit(name).alias("policy"), "client", F.col("w").cast("double").alias("w")) for name, p in (("plan", "final_client_weight"), ("uniform", "uniform"), ("steps", "work"))]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]))


@query(f"""with {T.NATIONS}, a as (select dataset, n_units as w, patches::bigint % 5 as p from nations where patches::bigint % 4 > 0), b as (select dataset, n_units + 2 as w, patches::bigint % 7 as p from nations where patches::bigint % 3 > 0)
select dataset, b.w - a.w as delta_windows, round(case when a.p <> 0 then (b.p - a.p) * 100.0 / a.p end, 6)::double as patch_change_pct from a join b using (dataset)""")
def audit_changes(spark: SparkSession, d: str) -> DataFrame:
    n = T.nation_table(spark, d).select("dataset", "n_units", F.col("patches").cast("long").alias("p"))
    before = n.where("p % 4 > 0").select("dataset", F.col("n_units").alias("n_windows"), (F.col("p") % 5).alias("valid_patches"))
    now = n.where("p % 3 > 0").select("dataset", (F.col("n_units") + 2).alias("n_windows"), (F.col("p") % 7).alias("valid_patches"))
    return rounded(audit.compare_audits(before, now).select("dataset", "delta_windows", F.col("patch_change_pct").cast("double").alias("patch_change_pct")))


@query(f"""with {T.NATIONS}, s as (select dataset, case when patches::bigint % 3 = 0 then 'known' when patches::bigint % 3 = 1 then 'inferred' else 'unknown' end as state from nations) select state, count(*) as n, string_agg(dataset, ',' order by dataset) as datasets from s group by 1""")
def rate_lists(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("patches").cast("long") % 3
    n = T.nation_table(spark, d).select("dataset", F.when(k == 0, 1.0).alias("rate"), F.when(k != 2, 2.0).alias("inferred_rate"))
    return roles.sampling_rates(n).select("state", "n", F.array_join("datasets", ",").alias("datasets"))


@query("""with names as (select label, row_number() over (order by label) - 1 as class from (select distinct event_type as label from events where user_id % 2 = 0)), seen as (select distinct case when user_id % 3 = 0 then 'new ' || event_type else event_type end as label from events where user_id % 2 = 1)
select 'unseen' as what, label from seen where label not in (select label from names) union all select 'absent', label from names where label not in (select label from seen)""")
def label_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Labels that the training rows don't have, and classes that no other row has."""
    e = T.read(spark, d, "events")
    names = metrics.label_map(e.where("user_id % 2 = 0").select(F.col("event_type").alias("label")))
    rows = e.where("user_id % 2 = 1").select(F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("new "), "event_type")).otherwise(F.col("event_type")).alias("label"))
    unseen = metrics.unseen_labels(rows, names).select(F.lit("unseen").alias("what"), "label")
    pairs = rows.join(names, "label").select(F.col("class").alias("y"))
    return unseen.unionByName(metrics.absent_classes(pairs, names).select(F.lit("absent").alias("what"), "label"))
