"""The driver's tables in the roles of sensor data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trajectories import ordered

START_MICROS = 1_704_067_200_000_000  # 2024-01-01


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder among those that driver and executors share; where none is set, a
    temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as short series: a unit for each user, two signals, one with gaps."""
    e = read(spark, sf_dir, "events")
    split = F.when(F.col("user_id") % 10 < 7, "train").when(F.col("user_id") % 10 < 9, "val").otherwise("test")
    x0 = F.when(F.col("event_id") % 37 != 0, F.col("value"))
    rows = e.select(F.lit("events").alias("dataset"), split.alias("split"), F.col("user_id").alias("unit"), F.col("ts"), "event_id", ((micros("ts") - START_MICROS) / 1e6).alias("time"), F.col("event_type").alias("target"), F.col("value"), F.array(x0, F.get_json_object("props", "$.k").cast("double")).alias("x"))
    return ordered(rows, ["unit"], ["ts", "event_id"])


EVENTS = """
obs as (
  select 'events' as dataset, case when user_id % 10 < 7 then 'train' when user_id % 10 < 9 then 'val' else 'test' end as split, user_id as unit,
    row_number() over (partition by user_id order by ts, event_id) - 1 as pos, event_id, (epoch_us(ts) - 1704067200000000) / 1e6 as time, event_type as target, value,
    case when event_id % 37 <> 0 then value end as x0, json_extract(props, '$.k')::double as x1
  from events
), long as (select dataset, split, unit, pos, 0 as channel, x0 as value from obs union all select dataset, split, unit, pos, 1, x1 from obs)
"""


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as long series: a unit for each supplier, four signals."""
    li = read(spark, sf_dir, "lineitem")
    rows = li.select(F.lit("lineitem").alias("dataset"), F.when(F.col("l_suppkey") % 5 < 4, "train").otherwise("test").alias("split"), F.col("l_suppkey").alias("unit"), F.col("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("target"), F.array(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")).alias("x"))
    return ordered(rows, ["unit"], ["day", "l_orderkey", "l_linenumber", "l_partkey"])


LINEITEM = """
obs as (
  select 'lineitem' as dataset, case when l_suppkey % 5 < 4 then 'train' else 'test' end as split, l_suppkey as unit, l_returnflag as target,
    row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 as pos,
    l_quantity as x0, l_extendedprice as x1, l_discount as x2, l_tax as x3
  from lineitem
)
"""


def nation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as datasets, regions as clients, line items as patches."""
    li, s = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    per = li.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    per = per.join(s, per.l_suppkey == s.s_suppkey).groupBy("s_nationkey").agg(F.sum("n").alias("patches"), F.sum("q").alias("channel_patches"), F.count("*").alias("n_units"), F.percentile("n", F.lit(0.5)).alias("length_median"))
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    named = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("dataset"), F.col("r_name").alias("client"))
    return per.join(named, per.s_nationkey == named.n_nationkey).select("dataset", "client", "patches", "channel_patches", "n_units", "length_median")


NATIONS = """
nations as (
  select n_name as dataset, r_name as client, sum(n)::bigint as patches, sum(q) as channel_patches, count(*) as n_units, quantile_cont(n, 0.5) as length_median
  from (select l_suppkey, count(*) as n, sum(l_quantity) as q from lineitem group by 1) join supplier on s_suppkey = l_suppkey
    join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by 1, 2
)
"""


def flag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of line items (y) and a rule's guesses (yhat)."""
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    guess = F.when(F.col("l_linestatus") == "O", 1).when(F.col("l_quantity") > 25, 0).otherwise(2)
    return read(spark, sf_dir, "lineitem").select(y.alias("y"), guess.alias("yhat"), F.col("l_returnflag").alias("label"))


FLAGS = """
pairs as (
  select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as y, case when l_linestatus = 'O' then 1 when l_quantity > 25 then 0 else 2 end as yhat, l_returnflag as label from lineitem
), matrix as (
  select a.k as y, b.k as yhat, count(p.y) as n from range(4) a(k) cross join range(4) b(k) left join pairs p on p.y = a.k and p.yhat = b.k group by 1, 2
), classes as (
  select k as class, s as support, p as predicted, case when p > 0 then h / p end as precision, case when s > 0 then h / s end as recall, case when s > 0 then 2 * h / (s + p) end as f1
  from (select a.k, sum(case when y = k then n else 0 end)::bigint as s, sum(case when yhat = k then n else 0 end)::bigint as p, sum(case when y = k and yhat = k then n else 0 end)::double as h from range(4) a(k), matrix group by 1)
)
"""


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a training log: a step each, some losses not finite, some steps skipped."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    loss = F.when(k % 101 == 0, F.lit(float("nan"))).when(k % 103 == 0, F.lit(float("inf"))).when(k % 97 == 0, F.col("value") * 100).otherwise(F.col("value"))
    return e.select(k.alias("step"), F.col("event_type").alias("dataset"), (F.col("user_id") % 4).alias("client"), loss.alias("loss"), F.when(k % 7 == 0, F.lit(None)).otherwise(k % 5 != 0).cast("boolean").alias("optimizer_applied"), (k % 11 == 0).alias("bad_gradient"), F.when(k % 13 == 0, "inf").alias("noted"), (k % 50).alias("n_elements"), (k % 9 + 1).alias("batch_cost"), F.col("user_id").alias("unit"))


LOG = """
log as (
  select event_id as step, event_type as dataset, user_id % 4 as client, user_id as unit,
    case when event_id % 101 = 0 then 'nan'::double when event_id % 103 = 0 then 'inf'::double when event_id % 97 = 0 then value * 100 else value end as loss,
    case when event_id % 7 = 0 then null else event_id % 5 <> 0 end as optimizer_applied, event_id % 11 = 0 as bad_gradient, case when event_id % 13 = 0 then 'inf' end as noted,
    event_id % 50 as n_elements, event_id % 9 + 1 as batch_cost
  from events
), fin as (select *, case when isfinite(loss) then loss end as x from log)
"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as client parameters: each label is a client with the same parameters, as
    many as the rarest label has rows; the rows of a label are dealt to them in turn."""
    e = read(spark, sf_dir, "embeddings")
    ranked = e.withColumn("param", F.expr("row_number() over (partition by label order by vec_id)"))
    full = ranked.groupBy("label").agg(F.max("param").alias("m")).agg(F.min("m").alias("least"))
    dealt = ranked.crossJoin(full).withColumn("param", ((F.col("param") - 1) % F.col("least") + 1).cast("int"))  # one row
    cells = dealt.select(F.col("label").alias("client"), "param", F.posexplode("embedding").alias("idx", "v"))
    return cells.groupBy("client", "param", "idx").agg(F.avg(F.col("v").cast("double")).alias("value"))


def all_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as client parameters: each label is a client, its one parameter the mean of
    all its rows, so every client has it and no row is left out."""
    e = read(spark, sf_dir, "embeddings").select(F.col("label").alias("client"), F.posexplode("embedding").alias("idx", "v"))
    return e.groupBy("client", F.lit(0).cast("long").alias("param"), "idx").agg(F.avg(F.col("v").cast("double")).alias("value"))


STATES = """
ranked as (select label as client, row_number() over (partition by label order by vec_id) as param, embedding from embeddings),
dealt as (select client, (param - 1) % (select min(m) from (select max(param) as m from ranked group by client)) + 1 as param, embedding from ranked),
states as (
  select client, param, idx, avg(v) as value from (select client, param, unnest(range(len(embedding))) as idx, unnest(embedding)::double as v from dealt) group by all
), weights as (select client, (client + 1)::double as w from (select distinct client from states)),
center as (select param, idx, sum(w * value) / sum(w) as value from states join weights using (client) group by 1, 2)
"""

ALL_STATES = """
cells as (select label as client, unnest(range(len(embedding))) as idx, unnest(embedding)::double as v from embeddings),
states as (select client, 0 as param, idx, avg(v) as value from cells group by all),
weights as (select client, (client + 1)::double as w from (select distinct client from states)),
center as (select param, idx, sum(w * value) / sum(w) as value from states join weights using (client) group by 1, 2)
"""
