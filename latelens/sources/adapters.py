"""Views of the generic tables as the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

US = 1_000_000
DAY, TICK = 86_400 * US, 3_600 * US
#: Maturity in the scaled protocol of the events table.
MATURITY = 3 * DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(c: str):
    """Microseconds of a zoneless time column, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(click_id, user_id, product, price, click_time): clicks of the events table, times in microseconds."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select(
        F.col("event_id").alias("click_id"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("product"),
        F.col("value").alias("price"), _micros("ts").alias("click_time"),
    )


def truth(spark: SparkSession, sf_dir: str, maturity: int = MATURITY) -> DataFrame:
    """click_log with final_label and available_at: the user's next purchase within maturity.

    One pass per user over clicks and purchases in time order, no join of the two."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    e = e.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("product"), F.col("value").alias("price"), _micros("ts").alias("t"))
    # latest first: a growing frame is summed up row by row, a shrinking one anew for each row
    later = Window.partitionBy("user_id").orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("next", F.min(F.when(F.col("event_type") == "purchase", F.col("t"))).over(later))
    won = F.coalesce(F.col("next") <= F.col("t") + maturity, F.lit(False))
    return e.where("event_type = 'click'").select(
        F.col("event_id").alias("click_id"), "user_id", "product", "price", F.col("t").alias("click_time"),
        won.cast("int").alias("final_label"), F.when(won, F.col("next")).otherwise(F.col("t") + maturity).alias("available_at"),
    )


def origin(clicks: DataFrame) -> int:
    return clicks.agg(F.min("click_time")).first()[0] or 0


def with_day(clicks: DataFrame, start: int | None = None) -> DataFrame:
    start = origin(clicks) if start is None else start
    return clicks.withColumn("click_day", F.floor((F.col("click_time") - start) / DAY).cast("int"))


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw click log made of line items: strings as they would be read from text.

    Sale is whether the order was shipped after its date on an even line, delay the days between."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    delay = F.expr("datediff(cast(l_shipdate as date), cast(o_orderdate as date))")
    sale = (F.col("l_linenumber") % 2 == 0).cast("int")
    return j.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("raw_row_index"),
        F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(sale.cast("string")).alias("Sale"),
        F.when(sale == 1, F.col("l_linenumber").cast("string")).otherwise(F.when(F.col("l_returnflag") == "A", F.lit("5")).otherwise(F.lit("-1"))).alias("SalesAmountInEuro"),
        F.when(sale == 1, delay.cast("string")).otherwise(F.lit("-1")).alias("time_delay_for_conversion"),
        F.when(F.col("l_returnflag") == "N", F.lit("nan")).otherwise((F.col("o_orderkey") * 60 - 600).cast("string")).alias("click_timestamp"),
        F.when(F.col("l_linestatus") == "O", F.lit("-2")).otherwise(F.lit("3")).alias("nb_clicks_1week"),
        F.when(F.col("l_linenumber") == 5, F.lit("x1")).otherwise(F.lit("-1")).alias("product_price"),
        F.col("l_returnflag").alias("device_type"),
    )


RAW_SQL = """raw as (
  select l_orderkey * 8 + l_linenumber as raw_row_index,
    case when l_linenumber = 7 then '' else cast(cast(l_linenumber % 2 = 0 as int) as varchar) end as "Sale",
    case when l_linenumber % 2 = 0 then cast(l_linenumber as varchar) when l_returnflag = 'A' then '5' else '-1' end as "SalesAmountInEuro",
    case when l_linenumber % 2 = 0 then cast(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as varchar) else '-1' end as time_delay_for_conversion,
    case when l_returnflag = 'N' then 'nan' else cast(o_orderkey * 60 - 600 as varchar) end as click_timestamp,
    case when l_linestatus = 'O' then '-2' else '3' end as nb_clicks_1week,
    case when l_linenumber = 5 then 'x1' else '-1' end as product_price,
    l_returnflag as device_type
  from lineitem join orders on l_orderkey = o_orderkey)"""

CLICKS_SQL = f"""clicks as (
  select event_id as click_id, user_id, cast(json_extract_string(props, '$.k') as bigint) as product, value as price, epoch_us(ts) as click_time
  from events where event_type = 'click'),
purchases as (select user_id, epoch_us(ts) as t from events where event_type = 'purchase'),
nexts as (select c.click_id, min(p.t) as t from clicks c join purchases p on p.user_id = c.user_id and p.t > c.click_time and p.t <= c.click_time + {MATURITY} group by c.click_id),
truth as (
  select c.*, cast(n.t is not null as int) as final_label, coalesce(n.t, c.click_time + {MATURITY}) as available_at,
    cast(floor((c.click_time - (select min(click_time) from clicks)) / {DAY}) as int) as click_day
  from clicks c left join nexts n on n.click_id = c.click_id)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """truth with click_day, a deterministic probability and another method's one."""
    from latelens.functions.hashing import md5_number

    t = truth(spark, sf_dir)
    t = with_day(t)
    u = lambda s: md5_number(F.concat(F.lit(s), F.col("click_id").cast("string"))) % 1000
    return t.withColumn("probability", (F.col("final_label") * 300 + u("p:") * 0.6 + 50) / 1000).withColumn("other", (u("q:") * 0.9 + 50) / 1000)


SCORES_SQL = (
    CLICKS_SQL
    + """,
scored as (
  select *, (final_label * 300 + (('0x' || substr(md5('p:' || click_id), 1, 8))::bigint % 1000) * 0.6::double + 50) / 1000 as probability,
    ((('0x' || substr(md5('q:' || click_id), 1, 8))::bigint % 1000) * 0.9::double + 50) / 1000 as other
  from truth)"""
)
