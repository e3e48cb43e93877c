"""Registered queries of stores, ledgers, states and replays, each beside the SQL that says the same.

A store is written to the shared folder and read back through its reader, so that both are judged."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from latelens.functions import hashing
from latelens.functions import numeric as N
from latelens.operators import checks, eventtime, features, scheduling, states, strategies
from latelens.plans.queries import FIELDS, MATURITY, REASONS_SQL, WAIT, _fixed, _ordered_reasons, _validated, query, r6
from latelens.sources import readers, sinks
from latelens.sources.adapters import CLICKS_SQL, DAY, SCORES_SQL, click_log, origin, scores, table, truth, with_day
from latelens.sources.scratch import shared_folder


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}"


# ---- stores --------------------------------------------------------------------------------------------


@query("store_days", f"with {CLICKS_SQL} select click_id, click_time, click_day from truth where click_day between 5 and 12")
def store_days(spark, sf_dir):
    to = _folder(spark)
    sinks.write_days(with_day(click_log(spark, sf_dir)).select("click_id", "click_time", "click_day"), to, rows_per_file=5_000)
    return readers.read_days(spark, to, 5, 12)


_truth_day = f"floor((available_at - (select min(click_time) from clicks)) / {DAY})"


@query("store_truth", f"with {CLICKS_SQL} select click_id, final_label, click_time, available_at from truth where {_truth_day} between 3 and 10")
def store_truth(spark, sf_dir):
    t, to = truth(spark, sf_dir), _folder(spark)
    sinks.write_truth(t, to, DAY, origin(t))
    return readers.read_truth(spark, to, 3, 10)


@query("store_quarantine", REASONS_SQL + " select raw_row_index, reasons from v where reasons <> ''")
def store_quarantine(spark, sf_dir):
    to = _folder(spark)
    sinks.write_quarantine(_validated(spark, sf_dir), to)
    return spark.read.parquet(to).withColumnRenamed("reason_codes", "reasons").select("raw_row_index", _ordered_reasons().alias("reasons"))


@query("store_accepted", REASONS_SQL + """ select "Sale", "SalesAmountInEuro", time_delay_for_conversion, click_timestamp, nb_clicks_1week, product_price, device_type, count(*) as n from v where reasons = '' group by all""")
def store_accepted(spark, sf_dir):
    to = _folder(spark)
    sinks.write_accepted(_validated(spark, sf_dir), to, FIELDS)
    d = spark.read.schema(", ".join(f"`{f}` string" for f in FIELDS)).option("sep", "\t").csv(to)
    return d.groupBy(*FIELDS).agg(F.count("*").alias("n"))


@query("prediction_ledger", f"with {SCORES_SQL} select click_day % 3 as part, count(*) as n, round(sum(probability), 6) as p from scored group by 1")
def prediction_ledger(spark, sf_dir):
    """Three parts, one of them sent twice, sealed, verified and read back."""
    s = scores(spark, sf_dir).select("click_id", "click_day", "probability")
    ledger = sinks.Ledger(spark, _folder(spark), ["click_id"], ["click_id"])
    for part in (0, 1, 2, 1):
        ledger.append(part, s.where(F.col("click_day") % 3 == part))
    ledger.seal()
    ledger.verify()
    return ledger.read().groupBy("part").agg(F.count("*").alias("n"), r6(F.sum("probability")).alias("p"))


@query("prediction_violations", f"""with {SCORES_SQL}, p as (
  select case when click_id % 11 = 0 then null else click_id end as id, case when click_id % 13 = 0 then null else click_day end as d,
    case when click_id % 17 = 0 then 'nan'::double when click_id % 19 = 0 then 1.5 when click_id % 23 = 0 then null else probability end as q from scored
  union all select click_id, click_day, probability from scored where click_id % 29 = 0)
select count(*) filter (q is null or isnan(q) or q < 0 or q > 1) as bad_probability, count(*) filter (d is null) as bad_day, count(*) filter (id is null) as bad_id,
  count(id) - count(distinct id) as repeated from p""")
def prediction_violations(spark, sf_dir):
    s = scores(spark, sf_dir).select("click_id", "click_day", "probability")
    hit = lambda k: F.col("click_id") % k == 0
    p = F.when(hit(17), F.lit(float("nan"))).when(hit(19), 1.5).when(hit(23), F.lit(None)).otherwise(F.col("probability"))
    bad = s.select(F.when(~hit(11), F.col("click_id")).alias("click_id"), F.when(~hit(13), F.col("click_day")).alias("click_day"), p.alias("probability"))
    return states.prediction_violations(bad.unionByName(s.where(hit(29))))


@query("sealed_join", f"with {SCORES_SQL} select click_id, probability, final_label, click_time, available_at from scored where click_day between 8 and 20")
def sealed_join(spark, sf_dir):
    s = scores(spark, sf_dir)
    p = s.where(F.col("click_day").between(8, 20)).select("click_id", "probability")
    return states.sealed_with_truth(p, s, origin(s) + 21 * DAY + MATURITY)


@query("compact_probabilities", f"with {SCORES_SQL} select row_number() over (order by click_time, click_id) - 1 as position, round(probability, 9) as probability from scored")
def compact_probabilities(spark, sf_dir):
    return states.compact_probabilities(scores(spark, sf_dir), ["click_time", "click_id"]).withColumn("probability", F.round("probability", 9))


@query("gathered_features", f"with {CLICKS_SQL} select click_id as position, r.click_id - r.click_id % 2 as click_id, c.price from clicks r join (select click_id as i, price from clicks) c on c.i = r.click_id where r.click_id % 2 = 0")
def gathered_features(spark, sf_dir):
    c = click_log(spark, sf_dir).select("click_id", "price")
    return states.gathered(c, c.where("click_id % 2 = 0").select(F.col("click_id").alias("position"), "click_id"))


@query("dictionary_codes", "select event_id, event_type, k.code from events left join (select event_type as t, dense_rank() over (order by event_type) - 1 as code from (select distinct event_type from events where event_type is not null)) k on k.t = event_type")
def dictionary_codes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return states.coded(e, states.dictionary(e, "event_type"), "event_type").select("event_id", "event_type", "code")


# ---- states --------------------------------------------------------------------------------------------


@query("truth_cursor", f"with {CLICKS_SQL}, t as (select *, ceil((available_at - (select min(click_time) from clicks)) / {4 * DAY}.0) as step from truth) select cast(greatest(step, 1) as int) as step, count(*) as n, sum(click_id)::bigint as ids from t where step <= 8 group by 1")
def truth_cursor(spark, sf_dir):
    """Eight steps of four days, with a cursor that is resumed from its state before each."""
    t = truth(spark, sf_dir)
    start, cursor, out = origin(t), states.TruthCursor(t), None
    for step in range(1, 9):
        cursor = states.TruthCursor.resumed(t, cursor.state())
        got = cursor.advance(start + step * 4 * DAY).agg(F.count("*").alias("n"), F.sum("click_id").alias("ids")).select(F.lit(step).alias("step"), "n", "ids")
        out = got if out is None else out.unionByName(got)
    return out.where("n > 0")


_member = "('0x' || substr(md5('m:' || click_id), 1, 8))::bigint % 10 = 0"


@query("monitoring_cohort", f"with {CLICKS_SQL} select click_day, count(*) as n, sum(final_label)::bigint as positives from truth where click_day between 10 and 16 and {_member} group by 1")
def monitoring_cohort(spark, sf_dir):
    t = with_day(truth(spark, sf_dir))
    members = t.where(hashing.md5_number(F.concat(F.lit("m:"), F.col("click_id").cast("string"))) % 10 == 0).select("click_id", "click_day")
    labels = states.monitoring_labels(t, members, origin(t) + 20 * DAY)
    c = states.monitoring_cohort(members, labels, 20, lag_days=4, cohort_days=7)
    return c.groupBy("click_day").agg(F.count("*").alias("n"), F.sum("final_label").alias("positives"))


_planted = "case when day % 7 = 0 then 'missing' when day % 11 = 0 then 'repeated' else 'changed' end as difference"


@query("replay_fixed", f"select cast((day - 31) // 5 as int) as window_id, cast(day as int) as day, {_planted} from range(31, 90) r(day) where day % 7 = 0 or day % 5 = 0 or day % 11 = 0 union all select 99, 95, 'unexpected'")
def replay_fixed(spark, sf_dir):
    """A log of decisions with planted gaps, repeats, changes and an extra row against its replay."""
    w = scheduling.credit_windows(spark)
    log = scheduling.fixed_spends(w, "midpoint").where("day % 7 <> 0")
    log = log.withColumn("spend", F.when(F.col("day") % 5 == 0, ~F.col("spend")).otherwise(F.col("spend")))
    extra = spark.createDataFrame([(99, 95, True, "fixed_midpoint")], "window_id int, day int, spend boolean, reason string")
    return scheduling.replayed_fixed(log.unionByName(log.where("day % 11 = 0")).unionByName(extra), w, "midpoint")


@query("replay_drift", "select cast((day - 8) // 5 as int) as window_id, cast(day as int) as day, case when day % 7 = 0 then 'missing' else 'changed' end as difference from range(8, 27) r(day) where day % 7 = 0 or day % 5 = 0")
def replay_drift(spark, sf_dir):
    """Decisions of logged evidence, with scores changed on some days and other days left out, against their replay."""
    from latelens.plans.queries import _scored_evidence

    w, e = scheduling.credit_windows(spark, 8, 27, 5), _scored_evidence(spark, sf_dir)
    log = scheduling.drift_decisions(w, e).where("day % 7 <> 0")
    log = log.withColumn("score", F.when(F.col("day") % 5 == 0, F.coalesce("score", F.lit(0.0)) + 1).otherwise(F.col("score")))
    return scheduling.replayed_drift(log, w, e)


_kinds = ["EARLY_POSITIVE", "PROVISIONAL", "CORRECTION"]


@query("record_masks", f"with {CLICKS_SQL}, r as ({_fixed('fixed_wait')} union all select * from ({_fixed('fixed_wait')}) where click_id % 10 = 0) select click_id, count(*) as n, bit_or(case kind when 'EARLY_POSITIVE' then 1 when 'PROVISIONAL' then 2 else 4 end)::int as mask from r group by 1")
def record_masks(spark, sf_dir):
    r = strategies.fixed_wait(truth(spark, sf_dir), WAIT)
    return states.record_masks(r.unionByName(r.where("click_id % 10 = 0")), _kinds)


@query("repeated_records", f"with {CLICKS_SQL}, r as ({_fixed('fixed_wait')}) select click_id, 2 * count(*) as n from r where click_id % 10 = 0 group by 1")
def repeated_records(spark, sf_dir):
    return states.repeated_records(record_masks(spark, sf_dir)).select("click_id", "n")


@query("days_out_of_order", f"with {CLICKS_SQL}, t as (select click_time, case when click_id % 50 = 0 and click_day % 4 = 0 then click_day + 1 else click_day end as click_day from truth), e as (select click_day, min(click_time) as first, max(click_time) as last from t group by 1), b as (select *, max(last) over (order by click_day rows between unbounded preceding and 1 preceding) as before from e) select click_day, first, last, before from b where first < before")
def days_out_of_order(spark, sf_dir):
    d = with_day(click_log(spark, sf_dir))
    late = (F.col("click_id") % 50 == 0) & (F.col("click_day") % 4 == 0)
    return states.days_out_of_order(d.withColumn("click_day", F.when(late, F.col("click_day") + 1).otherwise(F.col("click_day"))))


@query("undrained", f"with {CLICKS_SQL}, n as (select min(click_time) + {15 * DAY} as now from clicks) select count(*) filter (available_at > now) as pending, count(*) filter (available_at <= now) as drained from truth, n")
def undrained(spark, sf_dir):
    t = truth(spark, sf_dir)
    return eventtime.undrained(t, origin(t) + 15 * DAY)


@query("excluded_members", f"with {CLICKS_SQL}, r as ({_fixed('fixed_wait')}) select click_id, kind from r where {_member}")
def excluded_members(spark, sf_dir):
    t = truth(spark, sf_dir)
    members = t.where(hashing.md5_number(F.concat(F.lit("m:"), F.col("click_id").cast("string"))) % 10 == 0).select("click_id")
    return checks.excluded_members(strategies.fixed_wait(t, WAIT), members).select("click_id", "kind")


@query("not_increasing", "with b as (select o_orderkey, o_custkey, o_totalprice, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as before from orders) select o_orderkey, o_totalprice, before from b where o_totalprice <= before")
def not_increasing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return checks.not_increasing(o, "o_custkey", "o_orderkey", "o_totalprice").select("o_orderkey", "o_totalprice", "before")


@query("daily_spends", f"with {CLICKS_SQL} select cast(d as int) as day from range(3, 41) r(d) where d in (select click_day from truth where final_label = 1)")
def daily_spends(spark, sf_dir):
    pool = with_day(truth(spark, sf_dir)).where("final_label = 1").select(F.col("click_day").alias("day"))
    return scheduling.daily_spends(spark, 3, 40, pool)


@query("day_range", f"with {CLICKS_SQL} select click_id, click_time from truth where click_day between 4 and 9 and click_time > (select min(click_time) from clicks) + {4 * DAY}")
def day_range(spark, sf_dir):
    to, c = _folder(spark), with_day(click_log(spark, sf_dir)).select("click_id", "click_time", "click_day")
    sinks.write_days(c, to)
    return readers.read_days(spark, to, 4, 9).where(F.col("click_time") > origin(c) + 4 * DAY).select("click_id", "click_time")


# ---- functions -----------------------------------------------------------------------------------------


@query("hex_ids", "select event_id, sha256('e:' || event_id) as hex, 32 as size, event_id % 2 = 0 as well_formed from events")
def hex_ids(spark, sf_dir):
    """Ids through bytes and back; those of odd events lose a digit and are no ids any more."""
    h = F.sha2(F.concat(F.lit("e:"), F.col("event_id").cast("string")), 256)
    given = F.when(F.col("event_id") % 2 == 0, h).otherwise(F.substring(h, 1, 63))
    b = hashing.id_bytes(h)
    return table(spark, sf_dir, "events").select("event_id", hashing.id_hex(b).alias("hex"), F.octet_length(b).alias("size"), hashing.is_hex_id(given).alias("well_formed"))


@query("logits", "with v as (select event_id, (event_id % 997 + 1) / 1000.0::double as p, (event_id % 2001 - 1000) / 10.0::double as z from events) select event_id, round(ln(p / (1 - p)), 9) as logit, round(case when z >= 0 then 1 / (1 + exp(-z)) else exp(z) / (1 + exp(z)) end, 9) as sigmoid from v")
def logits(spark, sf_dir):
    p, z = (F.col("event_id") % 997 + 1) / F.lit(1000.0), (F.col("event_id") % 2001 - 1000) / F.lit(10.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(N.logit(p), 9).alias("logit"), F.round(N.sigmoid(z), 9).alias("sigmoid"))


@query("boundaries", "select event_id, cast(ceil((event_id % 4 + 1) * 0.25 * (event_id % 61)) as bigint) as snapshot, cast(ceil(event_id * 7.0 / 3600) as bigint) as tick from events")
def boundaries(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", N.snapshot_boundary((i % 4 + 1) * 0.25, i % 61).alias("snapshot"), N.tick_of(i * 7, 3600).alias("tick"))


@query("offline_features", f"with {CLICKS_SQL}, c as (select click_id, click_time, row_number() over (partition by user_id order by click_time, click_id) as a, count(*) over (partition by user_id order by click_time range between unbounded preceding and 1 preceding) as u, count(*) over (partition by product order by click_time range between unbounded preceding and 1 preceding) as p, product % 16 as b from clicks) select click_id, round(b / 16.0::double, 9) as product_scaled, round(ln(1 + u), 9) as log_prior_user, round(ln(1 + p), 9) as log_prior_product from c")
def offline_features(spark, sf_dir):
    d = features.prior_counts(click_log(spark, sf_dir), {"user": "user_id", "product": "product"}).withColumn("product_bucket", F.col("product") % 16)
    d = features.offline_features(d, {"product": 16})
    return d.select("click_id", *[F.round(c, 9).alias(c) for c in ("product_scaled", "log_prior_user", "log_prior_product")])


@query("sorted_log", f"with {CLICKS_SQL} select 1 as falls_sorted, 0 as sorted_sorted, count(*) as n from clicks")
def sorted_log(spark, sf_dir):
    """A log with one early row is sorted, and is left alone once it is."""
    c = click_log(spark, sf_dir).select("click_id", "click_time")
    at = states.compact_probabilities(c.withColumn("probability", F.col("click_time")), ["click_time", "click_id"])
    d, did = states.sorted_unless_monotonic(at.withColumn("v", F.when(F.col("position") == 3, -1).otherwise(F.col("probability"))), "position", "v")
    _, again = states.sorted_unless_monotonic(at, "position", "probability")
    return d.agg(F.count("*").alias("n")).select(F.lit(int(did)).alias("falls_sorted"), F.lit(int(again)).alias("sorted_sorted"), "n")
