"""Registered queries over the driver's tables, each beside the SQL that says the same.

Times are microseconds; the protocol is scaled to the 30 days of the events table. Floating aggregates
are rounded, since sums come in another order elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latelens.functions import numeric as N
from latelens.functions.hashing import categorical_bucket, md5_number
from latelens.operators import bootstrap, evaluation, eventtime, features, ingest, protocol, sampling, scheduling, strategies
from latelens.sources.scratch import stored
from latelens.sources.adapters import CLICKS_SQL, DAY, MATURITY, RAW_SQL, SCORES_SQL, TICK, click_log, origin, raw_log, scores, table, truth, with_day

WAIT = DAY
QUERIES: dict = {}
ORACLE_SQL: dict = {}
FIELDS = ["Sale", "SalesAmountInEuro", "time_delay_for_conversion", "click_timestamp", "nb_clicks_1week", "product_price", "device_type"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c, digits: int = 6):
    return F.round(c, digits)


# ---- ingest ------------------------------------------------------------------------------------------

REASONS_SQL = f"""with {RAW_SQL},
n as (select *, case when "Sale" in ('0', '1') then cast("Sale" as int) else -1 end as sale_n, try_cast("SalesAmountInEuro" as double) as a,
    try_cast(time_delay_for_conversion as double) as d, try_cast(click_timestamp as double) as t, try_cast(nb_clicks_1week as double) as k, try_cast(product_price as double) as pp from raw),
v as (select *, concat_ws(',',
    case when sale_n = -1 then 'INVALID_SALE' end,
    case when a is null or d is null or t is null or k is null or pp is null then 'INVALID_NUMBER' end,
    case when isnan(t) then 'NONFINITE_NUMBER' end,
    case when "Sale" = '' then 'EMPTY_FIELD' end,
    case when not isnan(t) and t <= 0 then 'MISSING_OR_NEGATIVE_CLICK_TIME' end,
    case when k < -1 or pp < -1 then 'INVALID_NEGATIVE_VALUE' end,
    case when (sale_n = 0 and a <> -1) or (sale_n = 1 and a < 0) then 'SALE_AMOUNT_INCONSISTENT' end,
    case when (sale_n = 0 and d <> -1) or (sale_n = 1 and d < 0) then 'SALE_DELAY_INCONSISTENT' end) as reasons from n)"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.reason_codes(raw_log(spark, sf_dir), FIELDS)


def _ordered_reasons():
    """Reasons in the fixed order of the codes, as one string: NONFINITE comes behind INVALID_NUMBER."""
    order = ["INVALID_SALE", "INVALID_NUMBER", "NONFINITE_NUMBER", "EMPTY_FIELD", "MISSING_OR_NEGATIVE_CLICK_TIME", "INVALID_NEGATIVE_VALUE", "SALE_AMOUNT_INCONSISTENT", "SALE_DELAY_INCONSISTENT"]
    return F.array_join(F.array_intersect(F.array(*[F.lit(x) for x in order]), F.col("reasons")), ",")


@query("validate_reasons", REASONS_SQL + " select raw_row_index, reasons, cast(sale_n as bigint) as sale from v")
def validate_reasons(spark, sf_dir):
    return _validated(spark, sf_dir).select("raw_row_index", _ordered_reasons().alias("reasons"), F.col("sale_flag").cast("long").alias("sale"))


@query("quarantine_split", REASONS_SQL + " select count(*) as parsed, count(*) filter (reasons = '') as accepted, count(*) filter (reasons <> '') as quarantined from v")
def quarantine_split(spark, sf_dir):
    v = _validated(spark, sf_dir)
    return v.agg(F.count("*").alias("parsed"), F.count_if(F.size("reasons") == 0).alias("accepted"), F.count_if(F.size("reasons") > 0).alias("quarantined"))


@query("reason_hist", REASONS_SQL + " select reason, count(*) as n from (select unnest(string_split(reasons, ',')) as reason from v where reasons <> '') group by reason")
def reason_hist(spark, sf_dir):
    return ingest.reason_histogram(_validated(spark, sf_dir))


@query("raw_profile", REASONS_SQL + """ select count(*) as parsed, count(*) filter (reasons = '') as accepted, count(*) filter (reasons <> '') as quarantined,
  min(t) filter (reasons = '') as first_click, max(t) filter (reasons = '') as last_click, count(*) filter (reasons = '' and sale_n = 1) as positives,
  sum(d) filter (reasons = '' and sale_n = 1) as delay_sum, min(d) filter (reasons = '' and sale_n = 1) as delay_min, max(d) filter (reasons = '' and sale_n = 1) as delay_max from v""")
def raw_profile(spark, sf_dir):
    return ingest.profile(_validated(spark, sf_dir))


_field = lambda f, num: f"""select '{f}' as field, count(*) as n_rows, count(*) filter (trim("{f}") = '') as n_missing, count(*) filter (trim("{f}") = '-1') as n_sentinel,
  {f'''count(*) filter (trim("{f}") <> '' and try_cast("{f}" as double) is null), count(*) filter (isnan(try_cast("{f}" as double))), count(*) filter (try_cast("{f}" as double) < 0)''' if num else '0, 0, 0'} from raw"""  # noqa: E731


@query("field_profile", f"with {RAW_SQL}, u(field, n_rows, n_missing, n_sentinel, n_invalid, n_nonfinite, n_negative) as (" + " union all ".join(_field(f, f in ingest.NUMBERS) for f in FIELDS) + ") select * from u")
def field_profile(spark, sf_dir):
    return ingest.field_profile(raw_log(spark, sf_dir), FIELDS)


@query("sale_delay_consistency", REASONS_SQL + " select cast(sale_n as bigint) as sale, case when d is null then 'invalid' when d = -1 then 'sentinel' when d < 0 then 'negative' else 'present' end as delay, count(*) as n from v group by 1, 2")
def sale_delay_consistency(spark, sf_dir):
    return ingest.consistency(_validated(spark, sf_dir)).select(F.col("sale_flag").cast("long").alias("sale"), "delay", "n")


DUP = ["Sale", "SalesAmountInEuro", "time_delay_for_conversion", "nb_clicks_1week", "device_type"]


@query("duplicate_rows", f"""with {RAW_SQL} select count(*) - (select count(*) from (select distinct "Sale", "SalesAmountInEuro", time_delay_for_conversion, nb_clicks_1week, device_type from raw)) as n_duplicates from raw""")
def duplicate_rows(spark, sf_dir):
    return ingest.duplicate_rows(raw_log(spark, sf_dir), DUP)


@query("column_counts", "select n_columns, count(*) as n from (select len(string_split(text, '.')) as n_columns from documents) group by 1")
def column_counts(spark, sf_dir):
    return ingest.column_counts(table(spark, sf_dir, "documents"), "text", r"\.")


@query("time_unit", f"""with {CLICKS_SQL}, s as (select min(click_time) as a, max(click_time) as b, max(available_at - click_time) filter (final_label = 1) as m from truth)
select multiplier, round((b - a) * multiplier / 86400, 6) as span_days, round(m * multiplier / 86400, 6) as max_delay_days,
  (b - a) * multiplier / 86400 between 25 and 35 and m * multiplier / 86400 between 0 and 30 as fits
from s, (values (1.0::double), (1e-3::double), (1e-6::double), (1e-9::double)) x(multiplier)""")
def time_unit(spark, sf_dir):
    t = truth(spark, sf_dir)
    a, b, m = t.agg(F.min("click_time"), F.max("click_time"), F.max(F.when(F.col("final_label") == 1, F.col("available_at") - F.col("click_time")))).first()
    d = ingest.time_units(a, b, m, spark, span=(25, 35))
    return d.select("multiplier", r6("span_days").alias("span_days"), r6("max_delay_days").alias("max_delay_days"), "fits")


@query("day_stats", f"with {CLICKS_SQL} select click_day, count(*) as n_rows, sum(final_label)::bigint as n_positive, round(avg(final_label), 6) as rate from truth group by click_day")
def day_stats(spark, sf_dir):
    return ingest.day_stats(with_day(truth(spark, sf_dir))).withColumn("rate", r6("rate"))


@query("event_horizon", f"with {CLICKS_SQL} select max(click_time) as last_click, max(available_at) filter (final_label = 1) as last_reveal, max(available_at) filter (final_label = 0) as last_maturity from truth")
def event_horizon(spark, sf_dir):
    return ingest.event_horizon(truth(spark, sf_dir))


@query("monotonic_violations", "select count(*)::bigint as violations from (select o_totalprice < lag(o_totalprice) over (order by o_orderkey) as v from orders) where v")
def monotonic_violations(spark, sf_dir):
    return ingest.monotonic_violations(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice")


# ---- features ----------------------------------------------------------------------------------------


@query("prior_counts", f"""with {CLICKS_SQL} select click_id, row_number() over (partition by user_id order by click_time, click_id) - 1 as prior_user_clicks,
  row_number() over (partition by product order by click_time, click_id) - 1 as prior_product_clicks from clicks""")
def prior_counts(spark, sf_dir):
    d = features.prior_counts(click_log(spark, sf_dir), {"user": "user_id", "product": "product"})
    return d.select("click_id", "prior_user_clicks", "prior_product_clicks")


@query("cold_flags", f"""with {CLICKS_SQL}, p as (select row_number() over (partition by user_id order by click_time, click_id) = 1 as cold_user,
  row_number() over (partition by product order by click_time, click_id) = 1 as cold_product from clicks) select cold_user, cold_product, count(*) as n from p group by 1, 2""")
def cold_flags(spark, sf_dir):
    d = features.prior_counts(click_log(spark, sf_dir), {"user": "user_id", "product": "product"})
    return d.groupBy("cold_user", "cold_product").agg(F.count("*").alias("n"))


_BURN = 3


@query("burn_in_quantiles", f"""with {CLICKS_SQL}, v as (select ln(1 + price) as v, row_number() over (order by ln(1 + price)) - 1 as i, count(*) over () as n from truth where click_day < {_BURN} and price >= 0)
select q, (select round(v, 9) from v where i = floor((n - 1) * q + 0.5)) as nearest, case when q < 0.5 then (select round(quantile_cont(v, 0.01), 9) from v) else (select round(quantile_cont(v, 0.99), 9) from v) end as linear from (values (0.01::double), (0.99::double)) x(q)""")
def burn_in_quantiles(spark, sf_dir):
    d = with_day(truth(spark, sf_dir)).where(F.col("click_day") < _BURN)
    v = N.log1p_or_null(F.col("price"))
    near = features.nearest_quantiles(d, v, (0.01, 0.99))
    qs = list(near)
    lin = d.agg(F.percentile(v, F.array(*[F.lit(q) for q in qs])).alias("l")).first()["l"]
    return spark.createDataFrame([(q, near[q], x) for q, x in zip(qs, lin)], "q double, nearest double, linear double").select("q", F.round("nearest", 9).alias("nearest"), F.round("linear", 9).alias("linear"))


@query("numeric_transform", f"""with {CLICKS_SQL}, b as (select ln(1 + price) as v from truth where click_day < {_BURN} and price >= 0),
r as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from b),
q as (select min(v) filter (i = floor((n - 1) * 0.01 + 0.5)) as lo, min(v) filter (i = floor((n - 1) * 0.99 + 0.5)) as hi from r),
s as (select lo, hi, avg(least(greatest(v, lo), hi)) as m, stddev_pop(least(greatest(v, lo), hi)) as d from b, q group by lo, hi)
select click_id, round((least(greatest(ln(1 + price), lo), hi) - m) / d, 6) as price_value, price = -1 as price_missing from truth, s""")
def numeric_transform(spark, sf_dir):
    d = with_day(truth(spark, sf_dir))
    stat = features.fit_numeric(d.where(F.col("click_day") < _BURN), "price")
    return features.transform_numeric(d, "price", stat).select("click_id", r6("price_value").alias("price_value"), "price_missing")


@query("hash_buckets_md5", f"with {CLICKS_SQL} select ('0x' || substr(md5('product:' || product), 1, 8))::bigint % 4096 as bucket, count(*) as n from clicks group by 1")
def hash_buckets_md5(spark, sf_dir):
    b = md5_number(F.concat(F.lit("product:"), F.col("product").cast("string"))) % 4096
    return click_log(spark, sf_dir).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("hash_buckets_xx")
def hash_buckets_xx(spark, sf_dir):
    b = categorical_bucket("product", F.col("product").cast("string"), 20260813, 4096)
    return click_log(spark, sf_dir).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


for _k, _l in (("truth_reveal", 1), ("truth_maturity", 0)):
    query(_k, f"with {CLICKS_SQL} select click_id, final_label, click_time, available_at from truth where final_label = {_l}")(lambda spark, sf_dir, l=_l: features.route_truth(truth(spark, sf_dir))[1 - l])


@query("truth_reconcile", f"""with {CLICKS_SQL} select 0::bigint as missing_truth, count(*) filter (t.click_id is null) as missing_features, 0::bigint as duplicates, 0::bigint as unequal_times from truth t full outer join clicks c on t.click_id = c.click_id""")
def truth_reconcile(spark, sf_dir):
    return features.reconcile(click_log(spark, sf_dir), truth(spark, sf_dir))


@query("feature_lookup", f"with {CLICKS_SQL} select o.o_orderkey as click_id, c.product from orders o join clicks c on c.click_id = o.o_orderkey")
def feature_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("click_id"))
    return features.lookup(click_log(spark, sf_dir).select("click_id", "product"), ids)[0]


SCALED = {"burn_in": (0, 2), "training": (3, 4), "selection": (5, 8), "embargo": (9, 14), "final": (15, 26)}


@query("period_rows", f"""with {CLICKS_SQL} select case when click_day between 0 and 2 then 'burn_in' when click_day between 3 and 4 then 'training' when click_day between 5 and 8 then 'selection'
  when click_day between 9 and 14 then 'embargo' when click_day between 15 and 26 then 'final' else 'outside' end as period, count(*) as n from truth group by 1""")
def period_rows(spark, sf_dir):
    return protocol.period_rows(with_day(click_log(spark, sf_dir)), SCALED)


@query("mature_split", f"""with {CLICKS_SQL}, c as (select min(click_time) + {15 * DAY} as t from clicks) select count(*) filter (click_time <= t and click_time + {MATURITY} <= t and available_at <= t) as n_train, count(*) filter (click_time > t) as n_eval from truth, c""")
def mature_split(spark, sf_dir):
    t = truth(spark, sf_dir)
    cut = origin(t) + 15 * DAY
    old, new = features.mature_split(t, cut, MATURITY)
    both = old.select(F.lit(1).alias("a")).unionByName(new.select(F.lit(0).alias("a")))
    return both.agg(F.count_if(F.col("a") == 1).alias("n_train"), F.count_if(F.col("a") == 0).alias("n_eval"))


@query("price_quartile", f"""with {CLICKS_SQL}, q as (select quantile_cont(price, 0.25) as a, quantile_cont(price, 0.5) as b, quantile_cont(price, 0.75) as c from truth where click_day < {_BURN})
select cast(price >= a as int) + cast(price >= b as int) + cast(price >= c as int) as price_bin, count(*) as n from truth, q group by 1""")
def price_quartile(spark, sf_dir):
    d = with_day(truth(spark, sf_dir))
    return features.price_quartile(d, d.where(F.col("click_day") < _BURN)).groupBy("price_bin").agg(F.count("*").alias("n"))


# ---- strategies and the clock ------------------------------------------------------------------------

_rec = lambda m, k, at, y, where="true": f"select click_id, {at} as available_at, '{k}' as kind, cast({y} as double) as target, '{m}' as method from truth where {where}"
_early = f"final_label = 1 and available_at <= click_time + {WAIT}"


def _fixed(m):
    return " union all ".join([_rec(m, "EARLY_POSITIVE", "available_at", 1, _early), _rec(m, "PROVISIONAL", f"click_time + {WAIT}", 0, f"not ({_early})"), _rec(m, "CORRECTION", "available_at", 1, f"final_label = 1 and not ({_early})")])


def _fake(m):
    return _rec(m, "PROVISIONAL", "click_time", 0) + " union all " + _rec(m, "CORRECTION", "available_at", 1, "final_label = 1")


STRATEGY_SQL = {
    "complete_wait": _rec("complete_wait", "FINAL", f"click_time + {MATURITY}", "final_label"),
    "immediate_fake_negative": _fake("immediate_fake_negative"),
    "fixed_wait": _fixed("fixed_wait"),
    "dfm": _rec("dfm", "DFM_CLICK", "click_time", 0),
    "fnw": _fake("fnw"),
    "es_dfm": _fixed("es_dfm"),
    "oracle_reference": _rec("oracle_reference", "FINAL", "click_time", "final_label"),
    "mature_outcome": _rec("mature_outcome", "FINAL", "available_at", "final_label"),
}
for _name, _make in strategies.strategies(WAIT, MATURITY).items():
    query(f"records_{_name}", f"with {CLICKS_SQL} {STRATEGY_SQL[_name]}")(lambda spark, sf_dir, make=_make: make(truth(spark, sf_dir)))


@query("fixed_wait_records", f"""with {SCORES_SQL}, r as ({_fixed('fixed_wait')}),
k as (select cast(floor((available_at - (select min(click_time) from clicks)) / {DAY}) as int) as day, kind, count(*) as n from r group by 1, 2),
m as (select click_day, round(avg(-(final_label * ln(probability) + (1 - final_label) * ln(1 - probability))), 6) as log_loss from scored group by 1)
select k.day, k.kind, k.n, m.log_loss from k left join m on m.click_day = k.day""")
def fixed_wait_records(spark, sf_dir):
    s = scores(spark, sf_dir)
    start = origin(click_log(spark, sf_dir))
    day = F.floor((F.col("available_at") - start) / DAY).cast("int")
    k = strategies.fixed_wait(s, WAIT).groupBy(day.alias("day"), "kind").agg(F.count("*").alias("n"))
    m = evaluation.point_metrics(s, ["click_day"]).select(F.col("click_day").alias("day"), r6("log_loss").alias("log_loss"))
    return k.join(m, "day", "left")


@query("es_aux", f"""with {CLICKS_SQL} select click_id, click_time + {MATURITY} as available_at, 'q_dp' as model, cast(final_label = 1 and not ({_early}) as int) as target from truth
union all select click_id, click_time + {MATURITY}, 'q_tn', cast(final_label = 0 as int) from truth where not ({_early})""")
def es_aux(spark, sf_dir):
    return strategies.es_auxiliary(truth(spark, sf_dir), WAIT, MATURITY)


@query("dfm_asof", f"""with {CLICKS_SQL}, d as (select min(click_time) + x * {DAY} as decision_time from clicks, (values (5), (10), (20)) v(x) group by x)
select decision_time, status, count(*) as n, sum(elapsed)::bigint as elapsed from (
  select decision_time, case when final_label = 1 and available_at <= decision_time then 'revealed_positive' when final_label = 0 and decision_time >= click_time + {MATURITY} then 'mature_negative' else 'right_censored' end as status,
    case when final_label = 1 and available_at <= decision_time then available_at - click_time else least(decision_time - click_time, {MATURITY}) end as elapsed
  from truth join d on click_time <= decision_time) group by 1, 2""")
def dfm_asof(spark, sf_dir):
    t = truth(spark, sf_dir)
    start = origin(t)
    d = spark.createDataFrame([(start + x * DAY,) for x in (5, 10, 20)], "decision_time long")
    return strategies.dfm_asof(t, d, MATURITY).groupBy("decision_time", "status").agg(F.count("*").alias("n"), F.sum("elapsed").alias("elapsed"))


_trace = f"""with {CLICKS_SQL}, k as (select *, cast(ceil((click_time - (select min(click_time) from clicks)) / {TICK}::double) as bigint) as pt, cast(ceil((available_at - (select min(click_time) from clicks)) / {TICK}::double) as bigint) as av from truth),
trace as (select pt as tick, 0 as phase, click_time as at, click_id, 'predict' as kind from k union all select pt, 1, click_time, click_id, 'deliver' from k union all select greatest(pt, av), 2, available_at, click_id, 'reveal' from k)"""


@query("event_trace", _trace + " select * from trace")
def event_trace(spark, sf_dir):
    t = truth(spark, sf_dir)
    return eventtime.event_trace(t, TICK, origin(t))


@query("tick_counts", _trace + " select tick, kind, count(*) as n from trace group by 1, 2")
def tick_counts(spark, sf_dir):
    t = truth(spark, sf_dir)
    return eventtime.per_tick(eventtime.event_trace(t, TICK, origin(t)))


@query("trace_audit", _trace + " select click_id, count(*) filter (kind = 'predict') as n_predictions from trace group by click_id having count(*) filter (kind = 'predict') <> 1")
def trace_audit(spark, sf_dir):
    t = truth(spark, sf_dir)
    return eventtime.audit(eventtime.event_trace(t, TICK, origin(t)))


@query("legal_at", f"with {CLICKS_SQL}, r as ({_fixed('fixed_wait')}) select kind, count(*) as n from r where available_at <= (select min(click_time) + {10 * DAY} from clicks) group by kind")
def legal_at(spark, sf_dir):
    t = truth(spark, sf_dir)
    return strategies.legal_at(strategies.fixed_wait(t, WAIT), origin(t) + 10 * DAY).groupBy("kind").agg(F.count("*").alias("n"))


@query("reveals_through", f"with {CLICKS_SQL} select click_id, final_label, available_at from truth where available_at <= (select min(click_time) + {10 * DAY} from clicks) and click_time <= (select min(click_time) + {10 * DAY} from clicks)")
def reveals_through(spark, sf_dir):
    t = truth(spark, sf_dir)
    return eventtime.reveals_through(t, origin(t) + 10 * DAY).select("click_id", "final_label", "available_at")


@query("truth_violations", "select o_orderkey as click_id, case when g < 0 then 'before_click' when y = 1 and g > 30 then 'late_positive' else 'immature_negative' end as reason from (select o_orderkey, cast(o_orderstatus = 'F' as int) as y, cast(o_custkey % 61 as int) - 10 as g from orders) where g < 0 or (y = 1 and g > 30) or (y = 0 and g <> 30)")
def truth_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = o.select(F.col("o_orderkey").alias("click_id"), F.lit(0).alias("click_time"), (F.col("o_orderstatus") == "F").cast("int").alias("final_label"), (F.col("o_custkey") % 61 - 10).cast("int").alias("available_at"))
    return eventtime.violations(d, 30).select("click_id", "reason")


@query("sequence_check", "select l_orderkey as run_id, l_linenumber as sequence from (select *, row_number() over (partition by l_orderkey order by l_linenumber) as i from lineitem) where l_linenumber <> i - 1")
def sequence_check(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("sequence"))
    return eventtime.broken_sequence(d).select("run_id", "sequence")


# ---- scheduling and sampling -------------------------------------------------------------------------

_windows = "w as (select cast((s - 31) / 5 as int) as window_id, cast(s as int) as start_day, cast(least(s + 5, 90) as int) as end_day, cast(s as int) as early, cast(ceil((s + least(s + 5, 90)) / 2.0) as int) as midpoint, cast(least(s + 5, 90) - 1 as int) as deadline from range(31, 90, 5) r(s))"


@query("credit_windows", f"with {_windows} select * from w")
def credit_windows(spark, sf_dir):
    return scheduling.credit_windows(spark)


for _p in ("early", "midpoint", "deadline"):
    query(
        f"fixed_{_p}",
        f"with {_windows} select window_id, cast(d as int) as day, d = {_p} as spend, case when d = {_p} then 'fixed_{_p}' when d > {_p} then 'already_spent' else 'waiting' end as reason from w, range(31, 90) r(d) where d >= start_day and d < end_day",
    )(lambda spark, sf_dir, p=_p: scheduling.fixed_spends(scheduling.credit_windows(spark), p))

_EV = dict(lag_days=4, cohort_days=3, min_rows=20, min_variance=1.0)
_evidence = f"""{SCORES_SQL}, g as (select decision_day, least(cast(floor(probability * 10) as int), 9) as bin, count(*) as n, sum(final_label - probability) as r, sum(probability * (1 - probability)) as v
  from scored join range(8, 27) d(decision_day) on click_day between decision_day - 6 and decision_day - 4 group by 1, 2),
e as (select decision_day, sum(n) as n, max(round(abs(r) / sqrt(v + 1e-8), 6)) filter (n >= 20 and v >= 1.0) as score from g group by 1)"""


def _scored_evidence(spark, sf_dir):
    days = spark.range(8, 27).select(F.col("id").cast("int").alias("decision_day"))
    return scheduling.evidence(scores(spark, sf_dir), days, **_EV)


@query("calibration_evidence", f"with {_evidence} select cast(decision_day as int) as decision_day, n::bigint as n, score, (select min(bin) from g where g.decision_day = e.decision_day and g.n >= 20 and g.v >= 1.0 and round(abs(r) / sqrt(v + 1e-8), 6) = e.score) as bin from e")
def calibration_evidence(spark, sf_dir):
    return _scored_evidence(spark, sf_dir).withColumn("score", r6("score"))


@query("drift_decisions", f"""with {_evidence}, w as (select cast((s - 8) / 5 as int) as window_id, s as a, least(s + 5, 27) as b from range(8, 27, 5) r(s)),
d as (select w.window_id, cast(x as int) as day, score, b - 1 as deadline, coalesce(score > 3.0, false) as hit from w join range(8, 27) r(x) on x >= a and x < b left join e on e.decision_day = x),
f as (select *, coalesce(bool_or(hit) over (partition by window_id order by day rows between unbounded preceding and 1 preceding), false) as spent from d)
select window_id, day, score, not spent and (hit or day = deadline) as spend, case when spent then 'already_spent' when hit then 'drift' when day = deadline then 'forced_deadline' else 'below_threshold' end as reason from f""")
def drift_decisions(spark, sf_dir):
    w = scheduling.credit_windows(spark, 8, 27, 5)
    return scheduling.drift_decisions(w, _scored_evidence(spark, sf_dir)).withColumn("score", r6("score"))


@query("window_of_day", f"with {CLICKS_SQL}, w as (select cast((s - 8) / 5 as int) as window_id, s as a, least(s + 5, 27) as b from range(8, 27, 5) r(s)) select click_id, window_id from truth left join w on click_day >= a and click_day < b")
def window_of_day(spark, sf_dir):
    d = with_day(click_log(spark, sf_dir)).withColumnRenamed("click_day", "day")
    return scheduling.window_of(d, scheduling.credit_windows(spark, 8, 27, 5)).select("click_id", "window_id")


def _sampler(spark, sf_dir):
    t = truth(spark, sf_dir)
    r = strategies.fixed_wait(t, WAIT).withColumn("record_id", F.concat_ws(":", "click_id", "kind"))
    return r, origin(t) + 12 * DAY


_records_sql = f"with {CLICKS_SQL}, r as (select *, click_id || ':' || kind as record_id from ({_fixed('fixed_wait')}) q), n as (select min(click_time) + {12 * DAY} as t from clicks)"


@query("reservoir_bottom_k", _records_sql + f" select record_id from (select record_id, sha256('17:' || record_id) as p from r, n where available_at < t - {3 * DAY} order by p, record_id limit 100)")
def reservoir_bottom_k(spark, sf_dir):
    r, now = _sampler(spark, sf_dir)
    return sampling.reservoir(r, now, 3 * DAY, 100, 17).select("record_id")


@query("recent_split", _records_sql + f" select kind, count(*) as n from r, n where available_at between t - {3 * DAY} and t group by kind")
def recent_split(spark, sf_dir):
    r, now = _sampler(spark, sf_dir)
    return sampling.recent(r, now, 3 * DAY).groupBy("kind").agg(F.count("*").alias("n"))


@query("batch_sample", _records_sql + f""", o as (select click_id, record_id, available_at, target, n.t as t, sha256('17:' || record_id) as p from r, n where available_at <= n.t),
old as (select * from o where available_at < t - {3 * DAY} order by p, record_id limit 100),
pool as (select 'recent' as pool, record_id, target from o where available_at >= t - {3 * DAY} union all select 'reservoir', record_id, target from old),
k as (select *, row_number() over (partition by pool order by record_id) - 1 as rank, count(*) over (partition by pool) as c from pool)
select d as draw, pool, record_id, target from k join range(0, 32) x(d) on rank = ('0x' || substr(md5('5:' || d), 1, 15))::bigint % c""")
def batch_sample(spark, sf_dir):
    r, now = _sampler(spark, sf_dir)
    p = sampling.pools(r.select("click_id", "record_id", "available_at", "target"), now, 3 * DAY, 100, 17)
    return sampling.batch(p, 64, 5).select("draw", "pool", "record_id", "target")


# ---- evaluation --------------------------------------------------------------------------------------


@query("log_loss_brier", f"with {SCORES_SQL} select click_day, count(*) as n, sum(final_label)::bigint as positives, round(avg(-(final_label * ln(probability) + (1 - final_label) * ln(1 - probability))), 6) as log_loss, round(avg((probability - final_label) ** 2), 6) as brier from scored group by 1")
def log_loss_brier(spark, sf_dir):
    return evaluation.point_metrics(scores(spark, sf_dir), ["click_day"]).withColumns({"log_loss": r6("log_loss"), "brier": r6("brier")})


_auc = f"""{SCORES_SQL}, g as (select probability as p, sum(final_label) as pos, sum(1 - final_label) as neg from scored group by 1),
c as (select *, sum(pos) over (order by p desc rows unbounded preceding) as tp, sum(neg) over (order by p desc rows unbounded preceding) as fp from g)"""


@query("ranking_metrics", f"with {_auc} select round(sum(pos * tp / (tp + fp)) / sum(pos), 6) as pr_auc, round(sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)), 6) as roc_auc from c")
def ranking_metrics(spark, sf_dir):
    return evaluation.ranking_metrics(scores(spark, sf_dir)).select(r6("pr_auc").alias("pr_auc"), r6("roc_auc").alias("roc_auc"))


_rel = f"{SCORES_SQL}, b as (select least(cast(floor(probability * 10) as int), 9) as bin, count(*) as n, avg(probability) as mp, avg(final_label) as rt from scored group by 1)"


@query("reliability", f"with {_rel} select cast(x as int) as bin, coalesce(n, 0) as n, round(mp, 6) as mean_probability, round(rt, 6) as rate from range(10) r(x) left join b on b.bin = x")
def reliability(spark, sf_dir):
    return evaluation.reliability(scores(spark, sf_dir)).withColumns({"mean_probability": r6("mean_probability"), "rate": r6("rate")})


@query("calibration_error", f"with {_rel} select round(sum(n * abs(mp - rt)) / sum(n), 6) as ece from b")
def calibration_error(spark, sf_dir):
    return evaluation.calibration_error(evaluation.reliability(scores(spark, sf_dir))).select(r6("ece").alias("ece"))


@query("calibration_fit")
def calibration_fit(spark, sf_dir):
    a, b = evaluation.calibration_fit(stored(scores(spark, sf_dir).select("final_label", "probability"))) or (None, None)
    return spark.createDataFrame([(a, b)], "intercept double, slope double")


def _examples(spark, sf_dir):
    s = scores(spark, sf_dir)
    s = features.price_quartile(s, s.where(F.col("click_day") < _BURN)).withColumnRenamed("price_bin", "product_price_bin")
    s = features.prior_counts(s, {"user": "user_id", "product": "product"})
    s = s.withColumn("device_type", F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")))
    days = F.when(F.col("final_label") == 1, (F.col("available_at") - F.col("click_time")) / DAY)
    return s.withColumn("conversion_delay_days", days).where("click_day between 15 and 26").withColumn("click_day", F.col("click_day") + 50)


@query("slices", f"""with {SCORES_SQL}, q as (select quantile_cont(price, 0.25) as a, quantile_cont(price, 0.5) as b, quantile_cont(price, 0.75) as c from truth where click_day < {_BURN}),
x as (select *, row_number() over (partition by user_id order by click_time, click_id) - 1 as pu, row_number() over (partition by product order by click_time, click_id) - 1 as pp,
  cast(price >= a as int) + cast(price >= b as int) + cast(price >= c as int) as pb, (available_at - click_time) / {DAY}.0 as dd from scored, q),
e as (select * from x where click_day between 15 and 26),
s as (select 'cold_user' as dimension, case when pu = 0 then 'true' else 'false' end as value, final_label as y, probability as p from e
 union all select 'cold_product', case when pp = 0 then 'true' else 'false' end, final_label, probability from e
 union all select 'user_frequency', case when pu = 0 then '0' when pu <= 2 then '1-2' when pu <= 9 then '3-9' else '10+' end, final_label, probability from e
 union all select 'product_frequency', case when pp = 0 then '0' when pp <= 2 then '1-2' when pp <= 9 then '3-9' else '10+' end, final_label, probability from e
 union all select 'product_price_bin', cast(pb as varchar), final_label, probability from e
 union all select 'device_type', 'd' || (user_id % 3), final_label, probability from e
 union all select 'click_day_block', (65 + (click_day - 15) // 5 * 5) || '-' || least(65 + (click_day - 15) // 5 * 5 + 4, 89), final_label, probability from e
 union all select 'positive_conversion_delay', case when dd < 1 then '[0,1)' when dd < 3 then '[1,3)' when dd < 7 then '[3,7)' when dd < 14 then '[7,14)' else '[14,30]' end, final_label, probability from e where final_label = 1),
g0 as (select dimension, value, count(*) as n, sum(y)::bigint as positives, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) as ll, avg((p - y) ** 2) as br from s group by 1, 2),
tie as (select dimension, value, p, sum(y) as pos, sum(1 - y) as neg from s group by 1, 2, 3),
cum as (select *, sum(pos) over w as tp, sum(neg) over w as fp from tie window w as (partition by dimension, value order by p desc rows unbounded preceding)),
rk as (select dimension, value, sum(pos * tp / (tp + fp)) / sum(pos) as pr, sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)) as roc from cum group by 1, 2 having sum(pos) > 0 and sum(neg) > 0),
bin as (select dimension, value, least(cast(floor(p * 10) as int), 9) as bin, count(*) as n, avg(p) as mp, avg(y) as rt from s group by 1, 2, 3),
ce as (select dimension, value, sum(n * abs(mp - rt)) / sum(n) as ece from bin group by 1, 2),
g as (select g0.*, rk.pr, rk.roc, ce.ece from g0 left join rk using (dimension, value) left join ce using (dimension, value)),
dec as (select * from (values {', '.join(f"('{k}', '{v}')" for k, vs in evaluation.DECLARED.items() for v in vs)}) t(dimension, value)),
f as (select coalesce(g.dimension, dec.dimension) as dimension, coalesce(g.value, dec.value) as value, coalesce(n, 0) as n, coalesce(positives, 0) as positives, ll, br, pr, roc, ece from g full outer join dec on g.dimension = dec.dimension and g.value = dec.value),
z as (select *, case when n = 0 then 'empty' when n < 50 then 'insufficient_examples' when positives < 10 then 'insufficient_positives' end as reason from f)
select dimension, value, n, positives, case when reason is null then round(ll, 6) end as log_loss, case when reason is null then round(br, 6) end as brier,
  case when reason is null then round(pr, 6) end as pr_auc, case when reason is null then round(roc, 6) end as roc_auc, case when reason is null then round(ece, 6) end as ece, reason from z""")
def slices(spark, sf_dir):
    return evaluation.slices(_examples(spark, sf_dir), 50, 10).withColumns({c: r6(c) for c in ("log_loss", "brier", "pr_auc", "roc_auc", "ece")})


@query("example_violations", "select 0::bigint as cold_user, 0::bigint as cold_product, 0::bigint as delay, 0::bigint as probability")
def example_violations(spark, sf_dir):
    return evaluation.example_violations(_examples(spark, sf_dir))


@query("planted_example_violations", f"""with {SCORES_SQL}, x as (select click_id, click_day, final_label, row_number() over (partition by user_id order by click_time, click_id) = 1 as cu,
  row_number() over (partition by product order by click_time, click_id) = 1 as cp from scored), e as (select * from x where click_day between 15 and 26)
select count(*) filter (click_id % 5 = 0) as cold_user, count(*) filter (not cp and click_id % 7 = 0) as cold_product, count(*) filter (final_label = 1 and click_id % 3 = 0) as delay,
  count(*) filter (click_id % 11 = 0 or click_id % 13 = 0) as probability from e""")
def planted_example_violations(spark, sf_dir):
    """Every fifth cold flag turned, some set, delays taken away, and probabilities above one or not a number."""
    at = lambda k: F.col("click_id") % k == 0
    e = _examples(spark, sf_dir).withColumns({
        "cold_user": F.when(at(5), ~F.col("cold_user")).otherwise(F.col("cold_user")), "cold_product": F.col("cold_product") | at(7),
        "conversion_delay_days": F.when(~at(3), F.col("conversion_delay_days")),
        "probability": F.when(at(11), F.lit(1.5)).when(at(13), F.lit(float("nan"))).otherwise(F.col("probability")),
    })
    return evaluation.example_violations(e)


@query("key_mismatch", f"with {CLICKS_SQL} select click_id, 'label' as missing from clicks where click_id not in (select o_orderkey from orders) union all select o_orderkey, 'prediction' from orders where o_orderkey not in (select click_id from clicks)")
def key_mismatch(spark, sf_dir):
    return evaluation.key_mismatch(click_log(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("click_id")))


@query("paired_difference", f"with {SCORES_SQL}, l as (select click_day, final_label as y, probability as p, other as o from scored) select click_day, count(*) as n, round(avg((o - y) ** 2 - (p - y) ** 2), 6) as difference from l group by 1")
def paired_difference(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("seed", F.lit(1))
    j = evaluation.paired(s, s.select("seed", "click_id", F.col("other").alias("probability")))
    y = F.col("final_label")
    return j.groupBy("click_day").agg(F.count("*").alias("n"), r6(F.avg((F.col("candidate") - y) ** 2 - (F.col("control") - y) ** 2)).alias("difference"))


_budget = "b as (select n_name as method, round((n_nationkey * 7 % 11) / 10.0, 1)::double as log_loss, (n_nationkey * 5 % 13)::bigint as total_examples from nation)"


def _methods(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("method"), F.round((k * 7 % 11) / 10, 1).alias("log_loss"), (k * 5 % 13).cast("long").alias("total_examples"))


@query("pareto", f"with {_budget} select * from b where not exists (select 1 from b o where o.log_loss <= b.log_loss and o.total_examples <= b.total_examples and (o.log_loss < b.log_loss or o.total_examples < b.total_examples) and o.method <> b.method)")
def pareto(spark, sf_dir):
    return evaluation.pareto(_methods(spark, sf_dir))


@query("budget_violations", "with t as (select n_name as method, f / 4.0 as fraction, case when n_nationkey % 5 = 0 and f = 3 then 0 else f * 100 end as examples from nation, range(1, 5) r(f) where not (n_nationkey % 7 = 0 and f = 2)), w as (select *, lag(examples) over (partition by method order by fraction) as b from t) select method, count(distinct fraction) as n_fractions, count(*) filter (examples <= b) as flat from w group by 1 having count(*) filter (examples <= b) > 0 or count(*) <> 4")
def budget_violations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("f", F.explode(F.sequence(F.lit(1), F.lit(4)))).where(~((F.col("n_nationkey") % 7 == 0) & (F.col("f") == 2)))
    examples = F.when((F.col("n_nationkey") % 5 == 0) & (F.col("f") == 3), 0).otherwise(F.col("f") * 100)
    d = evaluation.budget_violations(n.select(F.col("n_name").alias("method"), (F.col("f") / 4).alias("fraction"), examples.alias("examples")))
    return d.select("method", F.size("fractions").cast("long").alias("n_fractions"), "flat")


_hashw = """dr as (select i // p.per as replicate, i % p.per as k, p.per from range(0, 200 * 4) r(i), (select 4 as per) p),
hw as (select replicate, s + o as click_day, count(*) as weight from (select replicate, k, ('0x' || substr(md5(replicate || ':' || k), 1, 8))::bigint % 10 as s from dr) q, range(0, 3) x(o) where k * 3 + o < 12 group by 1, 2)"""


@query("bootstrap_logloss", f"""with {SCORES_SQL}, {_hashw}, ds as (select click_day - 15 as click_day, count(*) as n, sum(-(final_label * ln(probability) + (1 - final_label) * ln(1 - probability))) as ll, sum((probability - final_label) ** 2) as br from scored where click_day between 15 and 26 group by 1)
select cast(replicate as int) as replicate, round(sum(weight * ll) / sum(weight * n), 6) as log_loss, round(sum(weight * br) / sum(weight * n), 6) as brier from hw join ds using (click_day) group by 1""")
def bootstrap_logloss(spark, sf_dir):
    s = scores(spark, sf_dir).where("click_day between 15 and 26").withColumn("click_day", F.col("click_day") - 15)
    w = bootstrap.hashed_weights(spark, 12, 3, 200)
    return bootstrap.replicate_metrics(bootstrap.day_sums(s, []), w, []).withColumns({"log_loss": r6("log_loss"), "brier": r6("brier")})


@query("bootstrap_auc", f"""with {SCORES_SQL}, {_hashw}, g as (select replicate, probability as p, sum(final_label * weight) as pos, sum((1 - final_label) * weight) as neg from scored join hw on hw.click_day = scored.click_day - 15 where scored.click_day between 15 and 26 group by 1, 2),
c as (select *, sum(pos) over w as tp, sum(neg) over w as fp from g window w as (partition by replicate order by p desc rows unbounded preceding))
select cast(replicate as int) as replicate, round(sum(case when pos > 0 then pos * tp / (tp + fp) else 0 end) / sum(pos), 6) as pr_auc, round(sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)), 6) as roc_auc from c group by 1""")
def bootstrap_auc(spark, sf_dir):
    s = scores(spark, sf_dir).where("click_day between 15 and 26").withColumn("click_day", F.col("click_day") - 15)
    w = bootstrap.hashed_weights(spark, 12, 3, 200)
    return bootstrap.replicate_auc(s, w, []).select("replicate", r6("pr_auc").alias("pr_auc"), r6("roc_auc").alias("roc_auc"))


@query("bootstrap_interval", f"""with {SCORES_SQL}, {_hashw}, ds as (select click_day - 15 as click_day, count(*) as n, sum((probability - final_label) ** 2) as a, sum((other - final_label) ** 2) as b from scored where click_day between 15 and 26 group by 1),
r as (select replicate, sum(weight * b) / sum(weight * n) - sum(weight * a) / sum(weight * n) as d from hw join ds using (click_day) group by 1)
select count(*) as replicates, round(quantile_cont(d, 0.025), 6) as lower, round(quantile_cont(d, 0.975), 6) as upper from r""")
def bootstrap_interval(spark, sf_dir):
    s = scores(spark, sf_dir).where("click_day between 15 and 26").withColumn("click_day", F.col("click_day") - 15).withColumn("seed", F.lit(1))
    w = bootstrap.hashed_weights(spark, 12, 3, 200)
    reps = [bootstrap.replicate_metrics(bootstrap.day_sums(s, ["seed"], p), w, ["seed"]) for p in ("probability", "other")]
    return bootstrap.interval(*reps, "brier").withColumns({"lower": r6("lower"), "upper": r6("upper")})


# ---- losses and protocol -----------------------------------------------------------------------------

_z = "(l_quantity / 10 - 2.5) as z, (l_discount * 20 - 1) as q, cast(l_linenumber % 2 as int) as y, l_tax * 100 as d"
_sig = lambda z: f"1 / (1 + exp(-({z})))"
_sp = lambda z: f"ln(1 + exp({z}))"


def _loss_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_quantity") / 10 - 2.5).alias("z"), (F.col("l_discount") * 20 - 1).alias("q"), (F.col("l_linenumber") % 2).alias("y"), (F.col("l_tax") * 100).alias("d"))


@query("loss_dfm", f"with x as (select {_z} from lineitem), l as (select *, least(greatest({_sp('q')} + 1e-6, 1e-6), 100) as lam from x) select y, round(avg(case when y = 1 then {_sp('-z')} - ln(lam) + lam * d else -ln({_sig('-z')} + {_sig('z')} * exp(-lam * d)) end), 6) as loss from l group by y")
def loss_dfm(spark, sf_dir):
    x = _loss_rows(spark, sf_dir)
    return x.groupBy("y").agg(r6(F.avg(N.dfm_loss(F.col("z"), F.col("q"), F.col("y"), F.col("d")))).alias("loss"))


@query("loss_fnw", f"with x as (select {_z} from lineitem), w as (select *, case when y = 1 then 1 + {_sig('z')} else 1 - ({_sig('z')}) ** 2 end as w from x) select round(avg(w * ({_sp('z')} - y * z)), 6) as loss, round(avg(w), 6) as weight from w")
def loss_fnw(spark, sf_dir):
    x = _loss_rows(spark, sf_dir)
    w = N.fnw_weight(F.col("z"), F.col("y"))
    return x.agg(r6(F.avg(w * N.bce_with_logits(F.col("y"), F.col("z")))).alias("loss"), r6(F.avg(w)).alias("weight"))


@query("loss_esdfm", f"with x as (select {_z} from lineitem), w as (select *, least(greatest(case when y = 1 then 1 + {_sig('q')} else (1 + {_sig('q')}) * {_sig('z')} end, 1e-4), 2) as w from x) select round(avg(w * ({_sp('z')} - y * z)), 6) as loss, round(avg(w), 6) as weight from w")
def loss_esdfm(spark, sf_dir):
    x = _loss_rows(spark, sf_dir)
    w = N.esdfm_weight(F.col("y"), F.col("z"), F.col("q"))
    return x.agg(r6(F.avg(w * N.bce_with_logits(F.col("y"), F.col("z")))).alias("loss"), r6(F.avg(w)).alias("weight"))


@query("bce_weighted", f"with x as (select {_z} from lineitem) select round(sum(d * ({_sp('z')} - y * z)) / sum(d), 6) as loss from x")
def bce_weighted(spark, sf_dir):
    from latelens.operators.learners import weighted_bce

    return weighted_bce(_loss_rows(spark, sf_dir), F.col("z"), F.col("y"), F.col("d")).select(r6("loss").alias("loss"))


@query("bands", f"with {CLICKS_SQL}, p as (select row_number() over (partition by user_id order by click_time, click_id) - 1 as n from clicks) select case when n = 0 then '0' when n <= 2 then '1-2' when n <= 9 then '3-9' else '10+' end as band, count(*) as n from p group by 1")
def bands(spark, sf_dir):
    d = features.prior_counts(click_log(spark, sf_dir), {"user": "user_id"})
    return d.groupBy(N.frequency_band(F.col("prior_user_clicks")).alias("band")).agg(F.count("*").alias("n"))


_axes = {"learning_rate": [0.1, 0.01, 0.001], "dropout": [0.0, 0.1], "buckets": ["compact", "large"]}


@query("grid_complete", "select l::double as learning_rate, d::double as dropout, b as buckets, case when l = 0.1 then 'missing' else 'unexpected' end as difference from (values (0.1, 0.0, 'compact'), (0.5, 0.1, 'large')) t(l, d, b)")
def grid_complete(spark, sf_dir):
    e = protocol.grid(spark, _axes)
    got = e.where("not (learning_rate = 0.1 and dropout = 0.0 and buckets = 'compact')").unionByName(spark.createDataFrame([(0.5, 0.1, "large")], e.schema))
    return protocol.grid_difference(e, got)


STAGES = [("model", 36, 10), ("delayed", 8, 10), ("sampler", 6, 10), ("study_a", 21, 59), ("study_b", 12, 12), ("offline", 6, 0)]


@query("matrix_enumeration", f"select count(*) as stages, sum(r)::bigint as runs, sum(r) filter (c > 0)::bigint as online_runs, sum(r * c)::bigint as credits from (values {', '.join(f'({r}, {c})' for _, r, c in STAGES)}) t(r, c)")
def matrix_enumeration(spark, sf_dir):
    m = protocol.matrix(spark, STAGES)
    return m.agg(F.count("*").alias("stages"), F.sum("runs").alias("runs"), F.sum(F.when(F.col("credits_per_run") > 0, F.col("runs"))).alias("online_runs"), F.sum("credits").alias("credits"))


_cand = "c as (select p_type as stage, p_partkey as id, round(p_retailprice / 100, 0) as loss, p_size as compute_seconds, p_partkey % 7 as parameters, md5(p_name || p_partkey) as digest, case when p_partkey % 997 = 0 then 'infra_failure' when p_partkey % 11 = 0 then 'failed' else 'ok' end as status from part)"


@query("select_candidate", f"""with {_cand}, m as (select *, max(status = 'infra_failure') over (partition by stage) as blocked, min(loss) filter (status = 'ok') over (partition by stage) as least from c),
o as (select *, row_number() over (partition by stage order by compute_seconds, parameters, digest) as i from m where not blocked and status = 'ok' and loss <= least + 1e-6) select stage, id, loss, compute_seconds from o where i = 1""")
def select_candidate(spark, sf_dir):
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("stage"), k.alias("id"), F.round(F.col("p_retailprice") / 100, 0).alias("loss"), F.col("p_size").alias("compute_seconds"), (k % 7).alias("parameters"),
        F.md5(F.concat("p_name", k.cast("string"))).alias("digest"), F.when(k % 997 == 0, "infra_failure").when(k % 11 == 0, "failed").otherwise("ok").alias("status"),
    )
    return protocol.select_candidate(c).select("stage", "id", "loss", "compute_seconds")


@query("cap_projection", "select s::int as steps_per_credit, (s * 1883 * 0.5 + 100) * 1.5 as projected, (s * 1883 * 0.5 + 100) * 1.5 <= 90000 as fits from (values (10), (50), (100)) t(s)")
def cap_projection(spark, sf_dir):
    return protocol.cap_projection(spark.createDataFrame([(10,), (50,), (100,)], "steps_per_credit int"), 0.5, 100.0, 1883, 90_000.0)


@query("exposure_violations", "select l_orderkey % 50 as credit_id, l_linenumber as step, count(*) as n from lineitem group by 1, 2 having count(*) <> 200")
def exposure_violations(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("credit_id"), F.col("l_linenumber").alias("step"))
    return protocol.exposure_violations(e, 200)


@query("same_value", "select o_orderstatus, count(distinct o_orderpriority) as n from orders group by 1 having count(distinct o_orderpriority) > 1")
def same_value(spark, sf_dir):
    return evaluation.same_value(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderpriority"])


@query("mean_over_seeds", "select o_orderstatus, round(avg(o_totalprice), 4) as o_totalprice from orders group by 1")
def mean_over_seeds(spark, sf_dir):
    d = evaluation.mean_over_seeds(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_totalprice"])
    return d.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("ordered_digest", f"""with {CLICKS_SQL}, r as (select click_id, row_number() over (order by click_time, click_id) - 1 as i from clicks),
b as (select i // 10000 as b, sha256(string_agg(cast(click_id as varchar), '' order by i)) as h from r group by 1),
c as (select b // 10000 as b, sha256(string_agg(h, '' order by b)) as h from b group by 1)
select coalesce(max(h), sha256('')) as digest from c""")
def ordered_digest(spark, sf_dir):
    return protocol.ordered_digest(click_log(spark, sf_dir), ["click_time", "click_id"], "click_id")


@query("compute_fields", "select o_orderstatus, round(sum(o_totalprice), 2) as o_totalprice, max(o_custkey) as o_custkey from orders group by 1")
def compute_fields(spark, sf_dir):
    return protocol.compute_fields(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_totalprice"], ["o_custkey"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


# ---- stores, plans and learners ------------------------------------------------------------------------


@query("truth_checks", "select 0::bigint as wrong_label, 0::bigint as unknown_click, 0::bigint as unequal_time, 0::bigint as wrong_delay")
def truth_checks(spark, sf_dir):
    from latelens.operators import checks

    t = truth(spark, sf_dir)
    both = [checks.truth_part(p, t, 1 - i, MATURITY, 0.0) for i, p in enumerate(features.route_truth(t))]
    return protocol.union_all(both).agg(*[F.sum(c).alias(c) for c in both[0].columns])


@query("planted_truth_checks", f"""with {CLICKS_SQL} select count(*) filter (click_id % 5 = 0) as wrong_label, count(*) filter (click_id % 7 = 0) as unknown_click,
  count(*) filter (click_id % 3 = 0 and click_id % 7 <> 0) as unequal_time, count(*) filter (click_id % 11 = 0 and final_label = 0) + count(*) filter (click_id % 11 = 0 and final_label = 1) as wrong_delay from truth""")
def planted_truth_checks(spark, sf_dir):
    """Labels turned, clicks that features lack, times moved in the features, and truth far outside the window."""
    from latelens.operators import checks

    at = lambda k: F.col("click_id") % k == 0
    t = truth(spark, sf_dir)
    f = t.where(~at(7)).withColumn("click_time", F.col("click_time") + F.when(at(3), 1).otherwise(0))
    both = []
    for i, part in enumerate(features.route_truth(t)):
        part = part.withColumn("available_at", F.col("available_at") + F.when(at(11), 10 * MATURITY).otherwise(0))
        both.append(checks.truth_part(part.withColumn("final_label", F.when(at(5), i).otherwise(F.col("final_label"))), f, 1 - i, MATURITY, 0.0))
    return protocol.union_all(both).agg(*[F.sum(c).alias(c) for c in both[0].columns])


@query("planted_trace_audit", _trace + " select click_id, case when click_id % 5 = 0 then 2 when click_id % 7 = 0 then 0 else 1 end::bigint as n_predictions from truth where click_id % 5 = 0 or click_id % 7 = 0 or click_id % 11 = 0")
def planted_trace_audit(spark, sf_dir):
    """Some clicks predicted twice, some never, and some delivered before they are predicted."""
    t = truth(spark, sf_dir)
    e, at = eventtime.event_trace(t, TICK, origin(t)), lambda k: F.col("click_id") % k == 0
    twice = e.where((F.col("kind") == "predict") & at(5))
    early = (F.col("kind") == "deliver") & at(11)
    e = e.where(~((F.col("kind") == "predict") & at(7) & ~at(5))).withColumn("tick", F.when(early, F.col("tick") - 1).otherwise(F.col("tick")))
    return eventtime.audit(e.unionByName(twice))


@query("field_failures", REASONS_SQL + """ select * from (select unnest(['Sale', 'SalesAmountInEuro', 'time_delay_for_conversion', 'click_timestamp', 'nb_clicks_1week', 'product_price']) as field,
  unnest([count(*) filter (sale_n = -1), count(*) filter ((sale_n = 0 and a <> -1) or (sale_n = 1 and a < 0)), count(*) filter ((sale_n = 0 and d <> -1) or (sale_n = 1 and d < 0)),
  count(*) filter (isnan(t) or t <= 0), count(*) filter (k < -1), count(*) filter (pp is null or pp < -1)]) as n from v) where n > 0""")
def field_failures(spark, sf_dir):
    return ingest.field_histogram(_validated(spark, sf_dir), FIELDS)


@query("missing_days", f"with {CLICKS_SQL} select cast(d as int) as click_day from range(0, 41) r(d) where d not in (select click_day from truth)")
def missing_days(spark, sf_dir):
    from latelens.operators import checks

    return checks.missing_days(with_day(click_log(spark, sf_dir)), 0, 40)


@query("ledger_checks", f"with {CLICKS_SQL}, r as ({_fixed('fixed_wait')} union all select click_id, available_at, 'FINAL', 1.0, 'x' from truth where click_id % 5 = 0 union all select click_id, available_at, 'FINAL', 1.0, 'x' from truth where click_id % 10 = 0), g as (select click_id, kind, count(*) as n, max(available_at) as t from r group by 1, 2) select sum(n - 1)::bigint as repeated, count(*) filter (t > (select min(click_time) + {20 * DAY} from clicks)) as future from g")
def ledger_checks(spark, sf_dir):
    from latelens.operators import checks

    t = truth(spark, sf_dir)
    extra = strategies.mature_outcome(t)
    r = protocol.union_all([strategies.fixed_wait(t, WAIT), extra.where("click_id % 5 = 0"), extra.where("click_id % 10 = 0")])
    return checks.ledger(r, origin(t) + 20 * DAY)


@query("final_matrix", "select study, method, s::int as seed from (values ('a', 'complete_wait'), ('a', 'immediate_fake_negative'), ('a', 'fixed_wait'), ('a', 'dfm'), ('a', 'fnw'), ('a', 'es_dfm'), ('a', 'oracle_reference'), ('b', 'early'), ('b', 'midpoint'), ('b', 'deadline'), ('b', 'drift'), ('offline', 'logistic'), ('offline', 'boosted')) m(study, method), (values (17), (29), (43)) x(s)")
def final_matrix(spark, sf_dir):
    from latelens.plans.experiments import final_matrix as made

    return made(spark)


@query("training_budget", f"with {CLICKS_SQL}, r as ({_fixed('fixed_wait')}) select d::int as credit_id, count(*) as legal, (count(*) * 4)::bigint as examples from r, range(5, 10) x(d) where available_at <= (select min(click_time) from clicks) + d * {DAY} group by 1")
def training_budget(spark, sf_dir):
    t = truth(spark, sf_dir)
    start = origin(t)
    days = F.explode(F.sequence(F.greatest(F.lit(5), F.ceil((F.col("available_at") - start) / DAY).cast("int")), F.lit(9)))
    r = strategies.fixed_wait(t, WAIT).where(F.col("available_at") <= start + 9 * DAY)
    return r.select(days.alias("credit_id")).groupBy("credit_id").agg(F.count("*").alias("legal"), (F.count("*") * 4).alias("examples"))


@query("synthetic_predictions")
def synthetic_predictions(spark, sf_dir):
    from latelens.plans.simulate import synthetic

    return synthetic(spark)["predictions"]


@query("study_b_decisions")
def study_b_decisions(spark, sf_dir):
    from latelens.plans.simulate import study_b

    return protocol.union_all([d.select("window_id", "day", "spend", "reason").withColumn("policy", F.lit(p)) for p, d in study_b(spark).items()])


@query("logistic_reference")
def logistic_reference(spark, sf_dir):
    """A standardised logistic regression on mature clicks, scored on the later ones."""
    from latelens.operators import learners

    d = features.prior_counts(with_day(truth(spark, sf_dir)), {"user": "user_id", "product": "product"})
    d = d.withColumn("log_price", F.log1p("price")).withColumn("log_user", F.log1p("prior_user_clicks"))
    train, later = features.mature_split(d, origin(d) + 15 * DAY, MATURITY)
    model = learners.logistic_reference(train, ["log_price", "log_user"])
    return learners.scored(model, later).select("click_id", "final_label", "probability")
