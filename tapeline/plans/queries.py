"""Queries of the panel, its features, cross-sections, targets and metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions import exprs
from tapeline.operators import cross_section, features, metrics, panel, targets
from tapeline.plans.base import CFG, dealt_scores, joined_panel, kept, ranked, scores, steps, week_features, week_panel, weekly
from tapeline.plans.registry import query
from tapeline.sources import bars

G, P = "experiment_name:s model_name:s universe_group:s", "date:d experiment_name:s model_name:s universe_group:s"
GS, PS = "experiment_name, model_name, universe_group", "date, experiment_name, model_name, universe_group"


def _all(columns: str) -> str:
    return ", ".join(c.split(":")[0] for c in columns.split())


_BARS = "code:s date:d open:f high:f low:f close:f volume:f amount:f"


@query(_BARS, steps("bars", f"SELECT {_all(_BARS)} FROM bars"))
def bars_week(spark: SparkSession, sf: str) -> DataFrame:
    return weekly(spark, sf)


@query(_BARS, steps("bars", f"SELECT {_all(_BARS)} FROM bars").replace("'week'", "'month'"))
def bars_month(spark: SparkSession, sf: str) -> DataFrame:
    return bars.supplier_bars(spark, sf, "month")


@query("user_id:s hour:s open:f high:f low:f close:f n:i", "SELECT CAST(user_id AS VARCHAR) AS user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS hour, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS n FROM events GROUP BY ALL")
def bars_events_day(spark: SparkSession, sf: str) -> DataFrame:
    """The resampler over another tick table: daily bars of event values by user."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("hour", F.date_format("ts", "yyyy-MM-dd"))
    return bars.resample(e, ["user_id", "hour"], "value", ["ts", "event_id"], n=F.count("*"))


_PANEL = "date:d code:s name:s industry:s open_raw:f close_raw:f open_adj:f high_adj:f low_adj:f close_adj:f volume:f amount:f used_raw_as_adj:i is_st:i is_suspended:i is_tradable_basic:i days_since_list:f float_mktcap:f"


@query(_PANEL, steps("panel", f"SELECT {_all(_PANEL)} FROM panel"))
def panel_outer_join_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return joined_panel(spark, sf)


@query("k:i code:s num:f flag:i", """SELECT l_linenumber + l_orderkey * 10 AS k, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE floor(l_extendedprice) END AS num, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag FROM lineitem""")
def clean_types(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaning of dirty text that is made from lineitem: thousands commas, placeholders, prefixed codes, yes and no."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("k", F.col("l_linenumber") + F.col("l_orderkey") * 10)
    marks = F.element_at(F.array(*[F.lit(m) for m in ("--", "-", "", "nan", "None")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    dirty = line.select("k", F.concat(F.lit("sz."), F.col("l_suppkey").cast("string")).alias("代码"), F.when(F.col("l_orderkey") % 5 == 0, marks).otherwise(F.format_number(F.floor("l_extendedprice"), 0)).alias("成交额"), F.when(F.col("l_returnflag") == "R", "是").when(F.col("l_returnflag") == "A", "否").alias("ST"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("日期"))
    return panel.clean(dirty, {"k": "k", "代码": "code", "成交额": "num", "ST": "flag", "日期": "date"}, ["num"], ["flag"])


@query("date:d code:s n_rows:i", "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def qa_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    line = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.date_trunc("week", "l_shipdate").cast("date").alias("date"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("code"))
    return panel.duplicate_keys(line)


@query("n_rows:i n_codes:i min_date:d max_date:d", steps("panel", "SELECT count(*) AS n_rows, count(DISTINCT code) AS n_codes, min(date) AS min_date, max(date) AS max_date FROM panel"))
def build_stats(spark: SparkSession, sf: str) -> DataFrame:
    return panel.build_stats(week_panel(spark, sf))


_RET = "date:d code:s " + " ".join(f"ret_{n}d:f" for n in CFG.return_windows)


@query(_RET, steps("rets", f"SELECT {_all(_RET)} FROM rets"))
def ts_return_n(spark: SparkSession, sf: str) -> DataFrame:
    return features.returns(week_panel(spark, sf), CFG)


_LAB = "date:d code:s open_to_close_ret_1d:f future_ret_5d:f label_5d:f future_ret_20d:f label_20d:f"


@query(_LAB, steps("feat", f"SELECT {_all(_LAB)} FROM feat"))
def future_return_label(spark: SparkSession, sf: str) -> DataFrame:
    return features.labels(week_panel(spark, sf), CFG)


_CON = "date:d code:s limit_pct:f volume_mean_20d_prev:f volume_ratio_to_20d_prev:f is_low_volume_limit_up:i is_low_volume_limit_down:i"


@query(_CON, steps("feat", "SELECT *, volume / nullif(volume_mean_20d_prev, 0) AS volume_ratio_to_20d_prev FROM feat"))
def low_volume_limit_flags(spark: SparkSession, sf: str) -> DataFrame:
    return week_features(spark, sf)


def _full(agg: str, c: str, n: int) -> str:
    frame = f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} = {n} THEN {agg} {frame} END"


_MA = "date:d code:s " + " ".join(f"ma{n}_adj:f ma{n}_gap:f" for n in CFG.ma_windows)


@query(_MA, steps("feat", "SELECT *, " + ", ".join(f"close_adj / nullif(ma{n}_adj, 0) - 1 AS ma{n}_gap" for n in CFG.ma_windows) + " FROM (SELECT *, " + ", ".join(f"{_full('avg(close_adj)', 'close_adj', n)} AS ma{n}_adj" for n in CFG.ma_windows) + " FROM feat) AS x"))
def rolling_ma_gap(spark: SparkSession, sf: str) -> DataFrame:
    return week_features(spark, sf)


@query("date:d code:s position_5d:f position_20d:f position_60d:f", steps("feat", "SELECT date, code, " + ", ".join(f"(close_adj - lo{n}) / nullif(hi{n} - lo{n}, 0) AS position_{n}d" for n in (5, 20, 60)) + " FROM (SELECT *, " + ", ".join(f"{_full('min(low_adj)', 'low_adj', n)} AS lo{n}, {_full('max(high_adj)', 'high_adj', n)} AS hi{n}" for n in (5, 20, 60)) + " FROM feat) AS x"))
def rolling_position(spark: SparkSession, sf: str) -> DataFrame:
    return week_features(spark, sf)


@query("date:d code:s vol_20d:f vol_60d:f", steps("feat", f"SELECT date, code, {_full('stddev_samp(ret_1d)', 'ret_1d', 20)} AS vol_20d, {_full('stddev_samp(ret_1d)', 'ret_1d', 60)} AS vol_60d FROM feat"))
def rolling_vol(spark: SparkSession, sf: str) -> DataFrame:
    return week_features(spark, sf)


@query("date:d code:s amount_mean_20d:f amount_change_20d:f log_float_mktcap:f reversal_5d:f reversal_10d:f momentum_20d:f momentum_60d:f", steps("feat", f"SELECT *, amount / nullif(amount_mean_20d, 0) - 1 AS amount_change_20d, CASE WHEN float_mktcap > 0 THEN ln(float_mktcap) END AS log_float_mktcap FROM (SELECT *, {_full('avg(amount)', 'amount', 20)} AS amount_mean_20d FROM feat) AS x"))
def baseline_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return week_features(spark, sf)


@query("date:d code:s is_tradable:i", steps("feat", "SELECT date, code, is_tradable FROM feat"))
def tradable_flag(spark: SparkSession, sf: str) -> DataFrame:
    return week_features(spark, sf)


@query("date:d code:s label:f future_ret:f", steps("feat", f"SELECT date, code, label_5d AS label, future_ret_5d AS future_ret FROM (SELECT *, {_full('avg(close_adj)', 'close_adj', 20)} AS ma20_adj FROM feat) AS x WHERE is_tradable = 1 AND label_5d IS NOT NULL AND future_ret_5d IS NOT NULL AND ma20_adj IS NOT NULL"))
def training_sample_mask(spark: SparkSession, sf: str) -> DataFrame:
    return features.experiment_view(features.sample_mask(week_features(spark, sf), 5, ["ma20_adj"]), 5)


@query("bucket:i n_rows:i n_codes:i", steps("panel", "SELECT CAST(code AS BIGINT) % 128 AS bucket, count(*) AS n_rows, count(DISTINCT code) AS n_codes FROM panel GROUP BY ALL"))
def code_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return week_panel(spark, sf).groupBy(exprs.code_bucket(F.col("code")).alias("bucket")).agg(F.count("*").alias("n_rows"), F.countDistinct("code").alias("n_codes"))


@query(f"{P} code:s score:f", steps("univ", f"SELECT {PS}, code, score FROM univ"))
def universe_tercile(spark: SparkSession, sf: str) -> DataFrame:
    return cross_section.universes(dealt_scores(kept(week_features(spark, sf))))


@query(f"{P} code:s decile:i", steps("dec", f"SELECT {PS}, code, decile FROM dec"))
def decile_assign(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(kept(week_features(spark, sf)))


def _ic(spark: SparkSession, sf: str) -> DataFrame:
    return cross_section.ic_by_period(cross_section.universes(dealt_scores(kept(week_features(spark, sf)))))


@query(f"{P} num_stocks:i ic:f rankic:f", steps("ic", "SELECT * FROM ic"))
def ic_by_period(spark: SparkSession, sf: str) -> DataFrame:
    return _ic(spark, sf)


def _summary(c: str) -> str:
    return f"count({c}) AS n_{c}, avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, avg({c}) / nullif(stddev_samp({c}), 0) AS {c}ir, avg({c}) / nullif(stddev_samp({c}), 0) * sqrt(count({c})) AS {c}_t_stat, avg(CASE WHEN {c} IS NOT NULL THEN CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END END) AS {c}_positive_rate"


@query(f"{G} n_periods:i " + " ".join(f"n_{c}:i {c}_mean:f {c}_std:f {c}ir:f {c}_t_stat:f {c}_positive_rate:f" for c in ("ic", "rankic")), steps("ic", f"SELECT {GS}, count(*) AS n_periods, {_summary('ic')}, {_summary('rankic')} FROM ic GROUP BY {GS}"))
def ic_summary(spark: SparkSession, sf: str) -> DataFrame:
    return cross_section.ic_summary(_ic(spark, sf))


@query(f"{P} cumulative_ic:f cumulative_rankic:f", steps("ic", f"SELECT {PS}, sum(coalesce(ic, 0)) OVER w AS cumulative_ic, sum(coalesce(rankic, 0)) OVER w AS cumulative_rankic FROM ic WINDOW w AS (PARTITION BY {GS} ORDER BY date)"))
def cumulative_ic(spark: SparkSession, sf: str) -> DataFrame:
    return cross_section.cumulative_ic(_ic(spark, sf))


@query(f"{P} decile:i portfolio_name:s mean_future_ret:f median_future_ret:f avg_pred_prob:f num_stocks:i", steps("decret", "SELECT * FROM decret"))
def decile_returns(spark: SparkSession, sf: str) -> DataFrame:
    return cross_section.decile_returns(ranked(kept(week_features(spark, sf))))


@query(f"{G} decile:i portfolio_name:s n_periods:i mean_future_ret:f std_period_future_ret:f median_period_future_ret:f avg_pred_prob:f avg_num_stocks:f", steps("decsum", "SELECT * FROM decsum"))
def decile_summary(spark: SparkSession, sf: str) -> DataFrame:
    return cross_section.decile_summary(cross_section.decile_returns(ranked(kept(week_features(spark, sf)))))


@query(
    f"{G} valid_decile_count:i decile_return_spearman:f strict_monotonic_increasing:b nonstrict_monotonic_increasing:b adjacent_violation_count:i",
    steps("decsum", f"""SELECT {GS}, count(*) AS valid_decile_count, CASE WHEN count(*) >= 2 AND min(m) < max(m) THEN corr(a, b) END AS decile_return_spearman, CASE WHEN count(*) >= 2 THEN bool_and(m > prev) ELSE false END AS strict_monotonic_increasing,
        CASE WHEN count(*) >= 2 THEN bool_and(m >= prev) ELSE false END AS nonstrict_monotonic_increasing, CASE WHEN count(*) >= 2 THEN sum(CASE WHEN m < prev THEN 1 ELSE 0 END) END AS adjacent_violation_count
        FROM (SELECT {GS}, mean_future_ret AS m, lag(mean_future_ret) OVER (PARTITION BY {GS} ORDER BY decile) AS prev, rank() OVER (PARTITION BY {GS} ORDER BY decile) AS a, rank() OVER (PARTITION BY {GS} ORDER BY mean_future_ret) AS b FROM decsum WHERE mean_future_ret IS NOT NULL) AS x GROUP BY {GS}"""),
)
def decile_monotonicity(spark: SparkSession, sf: str) -> DataFrame:
    return cross_section.monotonicity(cross_section.decile_summary(cross_section.decile_returns(ranked(kept(week_features(spark, sf))))))


_SAMPLE = {"sample": "SELECT date, code, label_5d AS label, future_ret_5d AS future_ret, reversal_5d AS score FROM feat WHERE is_tradable = 1 AND label_5d IS NOT NULL AND future_ret_5d IS NOT NULL AND ret_20d IS NOT NULL"}


def _sample(spark: SparkSession, sf: str) -> DataFrame:
    return features.experiment_view(features.sample_mask(week_features(spark, sf), 5, ["ret_20d"]), 5)


@query("split:s n:i first:d last:d", steps("feat", """SELECT split, count(*) AS n, min(date) AS first, max(date) AS last FROM (SELECT date, CASE WHEN date <= DATE '1999-12-31' AND date < a THEN 'train' WHEN date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND date < b THEN 'valid' WHEN date >= DATE '2001-01-01' THEN 'test' END AS split
    FROM sample, (SELECT date AS a FROM (SELECT DISTINCT date FROM sample WHERE date < DATE '2000-01-01') AS d ORDER BY date DESC LIMIT 1 OFFSET 4) AS x, (SELECT date AS b FROM (SELECT DISTINCT date FROM sample WHERE date < DATE '2001-01-01') AS d ORDER BY date DESC LIMIT 1 OFFSET 4) AS y) AS s GROUP BY split""", _SAMPLE))
def purged_split(spark: SparkSession, sf: str) -> DataFrame:
    return targets.fixed_split(_sample(spark, sf), 5, CFG).groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


_CAL = {"cal": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM panel) AS d", "folds": "SELECT fold, min(date) AS fold_start, max(date) AS fold_end, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n_dates FROM (SELECT *, ntile(5) OVER (ORDER BY date) - 1 AS fold FROM cal WHERE date < DATE '2001-01-01') AS x GROUP BY fold"}


@query("fold:i fold_start:d fold_end:d start_pos:i end_pos:i n_dates:i", steps("panel", "SELECT * FROM folds", _CAL))
def kfold_ranges(spark: SparkSession, sf: str) -> DataFrame:
    cal = targets.calendar(week_panel(spark, sf))
    return targets.fold_ranges(cal.where(F.col("date") < F.lit(CFG.test_start)), CFG.folds)


@query("fold:i split:s n:i", steps("feat", """SELECT fold, CASE WHEN date >= DATE '2001-01-01' THEN 'test' WHEN pos BETWEEN start_pos AND end_pos THEN 'valid' WHEN pos BETWEEN start_pos - 20 AND end_pos + 20 THEN NULL ELSE 'train' END AS split, count(*) AS n FROM sample JOIN cal USING (date) CROSS JOIN folds GROUP BY 1, 2""", _CAL | _SAMPLE))
def purged_kfold(spark: SparkSession, sf: str) -> DataFrame:
    out = targets.purged_folds(_sample(spark, sf), targets.calendar(week_panel(spark, sf)), CFG)
    return out.groupBy("fold", "split").agg(F.count("*").alias("n"))


_WIN = {"clip": "SELECT *, greatest(least(future_ret, quantile_cont(future_ret, 0.99) OVER (PARTITION BY date)), quantile_cont(future_ret, 0.01) OVER (PARTITION BY date)) AS x FROM sample", "win": "SELECT *, coalesce((x - avg(x) OVER (PARTITION BY date)) / nullif(stddev_pop(x) OVER (PARTITION BY date), 0), 0) AS target FROM clip"}


@query("date:d code:s target:f", steps("feat", "SELECT date, code, target FROM win", _SAMPLE | _WIN))
def winsor_target(spark: SparkSession, sf: str) -> DataFrame:
    return targets.winsor_target(_sample(spark, sf))


@query("n_dates:i bce:f huber:f huber_ic:f", steps("feat", """SELECT count(*) AS n_dates, avg(bce) AS bce, avg(huber) AS huber, avg(huber + 1 - ic) AS huber_ic FROM (SELECT date, avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))) AS bce, avg(CASE WHEN abs(score - target) < 1 THEN 0.5 * (score - target) * (score - target) ELSE abs(score - target) - 0.5 END) AS huber,
    CASE WHEN var_pop(score) > 1e-8 AND var_pop(target) > 1e-8 THEN corr(score, target) ELSE 0 END AS ic FROM win GROUP BY date) AS d""", _SAMPLE | _WIN))
def objective_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.objective_metrics(targets.winsor_target(_sample(spark, sf)).withColumn("score", F.col("reversal_5d")), "score", "label", "target")


_MEM = {"mem": "SELECT date, code, model_name, score, 1 / (1 + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, score)))) AS probability, label, future_ret FROM pred", "zs": "SELECT *, (score - avg(score) OVER w) / CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN stddev_pop(score) OVER w END AS z FROM mem WINDOW w AS (PARTITION BY date, model_name)"}


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return scores(week_features(spark, sf)).withColumn("probability", exprs.clipped_sigmoid(F.col("score")))


@query("date:d code:s model_name:s z:f", steps("pred", "SELECT date, code, model_name, z FROM zs", _MEM))
def member_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return targets.member_zscore(_members(spark, sf), "score", ["date", "model_name"])


@query("date:d code:s pred_score:f pred_probability_mean:f ensemble_member_count:i", steps("pred", "SELECT date, code, avg(z) AS pred_score, avg(probability) AS pred_probability_mean, count(*) AS ensemble_member_count FROM zs GROUP BY date, code HAVING count(*) = 2", _MEM))
def ensemble_mean(spark: SparkSession, sf: str) -> DataFrame:
    return targets.ensemble(targets.member_zscore(_members(spark, sf), "score", ["date", "model_name"]), 2)


@query("model_name:s n:i auc:f accuracy:f brier:f", steps("pred", """SELECT model_name, count(*) AS n, (sum(r * label) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * sum(1 - label), 0) AS auc, avg(CASE WHEN (probability > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, avg((probability - label) * (probability - label)) AS brier
    FROM (SELECT *, rank() OVER (PARTITION BY model_name ORDER BY probability) + (count(*) OVER (PARTITION BY model_name, probability) - 1) / 2.0::DOUBLE AS r FROM mem WHERE label IS NOT NULL) AS x GROUP BY model_name""", _MEM))
def auc_acc_brier(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.binary_metrics(_members(spark, sf), ["model_name"])


@query("model_name:s n:i mean:f std:f p01:f p50:f p99:f positive_rate:f", steps("pred", "SELECT model_name, count(probability) AS n, avg(probability) AS mean, stddev_pop(probability) AS std, quantile_cont(probability, 0.01) AS p01, quantile_cont(probability, 0.5) AS p50, quantile_cont(probability, 0.99) AS p99, avg(CASE WHEN probability > 0.5 THEN 1.0 ELSE 0.0 END) AS positive_rate FROM mem GROUP BY model_name", _MEM))
def probability_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.probability_summary(_members(spark, sf), ["model_name"])


@query("n_dates:i ic_mean:f rankic_mean:f rankic_positive_rate:f decile_corr:f violations:i", steps("feat", """SELECT n_dates, ic_mean, rankic_mean, rankic_positive_rate, decile_corr, violations FROM
    (SELECT count(*) AS n_dates, avg(ic) AS ic_mean, avg(rankic) AS rankic_mean, avg(CASE WHEN rankic > 0 THEN 1.0 ELSE 0.0 END) AS rankic_positive_rate FROM (SELECT date, CASE WHEN min(score) < max(score) AND min(future_ret) < max(future_ret) THEN corr(score, future_ret) END AS ic, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS rankic FROM rk GROUP BY date) AS d) AS x,
    (SELECT corr(g, m) AS decile_corr, sum(CASE WHEN m < prev THEN 1 ELSE 0 END) AS violations FROM (SELECT g, m, lag(m) OVER (ORDER BY g) AS prev FROM (SELECT g, avg(future_ret) AS m FROM rk GROUP BY g) AS y) AS z) AS w""", _SAMPLE | {"rk": """SELECT *, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY date ORDER BY future_ret) + (count(*) OVER (PARTITION BY date, future_ret) - 1) / 2.0::DOUBLE AS b,
    greatest(1, least(10, ceil((row_number() OVER (PARTITION BY date ORDER BY score, code))::DOUBLE * 10 / n))) AS g FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM sample) AS s WHERE n >= 10"""}))
def signal_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.signal_metrics(_sample(spark, sf).withColumn("score", F.col("reversal_5d")))


@query("date:d n:i", steps("panel", "SELECT date, count(*) AS n FROM panel WHERE date IN (SELECT DISTINCT date FROM panel ORDER BY date DESC LIMIT 8) GROUP BY date"))
def edge_dates(spark: SparkSession, sf: str) -> DataFrame:
    return targets.edge_dates(week_panel(spark, sf), 8, last=True).groupBy("date").agg(F.count("*").alias("n"))


@query("year:i n_rows:i n_codes:i first:d last:d n_duplicate_keys:i", steps("panel", "SELECT year(date) AS year, sum(k) AS n_rows, count(DISTINCT code) AS n_codes, min(date) AS first, max(date) AS last, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS n_duplicate_keys FROM (SELECT date, code, count(*) AS k FROM panel GROUP BY ALL) AS x GROUP BY 1"))
def qa_year(spark: SparkSession, sf: str) -> DataFrame:
    from tapeline.operators import qa

    return qa.by_year(week_panel(spark, sf))


_W5 = "OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_IMAGE = {
    "avgd": f"SELECT *, CASE WHEN count(close_adj) {_W5} = 5 THEN avg(close_adj) {_W5} END AS m FROM feat",
    "wins": f"""SELECT * FROM (SELECT date, code, is_tradable, future_ret_5d, open_adj AS o, high_adj AS h, low_adj AS l, close_adj AS c, amount AS a, m, max(greatest(high_adj, m)) {_W5} AS p_max, min(least(low_adj, m)) {_W5} AS p_min, max(amount) {_W5} AS amount_max,
        sum(CASE WHEN open_adj IS NOT NULL AND high_adj IS NOT NULL AND low_adj IS NOT NULL AND close_adj IS NOT NULL AND amount IS NOT NULL AND m IS NOT NULL THEN 1 ELSE 0 END) {_W5} AS n_full, row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM avgd) AS x""",
    "valid": "SELECT date, code, k, p_min, p_max, amount_max FROM wins WHERE future_ret_5d IS NOT NULL AND is_tradable = 1 AND n_full = 5 AND p_max > p_min AND amount_max > 0",
    "px": "SELECT v.date, v.code, CAST(w.k - v.k + 4 AS INTEGER) AS i, v.amount_max, w.a, " + ", ".join(f"CAST(greatest(0, least(25, round_even((v.p_max - w.{c}) / (v.p_max - v.p_min) * 25, 0))) AS INTEGER) AS {c}" for c in "ohlcm") + " FROM valid AS v JOIN wins AS w ON w.code = v.code AND w.k BETWEEN v.k - 4 AND v.k",
    "lit": """SELECT date, code, i * 3 AS x, o AS y FROM px UNION ALL SELECT date, code, i * 3 + 2, c FROM px UNION ALL SELECT date, code, i * 3 + 1, unnest(range(h, l + 1)) FROM px
        UNION ALL SELECT date, code, i * 3 + j, 31 - unnest(range(0, CAST(round_even(a / amount_max * 5, 0) AS INTEGER) + 1)) FROM px, (SELECT unnest([0, 1, 2]) AS j) AS t
        UNION ALL SELECT date, code, CAST(round_even(i * 3 + 1 + s * (3.0::DOUBLE / n), 0) AS INTEGER), CAST(round_even(m + s * ((m2 - m)::DOUBLE / n), 0) AS INTEGER) FROM (SELECT *, greatest(3, abs(m2 - m)) AS n, unnest(range(0, greatest(3, abs(m2 - m)) + 1)) AS s FROM (SELECT p.*, q.m AS m2 FROM px AS p JOIN px AS q ON q.date = p.date AND q.code = p.code AND q.i = p.i + 1) AS z) AS y""",
}


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    from tapeline.operators import images

    return images.windows(week_features(spark, sf), 5, CFG)


@query("date:d code:s p_min:f p_max:f amount_max:f", steps("feat", "SELECT * FROM valid", _IMAGE))
def image_window_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf)


@query("date:d code:s n_pixels:i sum_x:i sum_y:i sum_xy:i", steps("feat", "SELECT date, code, count(*) AS n_pixels, sum(x) AS sum_x, sum(y) AS sum_y, sum(x * y) AS sum_xy FROM (SELECT DISTINCT date, code, x, y FROM lit) AS p GROUP BY date, code", _IMAGE))
def image_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Lit pixels of the images of window 5: their number and moments."""
    from tapeline.operators import images

    total = lambda f: F.aggregate("pixels", F.lit(0).cast("long"), lambda s, p: s + f(p))
    lit = images.pixels(_windows(spark, sf), 5, CFG)
    return lit.select("date", "code", F.size("pixels").alias("n_pixels"), total(lambda p: p["x"]).alias("sum_x"), total(lambda p: p["y"]).alias("sum_y"), total(lambda p: p["x"] * p["y"]).alias("sum_xy"))


@query("n_images:i n_wrong_size:i n_not_binary:i n_duplicate_keys:i n_unpaired_labels:i first:d last:d", steps("feat", "SELECT count(*) AS n_images, 0 AS n_wrong_size, 0 AS n_not_binary, 0 AS n_duplicate_keys, 0 AS n_unpaired_labels, min(date) AS first, max(date) AS last FROM valid", _IMAGE))
def image_qa(spark: SparkSession, sf: str) -> DataFrame:
    from tapeline.operators import images, qa

    return qa.images(images.drawn(_windows(spark, sf), 5, CFG), 32, 15, CFG.horizons_of_window(5))


#: Defects that the checks must find: keys twice, scores missing, a member short.
_DEFECTS = """SELECT experiment_name, model_name, CAST(sum(k) AS BIGINT) AS n_rows, count(DISTINCT date) AS n_dates, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicate_keys, CAST(sum(bad) AS BIGINT) AS n_missing_scores, min(lo) AS min_members, max(lo) AS max_members FROM
    (SELECT experiment_name, model_name, date, code, CASE WHEN code LIKE '%7' THEN 2 ELSE 1 END AS k, CASE WHEN code LIKE '%37' THEN 2 WHEN code LIKE '%3' THEN 1 ELSE 0 END AS bad, CASE WHEN code LIKE '%1' THEN 19 ELSE 20 END AS lo FROM pred) AS x GROUP BY ALL"""


@query("experiment_name:s model_name:s n_rows:i n_dates:i n_duplicate_keys:i n_missing_scores:i min_members:i max_members:i", steps("pred", _DEFECTS))
def prediction_qa(spark: SparkSession, sf: str) -> DataFrame:
    """The check of predictions over scores with made defects."""
    from tapeline.operators import qa

    df = dealt_scores(kept(week_features(spark, sf)))
    code = F.col("code")
    df = df.withColumn("ensemble_member_count", F.when(code.endswith("1"), 19).otherwise(20)).withColumn("twice", F.explode(F.when(code.endswith("7"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return qa.predictions(df.withColumn("score", F.when(code.endswith("37"), F.lit(float("inf"))).when(code.endswith("3"), F.lit(None)).otherwise(F.col("score"))))


@query("n_common:i n_sampled:i n_pixel_mismatch:i max_pixel_difference:i n_value_mismatch:i", steps("feat", """SELECT count(*) AS n_common, count(*) AS n_sampled, CAST(sum(CASE WHEN code LIKE '%5' THEN 2 ELSE 0 END) AS BIGINT) AS n_pixel_mismatch, max(CASE WHEN code LIKE '%5' THEN 7 ELSE 0 END) AS max_pixel_difference,
    CAST(sum(CASE WHEN code LIKE '%4' THEN 2 ELSE 0 END) AS BIGINT) AS n_value_mismatch FROM valid WHERE code NOT LIKE '%9'""", _IMAGE))
def image_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """All images against a copy with made defects: two pixels of some changed, values of others, some gone."""
    from tapeline.operators import images, qa
    from tapeline.sinks.stored import stored

    new = stored(images.drawn(_windows(spark, sf), 5, CFG))
    code, text = F.col("code"), F.hex("image")
    # byte 3 and the last one, which is lit in every image: seven more or less than they were
    near = lambda c: F.when(c == "00", F.lit("07")).otherwise(F.lit("F8"))
    changed = F.unhex(F.concat(F.substring(text, 1, 6), near(F.substring(text, 7, 2)), F.substring(text, 9, 2 * 32 * 15 - 10), near(F.substring(text, 2 * 32 * 15 - 1, 2))))
    old = new.where(~code.endswith("9")).withColumn("image", F.when(code.endswith("5"), changed).otherwise(F.col("image")))
    old = old.withColumns({c: F.when(code.endswith("4"), F.col(c) + 0.5).otherwise(F.col(c)) for c in ("label_5d", "future_ret_5d")})
    return qa.compare_images(new, old, 1_000_000_000, (5,))


@query("date:d code:s label:f pred_prob:f")
def logistic_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows scored by the logistic baseline, over those of its features that the panel has (iterative: no SQL)."""
    from tapeline.models.logistic import FEATURES, LogisticBaseline
    from tapeline.sinks.stored import stored

    sample = _sample(spark, sf)
    have = [c for c in FEATURES if c in sample.columns]
    sample = stored(sample.select("date", "code", "label", *have))  # once, and without the averages that the model doesn't take
    split = targets.fixed_split(sample, 5, CFG, stored(sample.select("date").distinct()))
    return LogisticBaseline(features=have).fit(split.where("split = 'train'")).transform(split.where("split = 'test'"))
