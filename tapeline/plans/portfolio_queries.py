"""Queries of both portfolio kinds. The SQL states the same sets with correlated lookups and range joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators import performance, portfolio
from tapeline.operators.cross_section import GROUP
from tapeline.plans.base import CFG, kept, ranked, rebalanced, steps, week_features
from tapeline.plans.registry import query
from tapeline.sinks.stored import stored

G, GS = "experiment_name:s model_name:s universe_group:s", "experiment_name, model_name, universe_group"
B = f"{GS}, decile"


def _book_steps(overlapping: bool) -> dict[str, str]:
    """SQL of daily rows, positions, the three books and their days."""
    end = "least(s.pos + s.horizon, l.last)" if overlapping else "s.pos + s.horizon"
    pick = "" if overlapping else "AND (s.pos - s.anchor) % s.horizon = 0 AND s.pos + s.horizon <= l.last"
    first_exit = (
        """CASE WHEN t_start = t_end THEN CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.code = p.code AND d.pos = t_end AND susp = 0 AND down = 0 AND o2c IS NOT NULL) THEN t_end
            ELSE (SELECT min(d.pos) FROM d WHERE d.code = p.code AND d.pos > t_end AND susp = 0 AND down = 0 AND ret IS NOT NULL) END
        ELSE (SELECT min(d.pos) FROM d WHERE d.code = p.code AND d.pos >= t_end AND susp = 0 AND down = 0 AND ret IS NOT NULL) END"""
        if overlapping
        else "(SELECT min(d.pos) FROM d WHERE d.code = p.code AND d.pos >= t_end AND susp = 0 AND down = 0 AND ret IS NOT NULL)"
    )
    out = {
        "daily": "SELECT date, code, ret_1d AS ret, open_to_close_ret_1d AS o2c, volume AS vol, is_suspended AS susp, is_low_volume_limit_up AS up, is_low_volume_limit_down AS down FROM feat",
        "cal": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM daily) AS x",
        "d": "SELECT pos, daily.* EXCLUDE (date) FROM daily JOIN cal USING (date)",
        "sig0": f"SELECT {GS}, horizon, decile, code, pos, min(pos) OVER (PARTITION BY {GS}) AS anchor FROM dec JOIN cal USING (date) WHERE decile IS NOT NULL",
        "sig": f"SELECT {GS}, horizon, decile, code, s.pos AS signal_pos, s.pos + 1 AS t_start, {end} AS t_end, l.last FROM sig0 AS s, (SELECT max(pos) AS last FROM cal) AS l WHERE s.pos + 1 <= {end} {pick}",
        "pos0": "SELECT sig.*, d.pos IS NOT NULL AND d.susp = 0 AND d.up = 0 AND d.o2c IS NOT NULL AND d.vol > 0 AS opens_ok, d.pos IS NULL OR d.o2c IS NULL AS unknown FROM sig LEFT JOIN d ON d.code = sig.code AND d.pos = t_start",
        "posn": f"SELECT *, {first_exit} AS t_exit FROM pos0 AS p",
    }
    for book, where, until, leaves in (("actual", "opens_ok", "least(coalesce(t_exit, last), last)", "t_exit"), ("ideal", "true", "t_end", "t_end"), ("constrained", "opens_ok", "t_end", "t_end")):
        day = f"PARTITION BY {B}, signal_pos, pos"
        if overlapping:
            w, w_end = f"(1.0::DOUBLE / horizon) / count(*) OVER ({day})", f"CASE WHEN stays = 1 THEN (1.0::DOUBLE / horizon) / sum(stays) OVER ({day}) ELSE 0 END"
        else:
            w, w_end = "base", "CASE WHEN stays = 1 THEN base ELSE 0 END"
        out[f"{book}_x"] = f"SELECT *, CASE WHEN {leaves} IS NULL OR {leaves} > pos THEN 1 ELSE 0 END AS stays FROM (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY {B}, signal_pos) AS base, unnest(range(t_start, {until} + 1)) AS pos FROM posn WHERE {where}) AS y"
        out[f"{book}_w"] = f"SELECT *, {w} AS w, {w_end} AS w_end FROM {book}_x"
        out[f"{book}_h"] = f"SELECT {B}, pos, code, sum(w) AS w, sum(w_end) AS w_end, max(CASE WHEN t_start = pos THEN 1 ELSE 0 END) AS opens, sum(CASE WHEN pos >= t_end AND stays = 1 THEN 1 ELSE 0 END) AS blocked, sum(CASE WHEN pos >= t_end AND t_start < pos THEN 1 ELSE 0 END) AS due, sum(CASE WHEN pos >= t_end AND t_start = pos THEN 1 ELSE 0 END) AS due_first FROM {book}_w GROUP BY {B}, pos, code"
        if not overlapping:
            out[f"{book}_h"] = out[f"{book}_h"].replace("AND t_start < pos", "AND t_start < pos").replace("t_start = pos THEN 1 ELSE 0 END) AS due_first", "t_start = pos THEN 1 ELSE 0 END) AS due_first")
        out[f"{book}_m"] = f"SELECT *, CASE WHEN r0 IS NULL AND susp = 1 THEN 0 ELSE r0 END AS r FROM (SELECT h.*, d.susp, d.ret, d.o2c, CASE WHEN opens = 1 THEN d.o2c ELSE d.ret END AS r0 FROM {book}_h AS h LEFT JOIN d USING (pos, code)) AS y"
        out[f"{book}_b"] = f"SELECT {B}, pos, sum(CASE WHEN r IS NOT NULL THEN w * r END) / nullif(sum(CASE WHEN r IS NOT NULL THEN w END), 0) AS ret, coalesce(sum(CASE WHEN r IS NOT NULL THEN w END), 0) AS valid, coalesce(sum(CASE WHEN r IS NULL THEN w END), 0) AS missing, sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) AS unk, count(*) AS n, sum(blocked) AS blocked, sum(CASE WHEN o2c IS NULL THEN due_first ELSE 0 END + CASE WHEN ret IS NULL THEN due ELSE 0 END) AS due_unk FROM {book}_m GROUP BY {B}, pos"
    out |= {
        "cohorts": f"SELECT {B}, pos, count(DISTINCT signal_pos) AS cohorts FROM actual_x GROUP BY {B}, pos",
        "closing": f"SELECT {B}, pos, sum(abs(w_end - w)) AS end_turnover FROM actual_h GROUP BY {B}, pos",
        "opening": f"SELECT {B}, pos, sum(abs(x)) AS start_turnover FROM (SELECT {B}, pos, code, sum(x) AS x FROM (SELECT {B}, pos, code, w AS x FROM actual_h UNION ALL SELECT {B}, pos + 1, code, -w_end FROM actual_h WHERE w_end <> 0) AS y GROUP BY {B}, pos, code) AS z GROUP BY {B}, pos",
        "buys": f"SELECT {B}, t_start AS pos, sum(CASE WHEN opens_ok THEN 0 ELSE 1 END) AS blocked_buys, sum(CASE WHEN unknown THEN 1 ELSE 0 END) AS unk_buys FROM posn GROUP BY {B}, t_start",
        "firsts": f"SELECT {GS}, min(t_start) AS first, max(horizon) AS h FROM sig GROUP BY {GS}",
    }
    loss = "coalesce({0}, 0) - coalesce({1}, 0)" if overlapping else "{0} - {1}"
    a, i, c = "CASE WHEN a.n IS NULL THEN 0 ELSE a.ret END", "CASE WHEN i.n IS NULL THEN 0 ELSE i.ret END", "CASE WHEN c.n IS NULL THEN 0 ELSE c.ret END"
    out["days"] = f"""SELECT cal.date, pos, {B}, 'D' || decile AS portfolio_name, {a} AS gross_return, coalesce(start_turnover, 0) + coalesce(end_turnover, 0) AS turnover, coalesce(start_turnover, 0) AS start_turnover, coalesce(end_turnover, 0) AS end_turnover,
        coalesce(cohorts, 0) AS active_cohorts, coalesce(a.n, 0) AS num_holdings, coalesce(blocked_buys, 0) AS num_blocked_buys, coalesce(a.blocked, 0) AS num_blocked_sells, coalesce(a.blocked, 0) AS num_forced_holds, coalesce(a.unk, 0) + coalesce(unk_buys, 0) + coalesce(a.due_unk, 0) AS num_data_missing_returns,
        coalesce(a.valid, 0) AS valid_weight, coalesce(a.missing, 0) AS missing_weight, coalesce(i.valid, 0) AS signal_valid_weight, coalesce(i.missing, 0) AS signal_missing_weight, {i} AS signal_gross_alpha, {c} AS buy_constrained_gross_return, {loss.format(i, c)} AS buy_blocked_loss, {loss.format(c, a)} AS sell_blocked_forced_hold_loss,
        {"pos - first + 1 < h" if overlapping else "false"} AS is_warmup
        FROM ideal_b AS i FULL JOIN actual_b AS a USING ({B}, pos) LEFT JOIN constrained_b AS c USING ({B}, pos) LEFT JOIN closing USING ({B}, pos) LEFT JOIN opening USING ({B}, pos) LEFT JOIN cohorts USING ({B}, pos) LEFT JOIN buys USING ({B}, pos) JOIN firsts USING ({GS}) JOIN cal USING (pos)"""
    known = "coalesce(signal_gross_alpha, 0) - coalesce(buy_blocked_loss, 0) - coalesce(sell_blocked_forced_hold_loss, 0)"
    out["costs0"] = "SELECT *, turnover * (cost_bps / 10000.0::DOUBLE) AS turnover_cost, gross_return - turnover * (cost_bps / 10000.0::DOUBLE) AS net_return FROM days CROSS JOIN (SELECT unnest([0.0::DOUBLE, 10.0, 25.0, 50.0, 100.0]) AS cost_bps) AS k"
    out["costs"] = f"SELECT *, {known} - coalesce(turnover_cost, 0) - coalesce(net_return, 0) AS missing_return_data_issue, {known} - ({known} - coalesce(turnover_cost, 0) - coalesce(net_return, 0)) - coalesce(turnover_cost, 0) AS attributed_net_return FROM costs0"
    return out


_DAY = f"date:d {G} decile:i portfolio_name:s gross_return:f turnover:f start_turnover:f end_turnover:f active_cohorts:i num_holdings:i num_blocked_buys:i num_blocked_sells:i num_forced_holds:i num_data_missing_returns:i valid_weight:f missing_weight:f signal_valid_weight:f signal_missing_weight:f signal_gross_alpha:f buy_constrained_gross_return:f buy_blocked_loss:f sell_blocked_forced_hold_loss:f is_warmup:b"
_O, _N = _book_steps(True), _book_steps(False)
_S = f"{GS}, decile, portfolio_name, cost_bps"
_SC = f"{G} decile:i portfolio_name:s cost_bps:f"


def _days(spark: SparkSession, sf: str, overlapping: bool) -> DataFrame:
    f = kept(week_features(spark, sf))
    return portfolio.portfolio_days(ranked(f, ["date", "code", "horizon", *GROUP[:2]]), f, CFG, overlapping)


@query(_DAY, steps("dec", "SELECT * FROM days", _O))
def overlap_portfolio_days(spark: SparkSession, sf: str) -> DataFrame:
    return _days(spark, sf, True)


@query(_DAY, steps("dec", "SELECT * FROM days", _N))
def nonoverlap_portfolio_days(spark: SparkSession, sf: str) -> DataFrame:
    return _days(spark, sf, False)


_COST = f"date:d {_SC} gross_return:f net_return:f turnover_cost:f missing_return_data_issue:f attributed_net_return:f"


@query(_COST, steps("dec", "SELECT * FROM costs", _O))
def cost_grid(spark: SparkSession, sf: str) -> DataFrame:
    return performance.with_costs(_days(spark, sf, True), CFG)


_LS = f"date:d {G} cost_bps:f gross_return:f net_return:f turnover:f turnover_cost:f valid_weight:f is_warmup:b"


_SPREAD = {
    "sides": f"""SELECT date, {GS}, max(CASE WHEN decile = 10 THEN gross_return END) - max(CASE WHEN decile = 1 THEN gross_return END) AS gross_return, sum(turnover) AS turnover, min(valid_weight) AS valid_weight, bool_or(is_warmup) AS is_warmup FROM days WHERE decile IN (1, 10) GROUP BY date, {GS} HAVING count(*) = 2""",
    "spread": "SELECT *, turnover * (cost_bps / 10000.0::DOUBLE) AS turnover_cost, gross_return - turnover * (cost_bps / 10000.0::DOUBLE) AS net_return FROM sides CROSS JOIN (SELECT unnest([0.0::DOUBLE, 10.0, 25.0, 50.0, 100.0]) AS cost_bps) AS k",
}


@query(_LS, steps("dec", "SELECT * FROM spread", {k: v for k, v in _O.items() if not k.startswith("costs")} | _SPREAD))
def long_short_spread(spark: SparkSession, sf: str) -> DataFrame:
    return performance.long_short(performance.with_costs(_days(spark, sf, True), CFG))


_NAV = {"navs": f"SELECT date, {_S}, product(1 + gross_return) OVER w AS gross_nav, product(1 + net_return) OVER w AS net_nav FROM costs WHERE NOT is_warmup AND gross_return IS NOT NULL AND net_return IS NOT NULL WINDOW w AS (PARTITION BY {_S} ORDER BY date)"}


@query(f"date:d {_SC} log_gross_nav:f log_net_nav:f drawdown:f", steps("dec", f"SELECT *, CASE WHEN gross_nav > 0 THEN ln(gross_nav) END AS log_gross_nav, CASE WHEN net_nav > 0 THEN ln(net_nav) END AS log_net_nav, net_nav / nullif(max(net_nav) OVER (PARTITION BY {_S} ORDER BY date), 0) - 1 AS drawdown FROM navs WHERE cost_bps = 10", _O | _NAV))
def nav_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    """The test data's prices make values of many digits, so their logarithms are returned."""
    return _log_navs(performance.nav(performance.with_costs(_days(spark, sf, True), CFG)).where("cost_bps = 10"), "gross_nav", "net_nav")


def _log_navs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({f"log_{c}": F.when(F.col(c) > 0, F.ln(c)) for c in columns})


_PERF = f"{_SC} n_periods:i n_total_days:i n_warmup_days:i annualized_return:f annualized_volatility:f sharpe:f max_drawdown:f win_rate:f avg_turnover:f valid_day_ratio:f avg_valid_weight:f low_coverage_day_ratio:f log_final_gross_nav:f log_final_net_nav:f"


def _performance(source: str) -> str:
    return f"""SELECT p.*, dd.max_drawdown, CASE WHEN final_gross_nav > 0 THEN ln(final_gross_nav) END AS log_final_gross_nav, CASE WHEN final_net_nav > 0 THEN ln(final_net_nav) END AS log_final_net_nav FROM (SELECT {_S}, count(net_return) FILTER (NOT is_warmup) AS n_periods, count(*) AS n_total_days, sum(CASE WHEN is_warmup THEN 1 ELSE 0 END) AS n_warmup_days, avg(net_return) FILTER (NOT is_warmup) * 252 AS annualized_return, stddev_samp(net_return) FILTER (NOT is_warmup) * sqrt(252) AS annualized_volatility,
        avg(net_return) FILTER (NOT is_warmup) * 252 / nullif(stddev_samp(net_return) FILTER (NOT is_warmup) * sqrt(252), 0) AS sharpe, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (NOT is_warmup AND net_return IS NOT NULL) AS win_rate, avg(turnover) FILTER (NOT is_warmup) AS avg_turnover, avg(CASE WHEN net_return IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (NOT is_warmup) AS valid_day_ratio,
        avg(valid_weight) FILTER (NOT is_warmup) AS avg_valid_weight, avg(CASE WHEN round(valid_weight, 12) < 0.95 THEN 1.0 ELSE 0.0 END) FILTER (NOT is_warmup) AS low_coverage_day_ratio FROM {source} GROUP BY {_S}) AS p
        JOIN (SELECT {_S}, min(x) AS max_drawdown FROM (SELECT {_S}, n / nullif(max(n) OVER (PARTITION BY {_S} ORDER BY date), 0) - 1 AS x FROM (SELECT {_S}, date, product(1 + net_return) OVER (PARTITION BY {_S} ORDER BY date) AS n FROM {source} WHERE NOT is_warmup AND net_return IS NOT NULL) AS y) AS z GROUP BY {_S}) AS dd USING ({_S})
        JOIN (SELECT {_S}, product(1 + gross_return) AS final_gross_nav FROM {source} WHERE NOT is_warmup AND gross_return IS NOT NULL GROUP BY {_S}) AS fg USING ({_S}) JOIN (SELECT {_S}, product(1 + net_return) AS final_net_nav FROM {source} WHERE NOT is_warmup AND net_return IS NOT NULL GROUP BY {_S}) AS fn USING ({_S}) WHERE n_periods > 0"""


@query(_PERF, steps("dec", _performance("costs"), _O))
def performance_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _log_navs(performance.performance(performance.with_costs(_days(spark, sf, True), CFG), CFG), "final_gross_nav", "final_net_nav")


@query(f"{_SC} n_periods:i annualized_return:f sharpe:f avg_turnover:f log_final_net_nav:f", steps("dec", f"SELECT * FROM ({_performance('costs')}) AS q WHERE decile = 10", _N))
def nonoverlap_performance_d10(spark: SparkSession, sf: str) -> DataFrame:
    """Cost sensitivity of the non-overlapping top decile."""
    return _log_navs(performance.long_only(performance.cost_sensitivity(performance.performance(performance.with_costs(_days(spark, sf, False), CFG), CFG))), "final_net_nav")


_ATT = " ".join(f"mean_daily_{c}:f cumulative_linear_{c}:f" for c in performance.COMPONENTS)


@query(f"{_SC} n_periods:i {_ATT} annualized_attribution_residual:f", steps("dec", f"SELECT {_S}, count(net_return) AS n_periods, " + ", ".join(f"avg({c}) AS mean_daily_{c}, sum({c}) AS cumulative_linear_{c}" for c in performance.COMPONENTS) + f", avg(net_return) * 252 - avg(attributed_net_return) * 252 AS annualized_attribution_residual FROM costs WHERE NOT is_warmup GROUP BY {_S}", _O))
def return_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return performance.attribution(performance.with_costs(_days(spark, sf, True), CFG), CFG)


def _held(spark: SparkSession, sf: str, together: bool = False) -> DataFrame:
    """Holdings of both models; ``together``: from the first day on that both have scores for, as books of different first days don't rebalance together."""
    f = kept(week_features(spark, sf).drop("ret_1d"))  # books are opened, not held
    cal = portfolio.trading_days(f)
    return portfolio.holdings(rebalanced(f, cal, together), f, cal=cal)


def _hold_steps(compared: bool = False) -> dict[str, str]:
    ok = "d.pos IS NOT NULL AND d.susp = 0 AND d.{0} = 0 AND d.o2c IS NOT NULL AND d.vol > 0"
    keys = f"{GS}, horizon, signal_pos, t_start, t_end"
    legs = {f"{n}_leg": f"SELECT {keys}, list_sort(list(DISTINCT code)) AS codes FROM (SELECT sig.* FROM sig JOIN d ON d.code = sig.code AND d.pos = t_start WHERE decile = {k} AND {ok.format(b)}) AS x GROUP BY {keys}" for n, k, b in (("long", 10, "up"), ("short", 1, "down"))}
    one = "SELECT c.*, '{0}' AS portfolio_name, '{1}' AS leg, coalesce(codes, []) AS codes FROM cycles AS c LEFT JOIN {1}_leg USING (" + keys + ")"
    since = {"sig0": _N["sig0"] + " AND date >= (SELECT min(date) FROM (SELECT universe_group AS u, date FROM dec WHERE decile IS NOT NULL GROUP BY ALL HAVING count(DISTINCT model_name) = 2) AS f WHERE u = universe_group)"} if compared else {}
    return _N | since | {"cycles": f"SELECT DISTINCT {keys} FROM sig"} | legs | {"held0": " UNION ALL ".join(one.format(p, s) for p, s in (("D10", "long"), ("D10_minus_D1", "long"), ("D10_minus_D1", "short"))), "held": "SELECT s.date AS signal_date, r.date AS rebalance_date, t.date AS target_end_date, h.* FROM held0 AS h JOIN cal AS s ON s.pos = signal_pos JOIN cal AS r ON r.pos = t_start JOIN cal AS t ON t.pos = t_end"}


@query(f"signal_date:d rebalance_date:d target_end_date:d horizon:i {G} portfolio_name:s leg:s n_holdings:i code_list:s", steps("dec", "SELECT *, len(codes) AS n_holdings, array_to_string(codes, '|') AS code_list FROM held", _hold_steps()))
def holdings(spark: SparkSession, sf: str) -> DataFrame:
    return _held(spark, sf).withColumn("code_list", F.array_join("codes", "|"))


_K = "experiment_name, universe_group, portfolio_name, leg"
_JAC = {"jac": f"SELECT {_K}, rebalance_date, len(a.codes) AS logistic_n, len(b.codes) AS cnn_n, len(list_intersect(a.codes, b.codes)) AS intersection_n, len(list_distinct(list_concat(a.codes, b.codes))) AS union_n, array_to_string(list_sort(list_intersect(a.codes, b.codes)), '|') AS intersection_codes FROM (SELECT * FROM held WHERE model_name LIKE '%logistic%') AS a JOIN (SELECT * FROM held WHERE model_name LIKE '%cnn%') AS b USING ({_K}, rebalance_date)", "jacs": "SELECT *, intersection_n / nullif(union_n, 0)::DOUBLE AS jaccard_overlap FROM jac"}


@query("experiment_name:s universe_group:s portfolio_name:s leg:s rebalance_date:d logistic_n:i cnn_n:i intersection_n:i union_n:i jaccard_overlap:f intersection_codes:s", steps("dec", "SELECT * FROM jacs", _hold_steps(True) | _JAC))
def holding_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.holding_overlap(_held(spark, sf, True))


@query("experiment_name:s universe_group:s portfolio_name:s leg:s n_rebalances:i jaccard_mean:f jaccard_median:f jaccard_p25:f jaccard_p75:f avg_intersection_n:f avg_logistic_n:f avg_cnn_n:f", steps("dec", f"SELECT {_K}, count(*) AS n_rebalances, avg(jaccard_overlap) AS jaccard_mean, median(jaccard_overlap) AS jaccard_median, quantile_cont(jaccard_overlap, 0.25) AS jaccard_p25, quantile_cont(jaccard_overlap, 0.75) AS jaccard_p75, avg(intersection_n) AS avg_intersection_n, avg(logistic_n) AS avg_logistic_n, avg(cnn_n) AS avg_cnn_n FROM jacs GROUP BY {_K}", _hold_steps(True) | _JAC))
def overlap_summary(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.overlap_summary(portfolio.holding_overlap(_held(spark, sf, True)))


def _net_steps() -> dict[str, str]:
    """The non-overlapping books of the top decile, and of the bottom one as it is sold: blocked by falls on opening, by rises on closing."""
    sold = {k: v.replace("susp = 0 AND down = 0", "susp = 0 AND up = 0").replace("d.up = 0 AND d.o2c", "d.down = 0 AND d.o2c") for k, v in _N.items()}
    books = ("actual", "ideal", "constrained")
    names = ["pos0", "posn", *[f"{b}_{x}" for b in books for x in "xwhmb"], "buys"]
    out = {k: _N[k] for k in ("daily", "cal", "d", "sig0", "sig")}
    for leg, steps_of, decile in (("long", _N, 10), ("short", sold, 1)):
        for k in names:
            sql = steps_of[k].replace("FROM sig ", f"FROM (SELECT * FROM sig WHERE decile = {decile}) AS sig ")
            for other in names:
                sql = re.sub(rf"FROM {other}\b", f"FROM {leg}_{other}", sql)
            out[f"{leg}_{k}"] = sql
    key = f"{GS}, pos"
    count = lambda c: " + ".join(f"coalesce({x}, 0)" for x in c)
    out["net"] = f"SELECT {key}, code, sum(w) AS w, sum(w_end) AS w_end FROM (SELECT {key}, code, w, w_end FROM long_actual_h UNION ALL SELECT {key}, code, -w, -w_end FROM short_actual_h) AS u GROUP BY {key}, code"
    out["net_closing"] = f"SELECT {key}, count(*) AS num_holdings, sum(abs(w_end - w)) AS end_turnover FROM net GROUP BY {key}"
    out["net_opening"] = f"SELECT {key}, sum(abs(x)) AS start_turnover FROM (SELECT {key}, code, sum(x) AS x FROM (SELECT {key}, code, w AS x FROM net UNION ALL SELECT {GS}, pos + 1, code, -w_end FROM net WHERE w_end <> 0) AS y GROUP BY {key}, code) AS z GROUP BY {key}"
    for leg in ("long", "short"):
        parts = " ".join(f"LEFT JOIN (SELECT {key}, ret AS {b}_ret, valid AS {b}_valid, missing AS {b}_missing, unk AS {b}_unk, blocked AS {b}_blocked, due_unk AS {b}_due_unk FROM {leg}_{b}_b) AS {b} USING ({key})" for b in books)
        out[f"{leg}_side"] = f"SELECT k.*, {', '.join(f'{b}_{c} AS {leg}_{b}_{c}' for b in books for c in ('ret', 'valid', 'missing', 'unk', 'blocked', 'due_unk'))}, blocked_buys AS {leg}_blocked_buys, unk_buys AS {leg}_unk_buys FROM (SELECT {key}, num_holdings FROM net_closing) AS k {parts} LEFT JOIN (SELECT {key}, blocked_buys, unk_buys FROM {leg}_buys) AS o USING ({key})"
    spread = {b: f"CASE WHEN coalesce(long_{b}_valid, 0) > 0 AND coalesce(short_{b}_valid, 0) > 0 THEN long_{b}_ret - short_{b}_ret END" for b in books}
    both = lambda *c: count([f"{leg}_{x}" for leg in ("long", "short") for x in c])
    out["net_days"] = f"""SELECT cal.date, {GS}, 0 AS decile, 'D10_minus_D1' AS portfolio_name, num_holdings, {spread["actual"]} AS gross_return, coalesce(start_turnover, 0) + coalesce(end_turnover, 0) AS turnover, coalesce(start_turnover, 0) AS start_turnover, coalesce(end_turnover, 0) AS end_turnover,
        {both("blocked_buys")} AS num_blocked_buys, {both("actual_blocked")} AS num_blocked_sells, {both("actual_unk", "unk_buys", "actual_due_unk")} AS num_data_missing_returns, least(coalesce(long_actual_valid, 0), coalesce(short_actual_valid, 0)) AS valid_weight,
        {spread["ideal"]} AS signal_gross_alpha, {spread["constrained"]} AS buy_constrained_gross_return, ({spread["ideal"]}) - ({spread["constrained"]}) AS buy_blocked_loss, ({spread["constrained"]}) - ({spread["actual"]}) AS sell_blocked_forced_hold_loss
        FROM long_side JOIN short_side USING ({key}, num_holdings) JOIN net_closing USING ({key}, num_holdings) LEFT JOIN net_opening USING ({key}) JOIN cal USING (pos)"""
    return out


_NET = f"date:d {G} decile:i portfolio_name:s gross_return:f turnover:f start_turnover:f end_turnover:f num_holdings:i num_blocked_buys:i num_blocked_sells:i num_data_missing_returns:i valid_weight:f signal_gross_alpha:f buy_constrained_gross_return:f buy_blocked_loss:f sell_blocked_forced_hold_loss:f"


@query(_NET, steps("dec", "SELECT * FROM net_days", _net_steps()))
def nonoverlap_long_short(spark: SparkSession, sf: str) -> DataFrame:
    f = kept(week_features(spark, sf))
    return portfolio.long_short_days(ranked(f), f)


_REBUILT = {
    "asked": "SELECT DISTINCT date, code, horizon, future_ret FROM dec",
    "rebuilt": """SELECT a.date, a.code, a.horizon, a.future_ret, product(1 + CASE WHEN d.pos = cal.pos + 1 THEN d.o2c ELSE d.ret END) - 1 AS x, count(CASE WHEN d.pos = cal.pos + 1 THEN d.o2c ELSE d.ret END) AS n
        FROM asked AS a JOIN cal USING (date) JOIN d ON d.code = a.code AND d.pos BETWEEN cal.pos + 1 AND cal.pos + a.horizon GROUP BY ALL""",
}


@query("n_rows:i max_difference:f", steps("dec", "SELECT count(*) AS n_rows, max(abs(x - future_ret)) AS max_difference FROM rebuilt WHERE n = horizon", {k: _O[k] for k in ("daily", "cal", "d")} | _REBUILT))
def compounding_check(spark: SparkSession, sf: str) -> DataFrame:
    f = kept(week_features(spark, sf))
    return portfolio.compounding_check(ranked(f), f)
