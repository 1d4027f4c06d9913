"""Window, split, scaler and persistence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewise.functions.scalars import one_row, r6 as R
from zonewise.operators import evaluate, scale, windows
from zonewise.plans.registry import query, r6
from zonewise.plans.sqltext import PANEL_DAILY, PANEL_HOLES, PANEL_REGION
from zonewise.sources.tables import panel_daily, panel_holes, panel_region

L, H = 7, 7


def rounded(df):
    return df.select(*[R(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def zones_of(panel):
    return panel.select("zone").distinct()


def daily_set(spark, sf):
    panel = panel_daily(spark, sf)
    win = windows.build_windows(panel, zones_of(panel), L, H)
    return panel, win, windows.lookback_arrays(panel, win, L)


def window_sql(panel: str, lookback: int = L, horizon: int = H, stride: int = 1) -> str:
    """CTEs: p (panel), nz, cal, dd (day completeness), ori (candidate origins), win (valid windows)."""
    return f"""p AS ({panel}), nz AS (SELECT count(DISTINCT zone) AS nz FROM p),
 cal AS (SELECT unnest(generate_series((SELECT min(date) FROM p), (SELECT max(date) FROM p), INTERVAL 1 DAY))::DATE AS date),
 dd AS (SELECT date, count(zone) AS np, count(rate) AS nf, row_number() OVER (ORDER BY date)-1 AS pos FROM cal LEFT JOIN p USING (date) GROUP BY date),
 ori AS (SELECT o.date AS origin, t.date AS target, t.np AS tp, t.nf AS tf,
   (SELECT CAST(sum(nz-np) AS BIGINT) FROM dd i, nz WHERE i.date BETWEEN o.date-{lookback - 1} AND o.date) AS na,
   (SELECT CAST(sum(np-nf) AS BIGINT) FROM dd i WHERE i.date BETWEEN o.date-{lookback - 1} AND o.date) AS nn
   FROM dd o JOIN dd t ON t.date=o.date+{horizon} WHERE o.pos>={lookback - 1} AND (o.pos-{lookback - 1})%{stride}=0),
 win AS (SELECT row_number() OVER (ORDER BY origin)-1 AS sample_id, origin, target, CAST(origin-{lookback - 1} AS DATE) AS input_start
   FROM ori, nz WHERE na=0 AND nn=0 AND tp=nz AND tf=nz)"""


CELLS_SQL = f"""lb AS (SELECT w.sample_id, a.zone, w.origin, w.target, a.rate AS anchor, y.rate AS y FROM win w
   JOIN p a ON a.date=w.origin JOIN p y ON y.date=w.target AND y.zone=a.zone),
 steps AS (SELECT w.sample_id, i.zone, (i.date-w.input_start)::INT AS step, i.date, i.rate FROM win w JOIN p i ON i.date BETWEEN w.input_start AND w.origin)"""


def metric_sql(y, mu, prefix="", sign=1):
    e = f"({sign}*({y}-{mu}))"
    return f"""{r6(f'avg(abs({e}))')} AS {prefix}mae, {r6(f'sqrt(avg({e}*{e}))')} AS {prefix}rmse, {r6(f'avg({e}*{e})')} AS {prefix}mse,
 {r6(f'avg({e})')} AS {prefix}bias, {r6(f'CASE WHEN var_pop({y})>0 THEN 1-sum({e}*{e})/(var_pop({y})*count({e})) END')} AS {prefix}r2,
 count({e}) AS {prefix}n"""


@query(
    "persistence_week_ahead_by_zone",
    "SW1 W4 W5 W6 E5 A12 D5 D6",
    f"WITH {window_sql(PANEL_DAILY)}, {CELLS_SQL} SELECT zone, {metric_sql('y', 'anchor')} FROM lb GROUP BY 1",
)
def persistence_week_ahead_by_zone(spark, sf):
    _, _, cells = daily_set(spark, sf)
    return rounded(cells.groupBy("zone").agg(*evaluate.point_metrics(F.col("y"), F.col("anchor"))))


@query("valid_windows", "SW1 W6", f"WITH {window_sql(PANEL_DAILY)} SELECT * FROM win")
def valid_windows(spark, sf):
    return daily_set(spark, sf)[1]


@query(
    "valid_windows_long_lookback",
    "SW1",
    f"WITH {window_sql(PANEL_REGION, 14, 7, 3)} SELECT * FROM win",
)
def valid_windows_long_lookback(spark, sf):
    panel = panel_region(spark, sf)
    return windows.build_windows(panel, zones_of(panel), 14, 7, 3)


@query(
    "excluded_windows",
    "SW2",
    f"""WITH {window_sql(PANEL_HOLES)}, ix AS (SELECT zone, row_number() OVER (ORDER BY zone)-1 AS node_index FROM (SELECT DISTINCT zone FROM p)),
 bad AS (SELECT ori.*, nz FROM ori, nz WHERE NOT (na=0 AND nn=0 AND tp=nz AND tf=nz)),
 inp AS (SELECT origin, string_agg(CASE WHEN np=0 THEN date::VARCHAR END, '|' ORDER BY date) AS e,
   string_agg(CASE WHEN np>0 AND np<nz THEN date::VARCHAR END, '|' ORDER BY date) AS q FROM bad JOIN dd ON dd.date BETWEEN origin-6 AND origin GROUP BY 1),
 ex AS (SELECT origin, cal.date, ix.zone, ix.node_index FROM bad JOIN cal ON cal.date BETWEEN origin-6 AND origin OR cal.date=target, ix),
 hit AS (SELECT DISTINCT origin, ex.zone, node_index FROM ex LEFT JOIN p USING (date, zone) WHERE p.rate IS NULL),
 agg AS (SELECT origin, count(*) AS n_affected, array_to_string(list(zone ORDER BY node_index)[1:10], '|') AS affected_sample FROM hit GROUP BY 1)
 SELECT bad.origin, bad.target, concat_ws('|', CASE WHEN e IS NOT NULL THEN 'fully_missing_input_dates' END,
  CASE WHEN q IS NOT NULL THEN 'partially_missing_input_dates' END, CASE WHEN na>0 THEN 'absent_input_rows' END,
  CASE WHEN nn>0 THEN 'missing_input_rates' END, CASE WHEN tp=0 THEN 'fully_missing_target_date' END,
  CASE WHEN tp>0 AND tp<nz THEN 'partial_target_coverage' END, CASE WHEN tp<nz THEN 'absent_target_rows' END,
  CASE WHEN tf<tp THEN 'missing_target_rates' END) AS reason, coalesce(e,'') AS empty_input_dates, coalesce(q,'') AS partial_input_dates,
  na AS n_absent_input, nn AS n_null_input, tp=0 AS target_empty, tp>0 AND tp<nz AS target_partial, nz-tp AS n_absent_target,
  tp-tf AS n_null_target, n_affected, affected_sample FROM bad JOIN inp USING (origin) LEFT JOIN agg USING (origin)""",
)
def excluded_windows(spark, sf):
    from zonewise.operators.clean import zone_master

    panel = panel_holes(spark, sf)
    return windows.excluded_windows(panel, zone_master(zones_of(panel), "zone"), L, H)


@query(
    "horizon_interpretation",
    "SW3",
    f"WITH {window_sql(PANEL_DAILY, 7, 3)} SELECT sample_id, CAST(origin-3 AS DATE) AS covers_from, CAST(origin+3 AS DATE) AS covers_to, origin-3<=origin AND origin-3>=input_start AS overlaps_inputs FROM win",
)
def horizon_interpretation(spark, sf):
    panel = panel_daily(spark, sf)
    return windows.horizon_interpretation(windows.build_windows(panel, zones_of(panel), 7, 3), 3)


_SPLIT = """sp AS (SELECT *, CASE WHEN r<=floor(n*0.65) THEN 'train' WHEN r<=floor(n*0.65)+floor(n*0.10) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY target, origin, sample_id) AS r, count(*) OVER () AS n FROM win))"""


def daily_split(spark, sf):
    panel, win, cells = daily_set(spark, sf)
    return panel, windows.fraction_split(win, 0.65, 0.10), cells


@query("fraction_split", "SW4 IO19 S2", f"WITH {window_sql(PANEL_DAILY)}, {_SPLIT} SELECT sample_id, target, split FROM sp")
def fraction_split(spark, sf):
    return daily_split(spark, sf)[1].select("sample_id", "target", "split")


@query(
    "boundary_split_counts",
    "SW5 IO19",
    f"""WITH {window_sql(PANEL_REGION)}, sp AS (SELECT *, CASE WHEN target BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train'
 WHEN target BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'validation' WHEN target BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' THEN 'test' END AS split FROM win)
 SELECT split, count(*) AS n_samples, min(target) AS first_target, max(target) AS last_target, min(origin) AS first_origin, max(origin) AS last_origin FROM sp GROUP BY 1""",
)
def boundary_split_counts(spark, sf):
    panel = panel_region(spark, sf)
    win = windows.build_windows(panel, zones_of(panel), L, H)
    ranges = {"train": ("1995-01-01", "1998-12-31"), "validation": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}
    return windows.split_counts(windows.boundary_split(win, ranges))


@query(
    "validation_halves",
    "SW6",
    f"""WITH {window_sql(PANEL_REGION)}, {_SPLIT}, v AS (SELECT *, row_number() OVER (ORDER BY target) AS k, count(*) OVER () AS m FROM sp WHERE split='validation')
 SELECT sample_id, CASE WHEN k<=floor(m*0.5) THEN 'selection' ELSE 'calibration' END AS half FROM v""",
)
def validation_halves(spark, sf):
    panel = panel_region(spark, sf)
    win = windows.fraction_split(windows.build_windows(panel, zones_of(panel), L, H), 0.65, 0.10)
    return windows.internal_halves(win).select("sample_id", "half")


@query(
    "zone_scaler_unique_dates",
    "SW7",
    f"""WITH {window_sql(PANEL_DAILY)}, {_SPLIT}, d AS (SELECT DISTINCT c.date FROM cal c JOIN sp ON split='train' AND c.date BETWEEN input_start AND origin)
 SELECT zone, {r6('avg(rate)')} AS train_mean, {r6('stddev_pop(rate)')} AS train_std,
 {r6('CASE WHEN stddev_pop(rate)<1e-8 THEN 1.0 ELSE stddev_pop(rate) END')} AS scale, count(rate) AS n_dates, stddev_pop(rate)<1e-8 AS near_zero_variance
 FROM p SEMI JOIN d USING (date) GROUP BY 1""",
)
def zone_scaler_unique_dates(spark, sf):
    panel, split, _ = daily_split(spark, sf)
    return rounded(scale.fit_zone_scaler(panel, split.filter("split = 'train'"), L))


@query(
    "zone_scaler_overlapping_cells",
    "SW8",
    f"""WITH {window_sql(PANEL_DAILY)}, {CELLS_SQL}, {_SPLIT} SELECT zone, {r6('avg(rate)')} AS train_mean, {r6('stddev_pop(rate)')} AS train_std,
 {r6('stddev_pop(rate)')} AS scale, count(*) AS n_cells FROM steps JOIN sp USING (sample_id) WHERE split='train' GROUP BY 1""",
)
def zone_scaler_overlapping_cells(spark, sf):
    _, split, cells = daily_split(spark, sf)
    return rounded(scale.fit_overlap_scaler(cells.join(split.filter("split = 'train'"), "sample_id", "left_semi")))


@query(
    "scaled_targets_round_trip",
    "SW9 F9",
    f"""WITH {window_sql(PANEL_DAILY)}, {CELLS_SQL}, {_SPLIT}, sc AS (SELECT zone, avg(rate) AS m, stddev_pop(rate) AS s FROM p SEMI JOIN
 (SELECT DISTINCT c.date FROM cal c JOIN sp ON split='train' AND c.date BETWEEN input_start AND origin) USING (date) GROUP BY 1)
 SELECT sample_id, zone, {r6('(y-m)/s')} AS y_z, {r6('y')} AS y_back FROM lb JOIN sc USING (zone)""",
)
def scaled_targets_round_trip(spark, sf):
    panel, split, cells = daily_split(spark, sf)
    sc = scale.fit_zone_scaler(panel, split.filter("split = 'train'"), L)
    out = scale.scale_cells(cells, sc)
    return rounded(out.select("sample_id", "zone", "y_z", scale.inverse_scale(F.col("y_z")).alias("y_back")))


_RES = """tr AS (SELECT s.*, rate-lag(rate) OVER (PARTITION BY sample_id, zone ORDER BY step) AS df FROM steps s JOIN sp USING (sample_id) WHERE split='train'),
 sc AS (SELECT (SELECT avg(ln(1+greatest(rate,0))) FROM tr) AS rm, (SELECT stddev_pop(ln(1+greatest(rate,0))) FROM tr) AS rs,
  (SELECT avg(df) FROM tr WHERE step>0) AS dm, (SELECT stddev_pop(df) FROM tr WHERE step>0) AS ds,
  (SELECT avg(y-anchor) FROM lb JOIN sp USING (sample_id) WHERE split='train') AS tm,
  (SELECT stddev_pop(y-anchor) FROM lb JOIN sp USING (sample_id) WHERE split='train') AS ts)"""


@query(
    "residual_scalers",
    "SW10 W3 F4",
    f"""WITH {window_sql(PANEL_DAILY)}, {CELLS_SQL}, {_SPLIT}, {_RES} SELECT {r6('rm')} AS rate_mean, {r6('rs')} AS rate_scale, {r6('dm')} AS diff_mean,
 {r6('ds')} AS diff_scale, {r6('tm')} AS delta_mean, {r6('ts')} AS delta_scale FROM sc""",
)
def residual_scalers(spark, sf):
    _, split, cells = daily_split(spark, sf)
    return rounded(scale.fit_residual_scalers(cells.join(split.filter("split = 'train'"), "sample_id", "left_semi")))


@query(
    "residual_features",
    "SW11 W3 F7",
    f"""WITH {window_sql(PANEL_DAILY)}, {CELLS_SQL}, {_SPLIT}, {_RES}, al AS (SELECT sample_id, zone, step, rate,
   rate-lag(rate) OVER (PARTITION BY sample_id, zone ORDER BY step) AS df FROM steps)
 SELECT al.sample_id, al.zone, al.step, {r6('(ln(1+greatest(rate,0))-rm)/rs')} AS rate_z, {r6('CASE WHEN step=0 THEN 0.0 ELSE (df-dm)/ds END')} AS diff_z,
 {r6('(y-anchor-tm)/ts')} AS delta_z FROM al JOIN lb USING (sample_id, zone), sc""",
)
def residual_features(spark, sf):
    _, split, cells = daily_split(spark, sf)
    sc = scale.fit_residual_scalers(cells.join(split.filter("split = 'train'"), "sample_id", "left_semi"))
    f = scale.residual_features(cells, sc)
    return rounded(
        f.select("sample_id", "zone", "delta_z", F.posexplode(F.arrays_zip("rate_z", "diff_z")).alias("step", "_v")).select(
            "sample_id", "zone", "step", "_v.rate_z", "_v.diff_z", "delta_z"
        )
    )


@query(
    "reconstructed_rates",
    "SW13",
    f"""WITH {window_sql(PANEL_DAILY)}, {CELLS_SQL}, {_SPLIT}, {_RES} SELECT sample_id, zone, {r6('anchor+0.5*ts+tm')} AS mu,
 {r6('0.25*ts*ts')} AS variance, {r6('0.5*ts')} AS sigma FROM lb, sc""",
)
def reconstructed_rates(spark, sf):
    _, split, cells = daily_split(spark, sf)
    sc = scale.fit_residual_scalers(cells.join(split.filter("split = 'train'"), "sample_id", "left_semi"))
    z = cells.withColumns({"mu_z": F.lit(0.5), "var_z": F.lit(0.25)})
    return rounded(scale.reconstruct_rate(z, sc).select("sample_id", "zone", "mu", "variance", "sigma"))


@query(
    "operational_window",
    "SW14 W8 W7",
    f"""WITH p AS ({PANEL_HOLES}), i AS (SELECT max(date) AS issue FROM p), z AS (SELECT DISTINCT zone FROM p)
 SELECT z.zone, issue AS origin, CAST(issue+7 AS DATE) AS target, count(p.date) AS n_days, count(rate)=7 AS complete, {r6('sum(rate)')} AS total
 FROM z CROSS JOIN i LEFT JOIN p ON p.zone=z.zone AND p.date>issue-7 GROUP BY ALL""",
)
def operational_window(spark, sf):
    panel = panel_holes(spark, sf)
    last = panel.agg(F.max("date").alias("d"))
    out = windows.operational_window(panel, zones_of(panel), one_row(last)["d"], L, H)
    total = F.aggregate(F.filter("inputs", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "zone", "origin", "target", F.size("inputs").cast("long").alias("n_days"), "complete", R(total).alias("total")
    )


@query(
    "consecutive_report_runs",
    "W7 F3",
    f"""WITH p AS ({PANEL_HOLES}) SELECT zone, max(date)-min(date)=count(DISTINCT date)-1 AND count(DISTINCT date)=30 AS consecutive FROM p GROUP BY 1""",
)
def consecutive_report_runs(spark, sf):
    return windows.consecutive_days(panel_holes(spark, sf), ["zone"], "date", 30)


@query(
    "window_set_reload",
    "IO17 IO19",
    f"""WITH {window_sql(PANEL_DAILY)}, {CELLS_SQL} SELECT sample_id, count(*) AS n_cells, count(DISTINCT zone) AS n_rows, count(DISTINCT zone)=(SELECT nz FROM nz) AND count(rate)=7*(SELECT nz FROM nz) AS ok FROM steps GROUP BY 1""",
)
def window_set_reload(spark, sf):
    from zonewise.session import pin

    panel, _, cells = daily_set(spark, sf)
    n = zones_of(panel).agg(F.count(F.lit(1)).alias("n"))
    return windows.window_set_check(pin(cells), L, one_row(n)["n"])


@query(
    "split_summary",
    "A18 S2",
    f"""WITH {window_sql(PANEL_REGION)}, {CELLS_SQL}, {_SPLIT} SELECT split, min(lb.target) AS first_target, max(lb.target) AS last_target,
 count(DISTINCT lb.target) AS n_dates, count(*) AS n_cells, {r6('avg(y)')} AS mean_rate, {r6('stddev_samp(y)')} AS sd_rate, {r6('avg(y-anchor)')} AS mean_delta,
 {r6('stddev_samp(y-anchor)')} AS sd_delta, {r6('count(DISTINCT lb.target)/(SELECT count(DISTINCT target) FROM win)')} AS fraction FROM lb JOIN sp USING (sample_id) GROUP BY 1""",
)
def split_summary(spark, sf):
    panel = panel_region(spark, sf)
    win = windows.build_windows(panel, zones_of(panel), L, H)
    split = windows.fraction_split(win, 0.65, 0.10)
    cells = windows.lookback_arrays(panel, win, L).join(split.select("sample_id", "split"), "sample_id")
    return rounded(evaluate.split_summary(cells))


@query("pooled_issues", "S2", f"WITH {window_sql(PANEL_REGION)}, {_SPLIT} SELECT sample_id, origin, target FROM sp WHERE split IN ('validation','test')")
def pooled_issues(spark, sf):
    """Validation and test windows as one pool of issues."""
    panel = panel_region(spark, sf)
    split = windows.fraction_split(windows.build_windows(panel, zones_of(panel), L, H), 0.65, 0.10)
    return windows.pool_splits([split.filter(F.col("split") == s) for s in ("validation", "test")]).select("sample_id", "origin", "target")


_RECUT = _SPLIT.replace("0.65", "0.60").replace("0.10", "0.15")


@query(
    "window_set_recut",
    "SW8 IO15 IO17",
    f"""WITH {window_sql(PANEL_REGION)}, {CELLS_SQL}, {_RECUT}, sc AS (SELECT zone, avg(rate) AS m, CASE WHEN stddev_pop(rate)<1e-8 THEN 1 ELSE stddev_pop(rate) END AS s, count(*) AS k
   FROM steps JOIN sp USING (sample_id) WHERE split='train' GROUP BY 1)
 SELECT split, count(DISTINCT sample_id) AS n_samples, min(sp.target) AS first_target, max(sp.target) AS last_target, {r6('avg((y-m)/s)')} AS mean_z, sum(k)/count(*)::DOUBLE AS scaler_cells,
  (SELECT max(origin)-min(origin)+7 FROM sp WHERE split='train') AS n_unique_dates, {r6('count(DISTINCT sample_id)/(SELECT count(*) FROM win)')} AS proportion
 FROM lb JOIN sp USING (sample_id) JOIN sc USING (zone) GROUP BY 1""",
)
def window_set_recut(spark, sf):
    """A set saved at 70/15/15, cut anew at 60/15/25 without its samples being written again, and read back."""
    import uuid

    from zonewise.operators import recut
    from zonewise.session import written_folder

    folder = f"{written_folder(spark)}/{uuid.uuid4().hex}"
    panel = panel_region(spark, sf)
    win = windows.build_windows(panel, zones_of(panel), L, H)
    source = recut.save_window_set(f"{folder}/s1", windows.fraction_split(win), windows.lookback_arrays(panel, win, L))
    made = recut.recut(spark, source, f"{folder}/s2")
    split, cells = recut.load_window_set(spark, f"{folder}/s2")
    scaled = scale.scale_cells(cells.join(split.select("sample_id", "split"), "sample_id"), made["scaler"])
    fitted = made["scaler"].select("zone", F.col("n_cells").alias("k"), "n_unique_dates")
    z = scaled.join(fitted, "zone").groupBy("split").agg(F.avg("y_z").alias("mean_z"), F.avg("k").alias("scaler_cells"), F.max("n_unique_dates").cast("long").alias("n_unique_dates"))
    return rounded(made["summary"].select("split", "n_samples", "first_target", "last_target", "proportion").join(z, "split"))
