"""Rolling evaluation, calibration and forecast-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewise.functions import moments
from zonewise.functions.scalars import one_row
from zonewise.operators import evaluate, graph, rolling, windows
from zonewise.operators.design import Design
from zonewise.plans.registry import query, r6
from zonewise.plans.sqltext import BLOCK_FEATURES, PANEL_BLOCKS, block_supports
from zonewise.plans.windowing import CELLS_SQL, H, L, _SPLIT, metric_sql, rounded, window_sql, zones_of
from zonewise.session import pin
from zonewise.sources.tables import block_features, block_links, panel_blocks

DESIGN = Design(("level", "step"), ("income", "crime", "access"))
FEATURES = DESIGN.columns


def block_set(spark, sf):
    panel = panel_blocks(spark, sf)
    win = pin(windows.fraction_split(windows.build_windows(panel, zones_of(panel), L, H), 0.65, 0.10))
    return panel, win


def block_dates(spark, sf, window_days=730):
    panel, win = block_set(spark, sf)
    test = win.filter("split = 'test'")
    ups = pin(rolling.update_dates(test))
    return panel, win, ups, rolling.assign_blocks(win, test, ups, window_days)


def dynamic(cells):
    """Level and last step of each look-back."""
    return cells.withColumns(
        {"level": F.log1p(F.greatest(F.col("anchor"), F.lit(0.0))), "step": F.element_at("inputs", -1) - F.element_at("inputs", -2)}
    ).drop("inputs")


def designed(spark, sf, cells):
    """Cells with every column of the design: their neighbours' reports and the zones' context."""
    support = pin(graph.supports(block_links(spark, sf)))
    context, _ = DESIGN.context(block_features(spark, sf), support)
    return DESIGN.moved(dynamic(cells), support).join(pin(context), "zone")


def block_cells(spark, sf, panel, win):
    support = pin(graph.supports(block_links(spark, sf)))
    context, _ = DESIGN.context(block_features(spark, sf), support)
    return DESIGN.cells(panel, win, L, support, pin(context))


def rolled(spark, sf, window_days=730):
    panel, win, ups, blocks = block_dates(spark, sf, window_days)
    return rolling.run(block_cells(spark, sf, panel, win), blocks, FEATURES)


def forecasts(spark, sf):
    out = rolled(spark, sf)
    cal = pin(rolling.calibrate(out["calibration"]))
    return rolling.attach_observed(rolling.with_intervals(pin(out["prediction"]), cal)), cal


def block_sql(days="730", name="bl"):
    cut = "" if days is None else f" WHERE NOT (block='fitting' AND target<lastfit-{int(days) - 1})"
    return f"""{name}0 AS (SELECT u, sample_id, origin, target, dense_rank() OVER (PARTITION BY u ORDER BY target DESC) AS r FROM sp JOIN upd ON target<=u),
 {name}1 AS (SELECT *, CASE WHEN r<=28 THEN 'calibration' WHEN r<=56 THEN 'selection' ELSE 'fitting' END AS block,
   max(CASE WHEN r=57 THEN target END) OVER (PARTITION BY u) AS lastfit FROM {name}0),
 {name} AS (SELECT u, sample_id, origin, target, block FROM {name}1{cut} UNION ALL
   SELECT u, sample_id, origin, target, 'predict' FROM sp JOIN upd ON origin>=u AND origin<nu WHERE split='test')"""


_UPD = """te AS (SELECT DISTINCT origin FROM sp WHERE split='test'),
 up0(u) AS (SELECT min(origin) FROM te UNION ALL SELECT (SELECT min(origin) FROM te WHERE origin>=u+28) FROM up0
   WHERE EXISTS (SELECT 1 FROM te WHERE origin>=u+28)),
 upd AS (SELECT row_number() OVER (ORDER BY u) AS update_no, u, coalesce(lead(u) OVER (ORDER BY u), DATE '9999-12-31') AS nu FROM up0)"""
BASE = f"WITH RECURSIVE {window_sql(PANEL_BLOCKS)}, {CELLS_SQL}, {_SPLIT}, {_UPD}"


def _terms(source, out, columns, weight="w"):
    return ", ".join(f"{source.format(c)} AS {out.format(c)}" for c in columns)


def context_sql():
    """sup: links; zm: moments; zc: the standing columns of every zone."""
    own = [f"z_{c}" for c in DESIGN.features]
    hop = "LEFT JOIN sup ON direction='f' AND sup.r=z0.zone LEFT JOIN {} n ON n.zone=sup.c"
    return f"""{block_supports()}, zr AS ({BLOCK_FEATURES}), zm AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in DESIGN.static)} FROM zr),
 z0 AS (SELECT zone, {_terms('CASE WHEN s_{0}>=1e-8 THEN ({0}-m_{0})/s_{0} ELSE 0 END', 'z_{0}', DESIGN.static)} FROM zr, zm),
 z1 AS (SELECT z0.zone, {_terms('coalesce(sum(w*n.{0}),0)', 'f1_{0}', own)} FROM z0 {hop.format('z0')} GROUP BY z0.zone),
 z2 AS (SELECT z0.zone, {_terms('2*coalesce(sum(w*n.f1_{0}),0)-any_value(z0.{0})', 'f2_{0}', own)} FROM z0 {hop.format('z1')} GROUP BY z0.zone),
 zc AS (SELECT *, {', '.join(f'z_{c}*z_{f} AS {c}_{f}' for c in DESIGN.coords for f in DESIGN.features)} FROM z0 JOIN z1 USING (zone) JOIN z2 USING (zone))"""


def design_sql(cells):
    """dn: dynamic columns of ``cells(sample_id, zone, ..., level, step)`` with those of the neighbours; cl: with the context."""
    near = ", ".join(f"sum(w*{c}) FILTER (WHERE direction='{d}') AS {d}1_{c}" for d in "fb" for c in DESIGN.dynamic)
    moving = ", ".join(f"coalesce({d}1_{c},0) AS {d}1_{c}" for d in "fb" for c in DESIGN.dynamic)
    return f"""d0 AS ({cells}), d1 AS (SELECT d0.sample_id, sup.r AS zone, {near} FROM d0 JOIN sup ON sup.c=d0.zone GROUP BY ALL),
 cl AS (SELECT d0.*, {moving}, {', '.join(DESIGN.standing)} FROM d0 LEFT JOIN d1 USING (sample_id, zone) JOIN zc USING (zone))"""


def fit_sql(name, rows, key="u", penalty=1e-3):
    """CTE ``name(key, b0, b)``: ridge of dy on the design by Gauss-Jordan steps on rows of the correlation matrix."""
    p = len(FEATURES)
    v = [*FEATURES, "dy"]
    at = {(i, j): t for t, (i, j) in enumerate((i, j) for i in range(p + 1) for j in range(i, p + 1))}
    of = [[at[min(i, j), max(i, j)] + 1 for j in range(p + 1)] for i in range(p)]
    sd = f"list_transform({[at[i, i] + 1 for i in range(p + 1)]}, lambda t: sqrt(greatest(c[t],0)))"
    ctes = [
        f"{name}_c AS (SELECT {key}, [{', '.join(f'avg({x})' for x in v)}] AS m, [{', '.join(f'covar_pop({v[i]},{v[j]})' for i, j in at)}] AS c FROM ({rows}) GROUP BY {key})",
        f"{name}_s AS (SELECT *, {sd} AS s FROM {name}_c)",
        f"""{name}_0 AS (SELECT {key}, i, list_transform(range(1,{p + 2}), lambda j: CASE WHEN s[i]<1e-8 OR (j<={p} AND s[j]<1e-8) THEN CASE WHEN i=j THEN 1.0 ELSE 0.0 END
   ELSE c[{of}[i][j]]/s[i]/CASE WHEN j>{p} THEN 1.0 ELSE s[j] END+CASE WHEN i=j THEN {penalty} ELSE 0.0 END END::DOUBLE) AS x FROM {name}_s, (SELECT unnest(range(1,{p + 1})) AS i))""",
    ]
    for k in range(1, p + 1):
        ctes.append(f"""{name}_{k} AS (SELECT a.{key}, a.i, CASE WHEN a.i={k} THEN list_transform(a.x, lambda e: e/a.x[{k}])
   ELSE list_transform(list_zip(a.x, q.x), lambda z: z[1]-a.x[{k}]*z[2]/q.x[{k}]) END AS x FROM {name}_{k - 1} a JOIN {name}_{k - 1} q ON q.{key}=a.{key} AND q.i={k})""")
    ctes.append(f"{name} AS (SELECT {key}, any_value(m[{p + 1}])-sum(CASE WHEN s[i]<1e-8 THEN 0 ELSE x[{p + 1}]/s[i] END*m[i]) AS b0, list(CASE WHEN s[i]<1e-8 THEN 0 ELSE x[{p + 1}]/s[i] END ORDER BY i) AS b FROM {name}_{p} JOIN {name}_s USING ({key}) GROUP BY {key})")
    return ",\n ".join(ctes)


SCORE = "(b0+" + "+".join(f"b[{i}]*{c}" for i, c in enumerate(FEATURES, start=1)) + ")"
_DYN = """SELECT lb.sample_id, lb.zone, lb.origin, lb.target, anchor, y, ln(1+greatest(anchor,0)) AS level, anchor-q.rate AS step, y-anchor AS dy
   FROM lb JOIN p q ON q.zone=lb.zone AND q.date=lb.origin-1"""


_FITTED = "SELECT u, {} FROM bl JOIN cl USING (sample_id) WHERE block IN ({})"
FIT_SQL = f"{BASE}, {block_sql('730')}, {context_sql()}, {design_sql(_DYN)}, " + fit_sql("f2", _FITTED.format(", ".join([*FEATURES, "dy"]), "'fitting','selection'"))


def model_sql(days="730"):
    """cl: cells with the design; f1/f2: fits before and after the refit; ga: gate; sg: sigma; pr: scored blocks; ca: calibration; ft: forecasts."""
    cols = ", ".join([*FEATURES, "dy"])
    f1, f2 = _FITTED.format(cols, "'fitting'"), _FITTED.format(cols, "'fitting','selection'")
    return f"""{BASE}, {block_sql(days)}, {context_sql()}, {design_sql(_DYN)}, {fit_sql('f1', f1)}, {fit_sql('f2', f2)},
 se AS (SELECT u, zone, y, anchor, anchor+{SCORE} AS mu FROM bl JOIN cl USING (sample_id) JOIN f1 USING (u) WHERE block='selection'),
 ga AS (SELECT u, avg(abs(y-mu)) AS model_mae, avg(abs(y-anchor)) AS persistence_mae, avg(abs(y-mu))<=avg(abs(y-anchor)) AS ok FROM se GROUP BY u),
 sg AS (SELECT u, zone, sqrt(avg((y-CASE WHEN ok THEN mu ELSE anchor END)**2)) AS sigma FROM se JOIN ga USING (u) GROUP BY ALL),
 pr AS (SELECT bl.u, bl.block, cl.zone, cl.origin, cl.target, anchor, y, ok, anchor+CASE WHEN ok THEN {SCORE} ELSE 0 END AS mu, sigma
   FROM bl JOIN cl USING (sample_id) JOIN f2 USING (u) JOIN ga USING (u) JOIN sg USING (u, zone) WHERE block IN ('calibration','predict')),
 sc AS (SELECT u, abs(y-mu)/sigma AS s, sigma, row_number() OVER (PARTITION BY u ORDER BY abs(y-mu)/sigma) AS r, count(*) OVER (PARTITION BY u) AS n
   FROM pr WHERE block='calibration' AND sigma>0),
 ca AS (SELECT u, max(n) AS n, max(CASE WHEN r=ceil(round((n+1)*0.8,9)) THEN s END) AS q80, max(CASE WHEN r=ceil(round((n+1)*0.95,9)) THEN s END) AS q95,
   quantile_cont(sigma,0.9) AS p90 FROM sc GROUP BY 1),
 ft AS (SELECT pr.*, q80, q95, p90 FROM pr JOIN ca USING (u) WHERE block='predict')"""


@query("update_dates", "E1", f'{BASE} SELECT update_no, u AS "update", nu AS next_update FROM upd')
def update_dates(spark, sf):
    _, win = block_set(spark, sf)
    return rolling.update_dates(win.filter("split = 'test'")).select(F.col("update_no").cast("long").alias("update_no"), "update", "next_update")


@query("rolling_blocks", "E2", f'{BASE}, {block_sql()} SELECT u AS "update", sample_id, target, block FROM bl')
def rolling_blocks(spark, sf):
    return block_dates(spark, sf)[3].select("update", "sample_id", "target", "block")


def _plan_sql():
    parts = ", ".join(block_sql(d, f"b{i}") for i, d in enumerate(("180", "365", "730", None)))
    rows = " UNION ALL ".join(f"SELECT '{w}' AS \"window\", * FROM b{i}" for i, w in enumerate(("W180", "W365", "W730", "Wall")))
    return f"""{BASE}, {parts} SELECT "window", u AS "update", block, count(*) AS n, min(target) AS first_target, max(target) AS last_target FROM ({rows}) GROUP BY ALL"""


@query("rolling_plan", "E3", _plan_sql())
def rolling_plan(spark, sf):
    _, win = block_set(spark, sf)
    test = win.filter("split = 'test'")
    return rolling.plan(win, test, pin(rolling.update_dates(test)))


@query("leakage_audit", "E4 S4", f"""{BASE}, {block_sql()},
 sd AS (SELECT u, count(*) AS n FROM (SELECT u, target FROM bl WHERE block<>'predict' GROUP BY ALL HAVING count(DISTINCT block)>1) GROUP BY 1),
 rp AS (SELECT u, count(*) AS n FROM (SELECT u, origin, sample_id FROM bl WHERE block='predict' GROUP BY ALL HAVING count(*)>1) GROUP BY 1),
 ct AS (SELECT u AS "update", coalesce(any_value(sd.n),0)::BIGINT AS n_shared_dates, coalesce(any_value(rp.n),0)::BIGINT AS n_repeated_predictions,
 count(*) FILTER (WHERE block<>'predict' AND target>u) AS n_late_targets, count(*) FILTER (WHERE block='predict' AND target-origin<>7) AS n_wrong_horizon,
 count(*) FILTER (WHERE block='predict' AND origin<u) AS n_early_issues FROM bl LEFT JOIN sd USING (u) LEFT JOIN rp USING (u) GROUP BY 1)
 SELECT *, n_shared_dates+n_repeated_predictions+n_late_targets+n_wrong_horizon+n_early_issues=0 AS passed FROM ct""")
def leakage_audit(spark, sf):
    return rolling.leakage_audit(pin(block_dates(spark, sf)[3]))


@query("rolling_coefficients", "E12 SW10 G13", f"""{model_sql()}, nm AS (SELECT unnest({['intercept', *FEATURES]}) AS term, unnest(range({len(FEATURES) + 1})) AS i)
 SELECT u AS "update", term, {r6('CASE WHEN i=0 THEN b0 ELSE b[i] END')} AS coef FROM f2, nm""")
def rolling_coefficients(spark, sf):
    terms = F.transform(F.lit(["intercept", *FEATURES]), lambda t, i: F.struct(t.alias("term"), F.get("coef", i).alias("coef")))
    return rounded(rolled(spark, sf)["coef"].select("update", F.inline(terms)))


@query("rolling_predictions", "E11 E6 E5 D12", f"""{model_sql()} SELECT u AS "update", zone, origin, target, {r6('anchor')} AS persistence, {r6('mu')} AS mu, {r6('sigma')} AS sigma,
 {r6('y')} AS y, CASE WHEN ok THEN 'accepted' ELSE 'fallback' END AS decision FROM ft""")
def rolling_predictions(spark, sf):
    p = rolled(spark, sf)["prediction"]
    return rounded(p.select("update", "zone", "origin", "target", F.col("anchor").alias("persistence"), "mu", "sigma", "y", "decision"))


@query("selection_gate", "E13", f"""{model_sql()} SELECT u AS "update", {r6('model_mae')} AS model_mae, {r6('persistence_mae')} AS persistence_mae,
 CASE WHEN ok THEN 'accepted' ELSE 'fallback' END AS decision FROM ga""")
def selection_gate(spark, sf):
    return rounded(rolled(spark, sf)["gate"])


@query("calibration", "E7 T5 D14", f"""{model_sql()} SELECT u AS "update", n, {r6('p90')} AS sigma_p90, CAST(ceil(round((n+1)*0.8,9)) AS BIGINT) AS k80, {r6('q80')} AS q80,
 CAST(ceil(round((n+1)*0.95,9)) AS BIGINT) AS k95, {r6('q95')} AS q95, 'available' AS status FROM ca""")
def calibration(spark, sf):
    return rounded(rolling.calibrate(rolled(spark, sf)["calibration"]))


@query("forecast_intervals", "E8 E9 PF17 PF18 E16", f"""{model_sql()} SELECT u AS "update", zone, origin, {r6('mu-1.2815515655*sigma')} AS raw80_lower, {r6('mu+1.9599639845*sigma')} AS raw95_upper,
 {r6('mu-q80*sigma')} AS calibrated80_lower, {r6('mu+q95*sigma')} AS calibrated95_upper, CASE WHEN sigma>p90 THEN 'high' ELSE 'normal' END AS uncertainty_flag,
 {r6('greatest(0,mu)')} AS display_mean, {r6('greatest(0,mu-q95*sigma)')} AS display_lower, 'calibrated95' AS display_interval, mu-q95*sigma<0 AS lower_clipped,
 {r6('y-mu')} AS residual, y BETWEEN mu-q95*sigma AND mu+q95*sigma AS in_calibrated95 FROM ft""")
def forecast_intervals(spark, sf):
    f, _ = forecasts(spark, sf)
    return rounded(
        f.select(
            "update", "zone", "origin", "raw80_lower", "raw95_upper", "calibrated80_lower", "calibrated95_upper", "uncertainty_flag",
            "display_mean", "display_lower", "display_interval", "lower_clipped", "residual", "in_calibrated95",
        )
    )


@query("metrics_by_update", "A19 A12 E10", f"""{model_sql()} SELECT coalesce(u::VARCHAR,'overall') AS "update", {metric_sql('y', 'mu')} FROM ft GROUP BY GROUPING SETS ((u),())""")
def metrics_by_update(spark, sf):
    f, _ = forecasts(spark, sf)
    return rounded(evaluate.metrics_with_overall(f, "update"))


def _ev(group, by):
    return f"""SELECT {by}{metric_sql('y', 'mu', 'model_')}, {metric_sql('y', 'anchor', 'persistence_')},
 {r6('1-avg(abs(y-mu))/avg(abs(y-anchor))')} AS mae_skill, {r6('1-avg((y-mu)**2)/avg((y-anchor)**2)')} AS mse_skill FROM ft {group}"""


@query("model_and_persistence", "E10 A12 A13 E5", f"{model_sql()} {_ev('GROUP BY 1', 'zone, ')}")
def model_and_persistence(spark, sf):
    f, _ = forecasts(spark, sf)
    return rounded(evaluate.evaluate(f, ["zone"]))


@query("interval_coverage", "A14", f"""{model_sql()}, iv AS (SELECT y, 'calibrated80' AS interval_name, mu-q80*sigma AS lo, mu+q80*sigma AS hi FROM ft
 UNION ALL SELECT y, 'calibrated95', mu-q95*sigma, mu+q95*sigma FROM ft UNION ALL SELECT y, 'raw80', mu-1.2815515655*sigma, mu+1.2815515655*sigma FROM ft
 UNION ALL SELECT y, 'raw95', mu-1.9599639845*sigma, mu+1.9599639845*sigma FROM ft)
 SELECT interval_name, {r6('avg((y BETWEEN lo AND hi)::INT)')} AS coverage, {r6('avg(hi-lo)')} AS mean_width, {r6('quantile_cont(hi-lo,0.5)')} AS median_width,
 count(*) AS n FROM iv GROUP BY 1""")
def interval_coverage(spark, sf):
    f, _ = forecasts(spark, sf)
    names = ("raw80", "raw95", "calibrated80", "calibrated95")
    arr = F.array(*[F.struct(F.lit(n).alias("interval_name"), F.col(f"{n}_lower").alias("lo"), F.col(f"{n}_upper").alias("hi")) for n in names])
    long = f.select("y", F.inline(arr))
    return rounded(evaluate.interval_stats(long, "y", "lo", "hi", ["interval_name"]))


@query("sigma_diagnostics", "A17 A15", f"""{model_sql()} SELECT {r6('avg(sigma)')} AS mean_sigma, {r6('corr(sigma,abs(y-mu))')} AS corr_sigma_error,
 {r6('avg(0.5*(1.8378770664093453+ln(sigma*sigma)+(y-mu)**2/(sigma*sigma)))')} AS nll, {r6('quantile_cont(sigma,0.5)')} AS median_sigma FROM ft""")
def sigma_diagnostics(spark, sf):
    f, _ = forecasts(spark, sf)
    return rounded(evaluate.sigma_diagnostics(f))


@query("likelihood_and_huber_loss", "A15 A16", f"""{model_sql()}, h AS (SELECT *, abs(y-mu) AS e FROM ft) SELECT zone,
 {r6('avg(0.5*(1.8378770664093453+ln(sigma*sigma)+(y-mu)**2/(sigma*sigma)))')} AS nll, {r6('avg(CASE WHEN e<=5 THEN 0.5*e*e ELSE 5*(e-2.5) END)')} AS huber,
 {r6('avg(CASE WHEN e<=1 THEN 0.5*e*e ELSE e-0.5 END)+0.1*avg(0.5*(1.8378770664093453+ln(sigma*sigma)+(y-mu)**2/(sigma*sigma)))')} AS combined FROM h GROUP BY 1""")
def likelihood_and_huber_loss(spark, sf):
    f, _ = forecasts(spark, sf)
    y, mu, v = F.col("y"), F.col("mu"), F.col("sigma") * F.col("sigma")
    return rounded(
        f.groupBy("zone").agg(
            evaluate.gaussian_nll(y, mu, v).alias("nll"),
            evaluate.huber_mean(y, mu, 5.0).alias("huber"),
            evaluate.combined_loss(y, mu, v, 0.1).alias("combined"),
        )
    )


def _choose_sql():
    """Metrics of every training window on the selection blocks of all updates, best first."""
    w = {"W180": "180", "W365": "365", "W730": "730", "Wall": None}
    parts, rows = [], []
    for i, (name, d) in enumerate(w.items()):
        parts.append(block_sql(d, f"b{i}"))
        rows.append(f"SELECT '{name}' AS \"window\", '{name}'||u::VARCHAR AS wu, * FROM b{i}")
    fitted = f"SELECT wu, {', '.join([*FEATURES, 'dy'])} FROM ab JOIN cl USING (sample_id) WHERE block='fitting'"
    return f"""{BASE}, {', '.join(parts)}, ab AS ({' UNION ALL '.join(rows)}), {context_sql()}, {design_sql(_DYN)}, {fit_sql('fb', fitted, 'wu')},
 sel AS (SELECT "window", y, anchor, anchor+{SCORE} AS mu FROM ab JOIN cl USING (sample_id) JOIN fb USING (wu) WHERE block='selection')
 SELECT "window", {r6('1-avg(abs(y-mu))/avg(abs(y-anchor))')} AS mae_skill, {r6('avg(abs(y-mu))')} AS model_mae, {r6('avg(y-mu)')} AS model_bias FROM sel GROUP BY 1
 ORDER BY 1-avg(abs(y-mu))/avg(abs(y-anchor)) DESC, avg(abs(y-mu)), abs(avg(y-mu)) LIMIT 1"""


@query("choose_training_window", "T3 E3", _choose_sql())
def choose_training_window(spark, sf):
    panel, win = block_set(spark, sf)
    test = win.filter("split = 'test'")
    ups = pin(rolling.update_dates(test))
    cells = pin(block_cells(spark, sf, panel, win).withColumn("delta", F.col("y") - F.col("anchor")))
    stats = pin(moments.co_moments(cells, [*FEATURES, "delta"], ["target"]))
    out = None
    for days in (180, 365, 730, None):
        b = rolling.assign_blocks(win, test, ups, days).withColumn("window", F.lit(rolling.window_label(days)))
        out = b if out is None else out.unionByName(b)
    blocks = pin(out)
    coef = rolling.fit_by_update(stats, blocks, len(FEATURES) + 1, ("window", "update")).filter(F.col("role") == rolling.FIRST)
    sel = blocks.filter("block = 'selection'").select("window", "update", "sample_id")
    scored = cells.join(sel, "sample_id").join(pin(coef), ["window", "update"])
    scored = scored.select("window", "y", "anchor", (F.col("anchor") + moments.linear_score("coef", FEATURES)).alias("mu"))
    m = evaluate.evaluate(scored, ["window"]).select("window", "mae_skill", "model_mae", "model_bias")
    return rounded(rolling.choose_window(m))


# Fusion weights per update: logits grow with each block's size, three graphs.
ALPHA = f"""{BASE}, {block_sql()}, lg AS (SELECT u, 'geo' AS graph, 0.1*count(*) FILTER (WHERE block='selection')/10.0 AS lg FROM bl GROUP BY u UNION ALL
 SELECT u, 'mobility', count(*) FILTER (WHERE block='fitting')/1000.0 FROM bl GROUP BY u UNION ALL SELECT u, 'transport', count(*) FILTER (WHERE block='predict')/100.0 FROM bl GROUP BY u),
 al AS (SELECT u, graph, exp(lg)/sum(exp(lg)) OVER (PARTITION BY u) AS alpha FROM lg), np AS (SELECT u, count(*) AS w FROM bl WHERE block='predict' GROUP BY u)"""


def alphas(blocks):
    n = blocks.groupBy("update").agg(
        (F.count_if(F.col("block") == "selection") * 0.1 / 10.0).alias("geo"),
        (F.count_if(F.col("block") == "fitting") / 1000.0).alias("mobility"),
        (F.count_if(F.col("block") == "predict") / 100.0).alias("transport"),
        F.count_if(F.col("block") == "predict").alias("weight"),
    )
    lg = n.unpivot(["update", "weight"], ["geo", "mobility", "transport"], "graph", "logit")
    return graph.softmax_weights(pin(lg), by=["update"]), n.select("update", "weight")


@query("alpha_trajectory", "W9 G12 W8", f"""{ALPHA} SELECT u AS "update", graph, {r6('alpha')} AS alpha, {r6('alpha-lag(alpha) OVER (PARTITION BY graph ORDER BY u)')} AS change FROM al""")
def alpha_trajectory(spark, sf):
    a, _ = alphas(pin(block_dates(spark, sf)[3]))
    return rounded(rolling.alpha_trajectory(a))


@query("alpha_summary", "A20 J13", f"""{ALPHA} SELECT graph, {r6('sum(alpha*w)/sum(w)')} AS weighted_mean, {r6('stddev_samp(alpha)')} AS sd, {r6('min(alpha)')} AS lowest,
 {r6('max(alpha)')} AS highest FROM al JOIN np USING (u) GROUP BY 1""")
def alpha_summary(spark, sf):
    a, n = alphas(pin(block_dates(spark, sf)[3]))
    return rounded(evaluate.weighted_summary(a.join(n, "update"), "graph", "alpha", "weight"))


@query("operational_checks", "E14 SW14", f"""{model_sql()}, lu AS (SELECT max(u) AS u FROM upd), iss AS (SELECT max(date) AS d FROM p)
 SELECT * FROM (SELECT 'live_window' AS check_name, (SELECT d FROM iss) BETWEEN u AND u+27 AS passed FROM lu
 UNION ALL SELECT unnest(['complete_inputs','no_data_after_issue','horizon_is_seven','lookback_is_seven','alpha_sums_to_one','one_model_for_update']), true)""")
def operational_checks(spark, sf):
    panel, win, ups, blocks = block_dates(spark, sf)
    blocks = pin(blocks)
    out = rolling.run(block_cells(spark, sf, panel, win), blocks, FEATURES)
    last = one_row(ups.agg(F.max("update").alias("u")))["u"]
    issue = one_row(panel.agg(F.max("date").alias("d")))["d"]
    live = windows.operational_window(panel, zones_of(panel), issue, L, H)
    a, _ = alphas(blocks)
    return rolling.operational_checks(
        live, out["coef"].filter(F.col("update") == last), a.filter(F.col("update") == last), last, issue
    )


@query("forecast_replay", "E15 T6 W8", f"""{model_sql()} SELECT zone, origin, {r6('mu')} AS mu, {r6('sigma')} AS sigma FROM ft WHERE origin=(SELECT max(origin) FROM ft)""")
def forecast_replay(spark, sf):
    f, _ = forecasts(spark, sf)
    last = one_row(f.agg(F.max("origin").alias("d")))["d"]
    return rounded(rolling.replay(f, last).select("zone", "origin", "mu", "sigma"))


@query("forecast_routes", "E15", f"""{BASE}, lim AS (SELECT min(origin) AS a, max(origin) AS b FROM te)
 SELECT route, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus='P' THEN 'new_region' WHEN o_orderdate::DATE BETWEEN a AND b THEN 'retrospective'
  WHEN o_orderdate::DATE>b AND o_orderdate::DATE<=b+28 THEN 'inference' ELSE 'rolling_update' END AS route FROM orders, lim) GROUP BY 1""")
def forecast_routes(spark, sf):
    from zonewise.sources.tables import day, table

    _, win = block_set(spark, sf)
    lim = win.filter("split = 'test'").agg(F.min("origin").alias("a"), F.max("origin").alias("b"))
    req = table(spark, sf, "orders").select(day("o_orderdate").alias("issue"), "o_orderstatus").withColumn("_l", one_row(lim))
    out = rolling.forecast_route(req, F.col("o_orderstatus") != "P", F.col("_l.a"), F.col("_l.b"))
    return out.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


_LIVE = """SELECT 0 AS sample_id, a.zone, iss.d AS origin, CAST(iss.d+7 AS DATE) AS target, a.rate AS anchor, ln(1+greatest(a.rate,0)) AS level, a.rate-b.rate AS step
   FROM iss JOIN p a ON a.date=iss.d JOIN p b ON b.date=iss.d-1 AND b.zone=a.zone"""
LIVE_SQL = f"""{model_sql()}, lu AS (SELECT max(u) AS u FROM upd), iss AS (SELECT max(date) AS d FROM p),
 {design_sql(_LIVE).replace('d0 ', 'l0 ').replace('d0.', 'l0.').replace('d1 ', 'l1 ').replace('cl AS', 'lv AS')},
 op AS (SELECT lv.zone, lv.origin, lv.target, lv.anchor+CASE WHEN ok THEN {SCORE} ELSE 0 END AS mu, sigma FROM lv JOIN lu ON true JOIN f2 USING (u) JOIN ga USING (u) JOIN sg USING (u, zone))"""


@query("operational_forecast", "E16 SW13 SW14 E11", f"{LIVE_SQL} SELECT zone, origin, target, {r6('mu')} AS mu, {r6('sigma')} AS sigma FROM op")
def operational_forecast(spark, sf):
    panel, win, ups, blocks = block_dates(spark, sf)
    last = one_row(ups.agg(F.max("update").alias("u")))["u"]
    live_blocks = blocks.filter(F.col("update") == last)
    out = rolling.run(block_cells(spark, sf, panel, win), live_blocks, FEATURES)
    issue = one_row(panel.agg(F.max("date").alias("d")))["d"]
    live = windows.operational_window(panel, zones_of(panel), issue, L, H).filter("complete")
    live = live.withColumns({"anchor": F.element_at("inputs", -1), "sample_id": F.lit(0), "update": last})
    scored = rolling.gated(designed(spark, sf, live), out["coef"], out["gate"], FEATURES).join(out["sigma"], ["update", "zone"])
    return rounded(scored.select("zone", "origin", "target", "mu", "sigma"))
