"""More queries of the window analytics, registered beside those of the catalog, each with the SQL that states it."""

from __future__ import annotations

from itertools import permutations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import audit, checks, codebook, experts, images, oracle, panel, proxy, quality, registry
from strandline.plans import adapters as D
from strandline.plans.catalog import MEDIAN, THRESHOLD, WINDOW, H, P, _errors, _items, _labelled, query, r6
from strandline.sources.tables import wide


# ---- panels, registries, keys ----


@query("SELECT subset, item_id, channel, round(trend_strength, 9) AS trend_strength FROM i, (SELECT unnest(['ind_1', 'ind_2', 'ind_3']) AS channel)", "i")
def channel_replicates(spark, d):
    return panel.replicate(_items(spark, d), D.CHANNELS).select("subset", "item_id", "channel", F.round("trend_strength", 9).alias("trend_strength"))


@query("SELECT CASE WHEN count(DISTINCT subset) = 1 THEN min(subset) END AS subset, 'reg' AS known FROM w", "w")
def single_values(spark, d):
    """One value of a column, or none if there are several."""
    r = D.registry(spark, d)
    one = checks.single_value(r.withColumn("known", F.lit("reg")), "known")
    return checks.single_value(r, "subset").crossJoin(one)


@query("SELECT subset, item_id, channel, count(*) AS rows, count(DISTINCT physical_window_id) AS windows, 1 AS items FROM w GROUP BY ALL", "w")
def item_channel_counts(spark, d):
    out = registry.audit_tables(D.registry(spark, d))["item_channel"]
    return out.select("subset", "item_id", "channel", "rows", "windows", F.col("items").cast("int").alias("items"))


@query(f"SELECT physical_window_id, {', '.join(f'round(yhat[{i + 1}], 6) AS yhat_{i}' for i in range(P))} FROM p WHERE expert_id = 'recent_mean'", "p")
def wide_predictions(spark, d):
    """Forecasts as numbered columns, found again in the order of their numbers."""
    w = wide(experts.predictions(D.windows(spark, d, target=False), ["recent_mean"]).select(WINDOW, "yhat"), "yhat", "yhat_", P)
    return w.select(WINDOW, *[r6(c) for c in checks.numbered(w.columns, "yhat_")])


@query("SELECT physical_window_id FROM w WHERE split = 'train'", "w")
def training_windows(spark, d):
    r = D.registry(spark, d)
    return checks.one_length(experts.training_rows(r.filter("split = 'train'"))).select(WINDOW)


@query("SELECT (SELECT count(*) FROM w) AS windows, count(*) AS proxy_rows, count(*) AS joined, (SELECT count(*) FROM w) - count(*) AS missing FROM w WHERE split != 'valid'", "w")
def proxy_coverage(spark, d):
    r = D.registry(spark, d)
    return audit.proxy_coverage(r, r.filter("split != 'valid'"))


def _split_sql(shares: dict[str, float], seed: int) -> str:
    cases, at = [], 0.0
    for name, share in shares.items():
        at += share
        cases.append(f"WHEN u < {at} THEN '{name}'")
    u = f"CAST(('0x' || substring(sha1('{seed}:' || subset || ':' || item_id), 1, 8)) AS BIGINT) / 4294967296e0"
    return f"SELECT subset, item_id, CASE {' '.join(cases)} END AS item_split FROM (SELECT subset, item_id, {u} AS u FROM n)"


SHARES = {"train": 0.5, "valid": 0.25, "test": 0.25}


@query(_split_sql(SHARES, 3), "n")
def item_disjoint_split(spark, d):
    return audit.item_split(panel.lengths(D.panel(spark, d)), SHARES, 3).select("subset", "item_id", "item_split")


# ---- scalers and inputs ----


@query(
    "SELECT subset, official_cluster, round(avg(x), 6) AS scaler_mean, round(stddev_pop(x) + 1e-8, 6) AS scaler_std FROM (SELECT s.subset, b.cluster AS official_cluster, unnest(s.vals[1 : b.e]) AS x FROM s JOIN b ON b.subset = s.subset AND b.item_id = s.item_id AND b.split = 'train') GROUP BY ALL",
    "s b",
)
def cell_scalers(spark, d):
    p = D.panel(spark, d)
    code = p.select("subset", "item_id", F.col("cluster").alias("official_cluster")).distinct()
    train = panel.split_lengths(p, D.CUTOFF).filter("split = 'train'").select("subset", "item_id", F.col("split_length").alias("train_length"))
    out = experts.train_scalers(D.series(spark, d).join(code, ["subset", "item_id"]), train, ["subset", "official_cluster"])
    return out.select("subset", "official_cluster", r6("scaler_mean"), r6("scaler_std"))


def _scalers(spark, d) -> DataFrame:
    train = panel.split_lengths(D.panel(spark, d), D.CUTOFF).filter("split = 'train'").select("subset", "item_id", F.col("split_length").alias("train_length"))
    return experts.train_scalers(D.series(spark, d), train).withColumns({c: F.round(c, 9) for c in ("scaler_mean", "scaler_std")})


SCALERS = "sc AS (SELECT subset, item_id, channel, round(avg(x), 9) AS sm, round(stddev_pop(x) + 1e-8, 9) AS ss FROM (SELECT s.subset, s.item_id, s.channel, unnest(s.vals[1 : b.e]) AS x FROM s JOIN b ON b.subset = s.subset AND b.item_id = s.item_id AND b.split = 'train') GROUP BY ALL)"


@query("SELECT physical_window_id, [round(CAST((CAST(x AS FLOAT) - CAST(sm AS FLOAT)) / CAST(ss AS FLOAT) AS DOUBLE), 4) for x in history] AS history, target AS raw_target FROM w JOIN sc USING (subset, item_id, channel) WHERE split = 'test'", "s b w", SCALERS)
def model_inputs(spark, d):
    w = D.windows(spark, d).filter("split = 'test'")
    return experts.model_inputs(w, _scalers(spark, d)).select(WINDOW, F.transform("history", lambda x: F.round(x, 4)).alias("history"), "raw_target")


@query("SELECT physical_window_id, [CAST(CAST(x AS FLOAT) AS DOUBLE) for x in history] AS history, target AS raw_target FROM w WHERE split = 'test'", "w")
def raw_model_inputs(spark, d):
    return experts.model_inputs(D.windows(spark, d).filter("split = 'test'")).select(WINDOW, "history", "raw_target")


@query("SELECT physical_window_id, target AS yhat FROM w WHERE split = 'valid'", "w")
def unscaled_targets(spark, d):
    """Targets scaled and brought back are those they were, to three digits."""
    w = experts.model_inputs(D.windows(spark, d).filter("split = 'valid'"), _scalers(spark, d))
    back = experts.unscale(F.col("target"), F.col("scaler_mean"), F.col("scaler_std"))
    return w.select(WINDOW, F.transform(back, lambda x: F.round(x, 3)).alias("yhat"))


# ---- missing and infinite values ----


@query(
    """SELECT subset, item_id, channel, round(miss, 6) AS missing_ratio, round(CASE WHEN sst < 1e-20 THEN 0 ELSE least(greatest(1 - (sst - ssr) / (sst + 1e-12), 0), 1) END, 6) AS trend_strength FROM (
  SELECT *, list_sum([x * x for x in c]) AS sst, (list_sum([c[i + 1] * (i - (n - 1) / 2e0) for i in range(n)]) ^ 2) / (n * (n * n - 1e0) / 12) AS ssr FROM (
    SELECT *, len(g) AS n, [x - list_sum(g) / len(g) for x in g] AS c FROM (
      SELECT subset, item_id, channel, len([x for x in v if x IS NULL]) / len(v) AS miss, [coalesce(x, list_avg(v)) for x in v] AS g FROM (
        SELECT subset, item_id, channel, [CASE WHEN i % 11 = 3 OR i % 13 = 5 THEN NULL ELSE vals[i + 1] END for i in range(len(vals))] AS v FROM s))))""",
    "s",
)
def gappy_quality(spark, d):
    """Series with NaN and null in places: these are filled with the mean of the others."""
    s = D.series(spark, d)
    gaps = F.transform("values", lambda x, i: F.when(i % 11 == 3, float("nan")).when(i % 13 == 5, F.lit(None)).otherwise(x))
    out = quality.quality(s.withColumn("values", gaps), D.PERIODS.column())
    return out.select("subset", "item_id", "channel", r6("missing_ratio"), r6("trend_strength"))


@query(
    f"""SELECT physical_window_id, round(list_avg(ok), 6) AS mean, round(sqrt(list_sum([(x - list_avg(ok)) ^ 2 for x in ok]) / len(ok)), 6) AS std, list_min(ok) AS min, list_max(ok) AS max,
  ok[len(ok)] AS last_value, round(1 - len(ok) / {H}e0, 6) AS missing_ratio, round(list_median(ok), 6) AS median, round(regr, 6) AS slope
  FROM (SELECT physical_window_id, [x for x in h if x IS NOT NULL] AS ok,
    (SELECT list_sum([(t - list_avg(ts)) * h[t + 1] for t in ts]) / list_sum([(t - list_avg(ts)) ^ 2 for t in ts])) AS regr
    FROM (SELECT *, [t for t in range({H}) if h[t + 1] IS NOT NULL] AS ts FROM (SELECT physical_window_id, [CASE WHEN i % 7 = 2 OR i % 9 = 4 THEN NULL ELSE history[i + 1] END for i in range({H})] AS h FROM w)))""",
    "w",
)
def gappy_proxy(spark, d):
    """Histories with NaN and infinities in places: features are those of the others."""
    w = D.windows(spark, d, target=False)
    gaps = F.transform("history", lambda x, i: F.when(i % 7 == 2, float("nan")).when(i % 9 == 4, float("inf")).otherwise(x))
    out = proxy.proxy_table(w.withColumn("history", gaps))
    return out.select(WINDOW, *[r6(c) for c in ("mean", "std", "min", "max", "last_value", "missing_ratio", "median", "slope")])


@query(
    f"""SELECT physical_window_id, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(any_value(rs), 6) AS recent_std_ratio, round(any_value(ap), 6) AS acf_period FROM (
  SELECT physical_window_id, unnest(history) AS x, rs, ap FROM (SELECT physical_window_id, history, sqrt(list_sum([(x - tm) ^ 2 for x in tl]) / 6) / (sqrt(sst / {H}) + 1e-8) AS rs,
    CASE WHEN sst > 1e-8 THEN list_sum([(history[k + 1] - m) * (history[k + 1 + period] - m) for k in range({H} - period)]) / sst ELSE 0 END AS ap FROM (
      SELECT *, list_sum([(x - m) ^ 2 for x in history]) AS sst, list_sum(tl) / 6 AS tm FROM (SELECT physical_window_id, period, history, list_sum(history) / {H} AS m, history[{H - 5}:{H}] AS tl FROM w)))) GROUP BY ALL""",
    "w",
)
def proxy_spread(spark, d):
    """The three features that light_proxy does not state, by built-in functions."""
    return proxy.proxy_table(D.windows(spark, d, target=False)).select(WINDOW, r6("iqr"), r6("recent_std_ratio"), r6("acf_period"))


# ---- views ----


def _normalized_sql() -> str:
    return f"""SELECT physical_window_id, period, [least(greatest((x - m) / greatest(sqrt(v + 1e-5) / 0.4, 1e-5), -5), 5) for x in history] AS z FROM (
  SELECT *, list_sum([(x - m) ^ 2 for x in history]) / {H} AS v FROM (SELECT physical_window_id, period, history, list_sum(history) / {H} AS m FROM w))"""


VIEW_SQL = f"z AS ({_normalized_sql()})"


@query(
    f"""SELECT physical_window_id, list(round(63 * least(greatest((z[k + 1] * (1 - f) + z[least(k + 2, {H})] * f + 5) / 10, 0), 1), 3) ORDER BY c) AS line
  FROM (SELECT physical_window_id, z, c, CAST(floor(c * {H - 1} / 191e0) AS INT) AS k, c * {H - 1} / 191e0 - floor(c * {H - 1} / 191e0) AS f FROM (SELECT physical_window_id, z, unnest(range(192)) AS c FROM z)) GROUP BY physical_window_id""",
    "w",
    VIEW_SQL,
)
def line_views(spark, d):
    """Of the line view of every window, where its ink lies in each of the 192 columns: the mean row, weighted by the values."""
    return images.ink(D.windows(spark, d, target=False).select(WINDOW, "period", "history")).select(WINDOW, F.transform("line", lambda x: F.round(x, 3)).alias("line"))


@query(
    f"""SELECT physical_window_id, list(round(least(greatest((x + 5) / 10, 0), 1), 4) ORDER BY c) AS fold FROM (
  SELECT physical_window_id, c, CASE WHEN c < {H} THEN z[c + 1] ELSE 0 END AS x FROM (SELECT physical_window_id, z, unnest(range(((({H} + period - 1) // period) * period))) AS c FROM z)) GROUP BY physical_window_id""",
    "w",
    VIEW_SQL,
)
def folded_views(spark, d):
    """Histories normalized, clipped, folded into cycles and scaled to [0, 1], before the picture is stretched."""
    w = D.windows(spark, d, target=False).select(WINDOW, "period", "history")
    return images.folded(w).select(WINDOW, F.transform("fold", lambda x: F.round(x, 4)).alias("fold"))


@query(
    f"""SELECT physical_window_id, list(round(CASE WHEN mx > 1e-5 THEN x / mx ELSE x / 1e-5 END, 4) ORDER BY k) AS power FROM (SELECT *, max(x) OVER (PARTITION BY physical_window_id) AS mx FROM (
  SELECT physical_window_id, k, CASE WHEN k = 0 THEN 0 ELSE ln(1 + list_sum([(z[i + 1] - m) * cos(2 * pi() * (k * i % {H}) / {H}) for i in range({H})]) ^ 2 + list_sum([(z[i + 1] - m) * sin(2 * pi() * (k * i % {H}) / {H}) for i in range({H})]) ^ 2) END AS x
  FROM (SELECT physical_window_id, z, list_sum(z) / {H} AS m, unnest(range({H // 2 + 1})) AS k FROM z))) GROUP BY physical_window_id""",
    "w",
    VIEW_SQL,
)
def power_views(spark, d):
    """The power view's spectrum before it is stretched: log of the power over its greatest."""
    return images.powers(D.windows(spark, d, target=False).select(WINDOW, "period", "history")).select(WINDOW, F.transform("power", lambda x: F.round(x, 4)).alias("power"))


# ---- caches, pathology, gates ----


@query("SELECT (SELECT count(*) FROM er WHERE split != 'train') AS prediction_rows, count(*) AS error_rows, true AS unique_prediction_key, true AS unique_error_key, (SELECT count(DISTINCT physical_window_id) FROM er WHERE split != 'train') AS prediction_windows, count(DISTINCT physical_window_id) AS error_windows, count(DISTINCT physical_window_id) FILTER (split != 'train') AS window_overlap, 'last_value,linear_trend,recent_mean,seasonal_naive' AS experts, 8 AS horizon, true AS horizon_matches_manifest FROM er", "er")
def cache_audit(spark, d):
    w = D.windows(spark, d)
    return audit.cache_audit(experts.predictions(w.filter("split != 'train'")), _errors(spark, d), P)


@query("SELECT physical_window_id, expert_id, [round(y, 6) for y in yhat] AS yhat, target FROM p WHERE expert_id = 'linear_trend'", "p")
def checked_predictions(spark, d):
    w = D.windows(spark, d)
    out = audit.checked_predictions(experts.predictions(w, ["linear_trend"]).select(WINDOW, "expert_id", "yhat"), w)
    return out.select(WINDOW, "expert_id", F.transform("yhat", lambda x: F.round(x, 6)).alias("yhat"), "target")


@query("SELECT expert_id, std_bin, count(*) AS windows, round(avg(mse), 6) AS mean_mse, round(max(mse), 6) AS max_mse, round(sum(mse) / any_value(t), 6) AS mse_share FROM (SELECT *, sum(mse) OVER (PARTITION BY expert_id) AS t FROM (SELECT er.*, CAST(floor(log10(ss)) AS INT) AS std_bin FROM er JOIN sc USING (subset, item_id, channel))) GROUP BY expert_id, std_bin", "s b er", SCALERS)
def errors_by_std_bin(spark, d):
    e = _errors(spark, d).join(_scalers(spark, d), ["subset", "item_id", "channel"])
    return audit.by_std_bin(e).select("expert_id", "std_bin", "windows", r6("mean_mse"), r6("max_mse"), r6("mse_share"))


@query("SELECT expert_id, top, round(sum(m) / any_value(t), 6) AS mse_share, round(min(m), 6) AS least_mse FROM (SELECT expert_id, m, row_number() OVER (PARTITION BY expert_id ORDER BY m DESC, physical_window_id) AS k, sum(m) OVER (PARTITION BY expert_id) AS t FROM (SELECT expert_id, physical_window_id, round(mse, 9) AS m FROM er)), (SELECT unnest([1, 10, 100]) AS top) WHERE k <= top GROUP BY expert_id, top", "er")
def outlier_contribution(spark, d):
    e = _errors(spark, d).withColumn("mse", F.round("mse", 9))
    return audit.outlier_contribution(e).select("expert_id", "top", r6("mse_share"), r6("least_mse"))


@query(
    """SELECT gate, split, count(*) AS windows, round(avg(kl), 6) AS kl, round(avg(g), 6) AS mean_mse, round(avg(h), 6) + 0e0 AS gate_entropy, round((any_value(bf) - avg(g)) / (any_value(bf) - avg(o)), 6) + 0e0 AS gap_reduction FROM (
  SELECT gate, split, physical_window_id, sum(CASE WHEN q > 0 THEN q * (ln(q + 1e-8) - ln(gw + 1e-8)) ELSE 0 END) AS kl, sum(gw * mse) AS g, sum(-gw * ln(gw + 1e-8)) AS h, min(mse) AS o FROM (
    SELECT qq.*, x.gate, CASE WHEN x.gate = 'uniform' THEN 0.25e0 WHEN expert_id = best THEN 1e0 ELSE 0e0 END AS gw FROM qq, bb, (SELECT unnest(['uniform', 'fixed_best']) AS gate) x) GROUP BY ALL)
  JOIN (SELECT split, min(m) AS bf FROM (SELECT split, expert_id, avg(mse) AS m FROM er GROUP BY ALL) GROUP BY ALL) USING (split) GROUP BY gate, split""",
    "rk er",
    """qq AS (SELECT physical_window_id, split, expert_id, mse, e / greatest(sum(e) OVER (PARTITION BY physical_window_id), 1e-8) AS q FROM rk),
bb AS (SELECT min({'m': m, 'e': expert_id}).e AS best FROM (SELECT expert_id, avg(mse) AS m FROM er GROUP BY ALL))""",
)
def gate_baselines(spark, d):
    e = _errors(spark, d)
    out = audit.gate_report(e, audit.baseline_gates(e), ["split"])
    return out.select("gate", "split", "windows", r6("kl"), r6("mean_mse"), r6("gate_entropy"), r6("gap_reduction"))


@query(
    f"""SELECT split, count(*) AS windows, round(avg(m), 6) AS mse FROM (SELECT b.split, list_sum([(s.vals[t + 1 + i] - s.vals[t - p + 1 + i % p]) ^ 2 for i in range({P})]) / {P} AS m
  FROM (SELECT *, CASE subset WHEN 'hour' THEN 4 ELSE 13 END AS p FROM b WHERE item_id IN (1, 2)) b, unnest(range(CASE WHEN b.split = 'train' THEN b.s + {H} ELSE b.s END, b.e - {P} + 1)) u(t)
  JOIN s ON s.subset = b.subset AND s.item_id = b.item_id) GROUP BY split""",
    "b s",
)
def dense_naive(spark, d):
    """The seasonal naive expert over all windows of two items, one at each step."""
    config = registry.RegistryConfig(**{**D.CONFIG.__dict__, "sample_stride": 1})
    w = registry.build_registry(D.panel(spark, d).filter("item_id in (1, 2)"), codebook.official_codebook(spark), config, D.PERIODS, values=("history", "target"))
    e = experts.error_table(w, ["seasonal_naive"])
    out = oracle.weighted_mean(e, F.col("mse"), F.lit(1), ["split"])
    return out.select("split", F.col("samples").alias("windows"), F.round("value", 6).alias("mse"))


# ---- codebook ----

LABELLED = f"lb AS (SELECT n.cluster AS code, i.subset, i.item_id, {MEDIAN} AS proxy, {THRESHOLD} AS stl, trend_strength AS t, seasonality_strength AS s, forecastability AS f FROM i JOIN n USING (subset, item_id))"


def _candidates_sql() -> str:
    """All readings of the codes: which digit stands for which dimension, and which of 0 and 2 is high in each."""
    dims = ("trend", "seasonality", "forecastability")
    rows = []
    for k, (order, high) in enumerate((o, h) for o in permutations(dims) for h in product((0, 2), repeat=3)):
        named = dict(zip(dims, high, strict=True))
        rows.append(f"({k}, '{order[0]}', '{order[1]}', '{order[2]}', {named['trend']}, {named['seasonality']}, {named['forecastability']})")
    digit = lambda x: f"CASE '{x}' WHEN d1 THEN code // 9 WHEN d2 THEN code // 3 % 3 ELSE code % 3 END = {x[0]}h"
    cell = "concat_ws('_', " + ", ".join(f"CASE WHEN {digit(x)} THEN 'high{x[0].upper()}' ELSE 'low{x[0].upper()}' END" for x in dims) + ")"
    ok = [f"median(CASE WHEN starts_with(split_part(cell, '_', {k + 1}), 'high') THEN {x[0]} END) >= median(CASE WHEN NOT starts_with(split_part(cell, '_', {k + 1}), 'high') THEN {x[0]} END)" for k, x in enumerate(dims)]
    tests = f"[x for x in [{', '.join(f'CAST({t} AS DOUBLE)' for t in ok)}] if x IS NOT NULL]"
    order = ["highT_highS_highF", "highT_highS_lowF", "highT_lowS_highF", "highT_lowS_lowF", "lowT_highS_highF", "lowT_highS_lowF", "lowT_lowS_highF", "lowT_lowS_lowF"]
    published = "[(0, 166), (2, 136), (6, 170), (8, 157), (18, 159), (20, 166), (24, 169), (26, 167)]"
    return f"""{LABELLED}, rd(k, d1, d2, d3, th, sh, fh) AS (VALUES {', '.join(rows)}),
cl AS (SELECT *, {cell} AS cell FROM rd, (SELECT unnest(range(27)) AS code)),
rm AS (SELECT k, list(cell ORDER BY code) = {order!r} AS regime FROM cl WHERE code IN (0, 2, 6, 8, 18, 20, 24, 26) GROUP BY k),
cc AS (SELECT coalesce(bool_and(n IS NOT DISTINCT FROM want), false) AS counts FROM (SELECT code, count(*) AS n FROM lb GROUP BY ALL) FULL JOIN (SELECT v[1] AS code, v[2] AS want FROM (SELECT unnest({published.replace('(', '[').replace(')', ']')}) AS v)) USING (code)),
ev AS (SELECT k, coalesce(avg(CAST(cell = stl AS DOUBLE)), 0) AS a, coalesce(avg(CAST(cell = proxy AS DOUBLE)), 0) AS b, {tests} AS ok FROM lb JOIN cl USING (code) GROUP BY k),
sc AS (SELECT rd.*, regime AND counts AS m, a, 10 * a + 5 * b + 1.5e0 * CASE WHEN len(ok) > 0 THEN list_sum(ok) / len(ok) ELSE 0 END + 100 * CAST(regime AND counts AS DOUBLE) AS score FROM rd JOIN rm USING (k) JOIN ev USING (k), cc)"""


@query(
    "SELECT CAST(row_number() OVER (ORDER BY m DESC, round(score, 9) DESC, round(a, 9) DESC, k) AS INT) AS candidate_rank, d1 AS digit_1_dim, d2 AS digit_2_dim, d3 AS digit_3_dim, th AS trend_high_digit, sh AS seasonality_high_digit, fh AS forecastability_high_digit, round(score, 6) AS evidence_score FROM sc",
    "i n",
    _candidates_sql(),
)
def codebook_candidates(spark, d):
    return codebook.candidates(_labelled(spark, d)).select("candidate_rank", "digit_1_dim", "digit_2_dim", "digit_3_dim", "trend_high_digit", "seasonality_high_digit", "forecastability_high_digit", r6("evidence_score"))


def _quantiles_sql() -> str:
    out = []
    for source in ("stl", "proxy"):
        for name, x in (("trend_strength", "t"), ("seasonality_strength", "s"), ("forecastability", "f")):
            out += [f"round(min({x}), 6) AS {source}_{name}_min", f"round(max({x}), 6) AS {source}_{name}_max", f"round(avg({x}), 6) AS {source}_{name}_mean"]
            out += [f"round(quantile_cont({x}, {p}), 6) AS {source}_{name}_{n}" for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))]
    return ", ".join(out)


@query(f"SELECT code AS official_cluster_code, count(*) AS items, count(*) FILTER (subset = 'hour') AS hour_items, count(*) FILTER (subset = 'min') AS min_items, {_quantiles_sql()} FROM lb GROUP BY code", "i n", LABELLED)
def semantics_quantiles(spark, d):
    out = codebook.semantics_with_quantiles(_labelled(spark, d))
    numbers = [f"{n}_{m}_{q}" for n in ("stl", "proxy") for m in quality.METRICS for q in ("min", "p25", "p50", "p75", "max", "mean")]
    return out.select("official_cluster_code", "items", "hour_items", "min_items", *map(r6, numbers))


@query(
    """SELECT subset, item_id, code AS official_cluster_code, mode AS semantic_name, stl = proxy AS stl_proxy_agree, stl = mode AS cluster_semantic_match FROM lb JOIN (
  SELECT code, stl AS mode FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY c DESC, stl) AS k FROM (SELECT code, stl, count(*) AS c FROM lb GROUP BY ALL)) WHERE k = 1) USING (code)""",
    "i n",
    LABELLED,
)
def item_semantics(spark, d):
    return codebook.item_semantics(_labelled(spark, d)).select("subset", "item_id", "official_cluster_code", "semantic_name", "stl_proxy_agree", "cluster_semantic_match")


PATHS = [(i, f"old/{i}", f"new/{i}") for i in range(8)]


@query("SELECT CAST(i AS BIGINT) AS i, CASE WHEN i % 2 = 0 AND i % 4 < 2 THEN 'ready' WHEN i % 2 = 1 AND i % 4 >= 2 THEN 'done' WHEN i % 2 = 0 AND i % 4 >= 2 THEN 'conflict' ELSE 'missing' END AS move_state FROM range(8) t(i)")
def move_states(spark, d):
    """Where old paths with even numbers and new ones with the upper half of each four exist."""
    manifest = spark.createDataFrame(PATHS, "i long, old_path string, new_path string")
    there = [(o,) for i, o, _ in PATHS if i % 2 == 0] + [(n,) for i, _, n in PATHS if i % 4 >= 2]
    return codebook.move_status(manifest, spark.createDataFrame(there, "path string")).select("i", "move_state")


# ---- windows as long as the published ones ----


def _long(name: str) -> str:
    """The SQL of daily windows of 192 and 96 days of groups of suppliers."""
    return f"""dp AS (SELECT l_suppkey % 64 AS item_id, CASE WHEN l_suppkey % 64 % 2 = 0 THEN 'hour' ELSE 'min' END AS subset, date_trunc('day', l_shipdate) AS date_time, sum(l_quantity) AS ind_1, CAST(count(*) AS DOUBLE) AS ind_2, CAST(max(l_linenumber) AS DOUBLE) AS ind_3 FROM lineitem GROUP BY ALL),
dn AS (SELECT item_id, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (date_time < TIMESTAMP '{D.CUTOFF}') AS INT) AS pre FROM dp GROUP BY ALL),
ds AS (SELECT item_id, subset, channel, list(value ORDER BY date_time) AS vals FROM (SELECT * FROM dp UNPIVOT (value FOR channel IN (ind_1, ind_2, ind_3))) GROUP BY ALL),
db AS (SELECT item_id, v.split, v.s, v.e FROM (SELECT *, pre - CAST(floor(pre * 0.2) AS INT) AS cut FROM dn) q, LATERAL (SELECT unnest([{{'split': 'train', 's': 0, 'e': cut}}, {{'split': 'valid', 's': cut, 'e': pre}}, {{'split': 'test', 's': pre, 'e': n}}]) AS v)),
{name} AS (SELECT ds.subset, db.item_id, ds.channel, db.split, CASE ds.subset WHEN 'hour' THEN 4 ELSE 13 END AS period, ds.vals[t - 191 : t] AS history, ds.vals[t + 1 : t + 96] AS target FROM db JOIN ds ON ds.item_id = db.item_id, unnest(range(CASE WHEN db.split = 'train' THEN db.s + 192 ELSE db.s END, db.e - 95, 8)) u(t))"""


@query("SELECT subset, item_id, channel, split, count(*) AS windows, round(avg(list_sum([(target[i + 1] - history[192 - period + 1 + i % period]) ^ 2 for i in range(96)]) / 96), 9) AS mse FROM lw GROUP BY ALL", "", _long("lw"))
def long_errors(spark, d):
    """Seasonal errors of windows of 192 and 96 values."""
    e = experts.error_table(D.long_windows(spark, d)).filter("expert_id = 'seasonal_naive'")
    return e.groupBy("subset", "item_id", "channel", "split").agg(F.count("*").alias("windows"), F.round(F.avg("mse"), 9).alias("mse"))


@query("SELECT subset, item_id, channel, split, round(avg(list_avg(history)), 9) AS mean, round(avg(list_max(history) - list_min(history)), 9) AS amplitude FROM lw GROUP BY ALL", "", _long("lw"))
def long_proxy(spark, d):
    """All features of histories of 192 values by the batched kernel; two of them, averaged, are stated."""
    f = proxy.proxy_batches(D.long_windows(spark, d, target=False))
    return f.groupBy("subset", "item_id", "channel", "split").agg(F.round(F.avg("mean"), 9).alias("mean"), F.round(F.avg("amplitude"), 9).alias("amplitude"))
