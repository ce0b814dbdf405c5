"""Cluster codes, regime cells and their agreement."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations, product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.quality import CELLS

DIMS = ("trend", "seasonality", "forecastability")
# Cluster codes in the order of the published cells, and the published counts of items.
CODES = (0, 2, 6, 8, 18, 20, 24, 26)
PUBLISHED_COUNTS = (166, 136, 170, 157, 159, 166, 169, 167)


def digits(code: Column) -> Column:
    """Three base-3 digits; a code outside 0 to 26 raises."""
    ok = code.between(0, 26)
    c = F.when(ok, code).otherwise(F.raise_error(F.lit("a code must lie within 0 and 26")).cast("int"))
    return F.array(F.floor(c / 9).cast("int"), F.pmod(F.floor(c / 3), F.lit(3)).cast("int"), F.pmod(c, F.lit(3)).cast("int"))


def cell_of(code: Column, digit_dims: Sequence[str] = DIMS, high: dict[str, int] | None = None) -> Column:
    """The cell of a code if its digits stand for these dimensions and these digits are high."""
    high = high or dict.fromkeys(DIMS, 0)
    d = digits(code)
    return F.concat_ws("_", *[F.concat(F.when(d[digit_dims.index(x)] == high[x], "high").otherwise("low"), F.lit(x[0].upper())) for x in DIMS])


def official_codebook(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CODES], "official_cluster_code int").withColumn("official_tsf_cell", cell_of(F.col("official_cluster_code")))


def agreement(left: Column, right: Column) -> Column:
    """Share of rows where both are equal, of those where the right is not null."""
    return F.coalesce(F.avg(F.when(right.isNotNull(), (left == right).cast("double"))), F.lit(0.0))


def direction_score(cells: Column, prefix: str, have: Sequence[str]) -> Column:
    """Share of measures whose median over high cells is at least that over low ones; missing ones are left out."""
    names = {"trend": "trend_strength", "seasonality": "seasonality_strength", "forecastability": "forecastability"}
    tests = []
    for k, d in enumerate(DIMS):
        m = f"{prefix}_{names[d]}"
        if m in have:
            x = F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))
            is_high = F.get(F.split(cells, "_"), F.lit(k)).startswith("high")
            tests.append(F.median(F.when(is_high, x)) >= F.median(F.when(~is_high, x)))
    ok = F.filter(F.array(*[t.cast("double") for t in tests]), lambda x: x.isNotNull())
    return F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda s, x: s + x) / F.size(ok)).otherwise(0.0)


def candidates(items: DataFrame) -> DataFrame:
    """The 48 readings of the codes, scored and ranked against items with code, two labellings and their measures."""
    readings = [(list(p), dict(zip(DIMS, h, strict=True))) for p in permutations(DIMS) for h in product((0, 2), repeat=3)]
    counts = items.groupBy("official_cluster_code").count()
    exact = counts.join(items.sparkSession.createDataFrame(list(zip(CODES, PUBLISHED_COUNTS, strict=True)), "official_cluster_code int, want long"), "official_cluster_code", "full")
    exact = exact.agg(F.coalesce(F.bool_and(F.col("count").eqNullSafe(F.col("want"))), F.lit(False)).alias("paper_item_counts_match"))
    # all readings of all 27 codes, a table of fixed size, stand for 48 expressions that would outgrow one generated method
    cells = items.sparkSession.createDataFrame([(c, k, _cell(c, p, h)) for c in range(27) for k, (p, h) in enumerate(readings)], "__code int, k int, cell string")
    code = F.when(F.col("official_cluster_code").between(0, 26), F.col("official_cluster_code")).otherwise(F.raise_error(F.lit("a code must lie within 0 and 26")).cast("int"))
    rows = items.withColumn("__code", code).join(F.broadcast(cells), "__code")
    s = rows.groupBy("k").agg(
        agreement(F.col("cell"), F.col("stl_tsf_cell")).alias("stl_item_exact_match_ratio"),
        agreement(F.col("cell"), F.col("proxy_tsf_cell")).alias("proxy_item_exact_match_ratio"),
        direction_score(F.col("cell"), "stl", items.columns).alias("stl_metric_direction_score"),
        direction_score(F.col("cell"), "proxy", items.columns).alias("proxy_metric_direction_score"),
    )
    by_code = [[_cell(c, p, h) for c in CODES] for p, h in readings]
    table = [(k, *p, h["trend"], h["seasonality"], h["forecastability"], by_code[k] == list(CELLS)) for k, (p, h) in enumerate(readings)]
    named = items.sparkSession.createDataFrame(table, "k int, digit_1_dim string, digit_2_dim string, digit_3_dim string, trend_high_digit int, seasonality_high_digit int, forecastability_high_digit int, paper_regime_order_match boolean")
    out = named.join(s, "k").crossJoin(exact).withColumn("paper_table_count_order_match", F.col("paper_regime_order_match") & F.col("paper_item_counts_match"))
    score = 100.0 * F.col("paper_table_count_order_match").cast("double") + 10.0 * F.col("stl_item_exact_match_ratio") + 5.0 * F.col("proxy_item_exact_match_ratio")
    out = out.withColumn("evidence_score", score + F.col("stl_metric_direction_score") + 0.5 * F.col("proxy_metric_direction_score"))
    # scores that are equal to nine digits are ties, whatever the order of their sums
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("paper_table_count_order_match"), F.desc(F.round("evidence_score", 9)), F.desc(F.round("stl_item_exact_match_ratio", 9)), "k")
    return out.withColumn("candidate_rank", F.row_number().over(w)).drop("k")


def _cell(code: int, dims: Sequence[str], high: dict[str, int]) -> str:
    d = (code // 9, code // 3 % 3, code % 3)
    return "_".join(("high" if d[list(dims).index(x)] == high[x] else "low") + x[0].upper() for x in DIMS)


def parts(cell: Column) -> Column:
    """The three parts of a label; three empty strings if it has not three."""
    s = F.split(cell, "_")
    return F.when(F.size(s) == 3, s).otherwise(F.array(F.lit(""), F.lit(""), F.lit("")))


def compare_with_codebook(items: DataFrame, codebook: DataFrame) -> DataFrame:
    """Items with the codebook's cell and whether it agrees as a whole and in each dimension; codes without cell keep nulls."""
    from strandline.operators.checks import ensure_unique_key

    book = ensure_unique_key(codebook.select("official_cluster_code", "official_tsf_cell"), ["official_cluster_code"], "codebook")
    j = items.join(F.broadcast(book), "official_cluster_code", "left")
    a, b = parts(F.col("tsf_cell")), parts(F.col("official_tsf_cell"))
    flags = {f"{d}_match": F.coalesce(a[k] == b[k], F.lit(False)) for k, d in enumerate(DIMS)}
    return j.withColumn("exact_match", F.coalesce(F.col("tsf_cell") == F.col("official_tsf_cell"), F.lit(False))).withColumns(flags)


def cluster_summary(compared: DataFrame) -> DataFrame:
    """Items, match rates and the most frequent cell (ties: the least) of each cluster."""
    rates = [F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in ("exact_match", *[f"{d}_match" for d in DIMS])]
    return compared.groupBy("official_cluster_code", "official_tsf_cell").agg(F.count("*").alias("items"), F.mode("tsf_cell", True).alias("mode_cell"), *rates)


def confusion(compared: DataFrame) -> DataFrame:
    """(official_tsf_cell, tsf_cell, items) of label pairs that occur, the long form of the matrix."""
    return compared.groupBy("official_tsf_cell", "tsf_cell").agg(F.count("*").alias("items"))


def confusion_matrix(compared: DataFrame) -> DataFrame:
    """The matrix over the cells in their order; cells without items have zeros."""
    return compared.groupBy("official_tsf_cell").pivot("tsf_cell", list(CELLS)).count().na.fill(0)


def mode_with_ratio(df: DataFrame, by: Sequence[str], column: str, name: str) -> DataFrame:
    """The most frequent label of each group (ties: the least), its share of labels that are not null, and its count."""
    n = df.filter(F.col(column).isNotNull()).groupBy(*by, column).count()
    w = Window.partitionBy(*by)
    r = n.withColumn("t", F.sum("count").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("count"), column))).filter("k = 1")
    return r.select(*by, F.col(column).alias(f"{name}_mode"), (F.col("count") / F.col("t")).alias(f"{name}_ratio"), F.col("count").alias(f"{name}_count"))


def agreement_count(a: Column, b: Column) -> Column:
    """Dimensions in which two labels agree."""
    return F.size(F.filter(F.zip_with(parts(a), parts(b), lambda x, y: (x == y) & (x != "")), lambda x: x))


def semantics(items: DataFrame) -> DataFrame:
    """A name and a confidence for each cluster from the most frequent labels of two measurements."""
    key = ["official_cluster_code"]
    j = mode_with_ratio(items, key, "stl_tsf_cell", "stl").join(mode_with_ratio(items, key, "proxy_tsf_cell", "proxy"), key)
    n = items.groupBy(*key).agg(F.count("*").alias("items"))
    same, dims = F.col("stl_mode") == F.col("proxy_mode"), agreement_count(F.col("stl_mode"), F.col("proxy_mode"))
    sure = F.when(same & (F.col("stl_ratio") >= 0.6) & (F.col("proxy_ratio") >= 0.6), "high").when(same, "medium").when((dims >= 2) & (F.col("stl_ratio") >= 0.5), "medium").otherwise("low")
    return j.join(n, key).withColumn("agreeing_dimensions", dims).withColumn("semantic_name", F.col("stl_mode")).withColumn("confidence", sure)


def semantics_with_quantiles(items: DataFrame) -> DataFrame:
    """The semantics with items of each subset and, for every measure of both measurements, its minimum, quartiles, maximum and mean."""
    from strandline.operators.quality import METRICS

    key, values = "official_cluster_code", [f"{n}_{m}" for n in ("stl", "proxy") for m in METRICS]
    sums, names = [], {"min": F.min, "max": F.max, "mean": F.avg}
    for v in values:
        x = F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double"))
        sums += [f(x).alias(f"{v}_{n}") for n, f in names.items()]
        sums += [F.percentile(x, F.lit(p)).alias(f"{v}_{n}") for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))]
    subsets = [F.count_if(F.col("subset") == s).alias(f"{s}_items") for s in ("hour", "min")]
    return semantics(items).join(items.groupBy(key).agg(*subsets, *sums), key)


def item_semantics(items: DataFrame) -> DataFrame:
    """Items with their cluster's name and confidence, and whether the two measurements, and the first and the name, agree."""
    named = semantics(items).select("official_cluster_code", "semantic_name", "confidence")
    out = items.join(named, "official_cluster_code", "left")
    return out.withColumn("stl_proxy_agree", F.col("stl_tsf_cell") == F.col("proxy_tsf_cell")).withColumn("cluster_semantic_match", F.col("stl_tsf_cell") == F.col("semantic_name"))


def move_status(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of a move manifest (old_path, new_path, ...) with the state of the move; ``paths`` lists those that exist."""
    there = paths.select("path").distinct()
    j = manifest.join(there.withColumn("__o", F.lit(True)).withColumnRenamed("path", "old_path"), "old_path", "left")
    j = j.join(there.withColumn("__n", F.lit(True)).withColumnRenamed("path", "new_path"), "new_path", "left")
    o, n = F.coalesce("__o", F.lit(False)), F.coalesce("__n", F.lit(False))
    state = F.when(o & ~n, "ready").when(~o & n, "done").when(o & n, "conflict").otherwise("missing")
    return j.withColumn("move_state", state).drop("__o", "__n")
