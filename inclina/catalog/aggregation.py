"""Queries over aggregates, windows, sorts, reshaping and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from inclina.catalog import entities as e
from inclina.catalog.base import longs, query, rounded
from inclina.functions.aggregates import strict_sum
from inclina.functions.columns import tenure_flag
from inclina.operators.aggregates import (
    cutpoint_profile,
    group_median,
    long_to_wide,
    means_covariance,
    prop_table,
    quantile_rows,
    stats_by_group,
    two_way_counts,
    value_frequency,
    variation_by_group,
    wide_to_long,
)
from inclina.operators.evaluate import mid_ranks
from inclina.operators.ordering import top_per_group
from inclina.operators.profile import (
    any_incomplete,
    bar_counts,
    class_quantiles,
    correlation_matrix,
    cumulative_distribution,
    histogram,
    missing_from_long,
    missing_profile,
    table_profile,
)
from inclina.plans import customer, daily, monthly

M = ", ".join(f"round({m}, 6) AS {m}" for m in daily.MEASURES)

# ---- aggregates ------------------------------------------------------------------------------


@query("daily_rollup", f"SELECT id_cliente, fecha, {M} FROM rollup", ["rollup"])
def _(t):
    return rounded(daily.daily_rollup(e.movements(t)))


@query("row_counts", "SELECT producto, NOM_PRODUCTO, count(*) AS n FROM classified GROUP BY 1, 2", ["classified"])
def _(t):
    return two_way_counts(daily.classify_openings(e.openings(t)), "producto", "NOM_PRODUCTO")


@query(
    "distinct_customers",
    "SELECT grupo, tenencia_tdc, count(DISTINCT id_cliente) AS n FROM panel GROUP BY 1, 2",
    ["panel"],
)
def _(t):
    panel = daily.daily_panel(e.movements(t), e.openings(t))
    return panel.groupBy("grupo", "tenencia_tdc").agg(F.countDistinct("id_cliente").alias("n"))


@query("mean_salary", "SELECT ID_CLIENTE, DESC_PROFESION, round(salario, 6) AS salario FROM salaries", ["salaries"])
def _(t):
    return rounded(monthly.mean_salaries(e.customers(t)))


@query("life_medians", "SELECT RELACION1, round(vida_util, 6) AS vida_util FROM life_medians", ["life_medians"])
def _(t):
    return rounded(monthly.life_medians(e.customers(t)))


@query(
    "occupation_medians",
    "SELECT ID_CLIENTE, OCUPACIONES, round(salario, 6) AS salario, round(mediana, 6) AS mediana FROM occupation_medians",
    ["occupation_medians"],
)
def _(t):
    done = monthly.occupation_medians(e.customers(t), e.occupations(t))
    return rounded(done.select("ID_CLIENTE", "OCUPACIONES", "salario", "mediana"))


@query(
    "customer_labels",
    """SELECT id_cliente, CASE WHEN count(*) = count(tenencia) AND min(tenencia) = 1 THEN '1' ELSE '2' END AS tenencia_min,
    min(tenencia_tdc) AS tenencia_tdc_min, min(tenencia_pp) AS tenencia_pp_min, min(tenencia_dpf) AS tenencia_dpf_min
    FROM panel GROUP BY id_cliente""",
    ["panel"],
)
def _(t):
    return daily.labels_of(e.movements(t), e.openings(t))


@query(
    "product_quantiles",
    """SELECT producto, n, p, round(q, 6) AS q FROM (SELECT producto, count(*) AS n, unnest([0.25, 0.5, 0.75]) ::DOUBLE AS p,
    unnest(quantile_cont(meses, [0.25, 0.5, 0.75])) AS q FROM counted GROUP BY producto)""",
    ["counted"],
)
def _(t):
    panel = daily.counted_panel(e.movements(t), e.openings(t))
    return rounded(quantile_rows(panel, ["producto"], "meses", [0.25, 0.5, 0.75]))


PROBS = [0.1, 0.15, 0.17, 0.2, 0.25, 0.3, 0.5, 0.75, 0.8, 0.9]


@query(
    "cutpoint_profile",
    """SELECT statistic, round(value, 6) AS value FROM (SELECT 'mean' AS statistic, avg(saldo) AS value FROM movements
    UNION ALL SELECT 'sd', stddev_samp(saldo) FROM movements """
    + " ".join(f"UNION ALL SELECT 'q{100 * p:g}', quantile_cont(saldo, {p}) FROM movements" for p in PROBS)
    + ")",
    ["movements"],
)
def _(t):
    return rounded(cutpoint_profile(e.movements(t), "saldo", PROBS))


@query("customer_maximum", "SELECT id_cliente, max(saldo) AS saldo FROM movements GROUP BY 1", ["movements"])
def _(t):
    return e.movements(t).groupBy("id_cliente").agg(F.max("saldo").alias("saldo"))


@query(
    "month_by_flag",
    "SELECT anomes_producto, tenencia, count(*) AS n FROM counted GROUP BY 1, 2",
    ["counted"],
)
def _(t):
    return longs(two_way_counts(daily.counted_panel(e.movements(t), e.openings(t)), "anomes_producto", "tenencia"))


@query(
    "prop_table",
    """SELECT N_TC, N_BANCOS_DISC, CAST(round_even(count(*) / sum(count(*)) OVER (), 2) AS DOUBLE) AS prop FROM
    (SELECT CASE WHEN N_TC = 0 THEN 'No' ELSE 'Si' END AS N_TC, CASE WHEN N_BANCOS <= 2 THEN 'N_BANCOS <= 2' ELSE 'N_BANCOS > 2' END AS N_BANCOS_DISC
    FROM customers) GROUP BY 1, 2""",
    ["customers"],
)
def _(t):
    return prop_table(customer.cut_bins(customer.flag_holdings(e.customers(t))), "N_TC", "N_BANCOS_DISC")


@query("value_frequency", "SELECT rating, count(*) AS n FROM ratings GROUP BY 1", ["ratings"])
def _(t):
    return value_frequency(e.ratings(t), "rating")


@query(
    "measure_stats",
    """SELECT event_type, round(avg(value), 6) AS media, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1 ORDER BY 2 DESC""",
)
def _(t):
    """Mean and sd per group, highest mean first (the importance table's shape)."""
    done = t("events").groupBy("event_type").agg(F.avg("value").alias("media"), F.stddev_samp("value").alias("sd"))
    return rounded(done).orderBy(F.desc("media"))


@query(
    "group_means",
    "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS o_totalprice, round(avg(o_custkey), 4) AS o_custkey FROM orders GROUP BY 1",
)
def _(t):
    return rounded(stats_by_group(t("orders"), ["o_orderstatus"], ["o_totalprice", "o_custkey"], "mean"), 4)


@query(
    "group_medians",
    """SELECT o_orderstatus, round(median(o_totalprice), 6) AS o_totalprice, median(o_custkey) AS o_custkey FROM orders GROUP BY 1""",
)
def _(t):
    return rounded(stats_by_group(t("orders"), ["o_orderstatus"], ["o_totalprice", "o_custkey"], "median"))


@query(
    "group_variances",
    "SELECT event_type, round(var_samp(value), 6) AS value FROM events GROUP BY 1",
)
def _(t):
    return rounded(stats_by_group(t("events"), ["event_type"], ["value"], "variance"))


@query(
    "variation_by_group",
    """SELECT RELACION1, count(*) AS n, round(avg(SALARIO), 6) AS mean, round(100 * stddev_samp(SALARIO) / avg(SALARIO), 6) AS variation,
    round(avg(SALARIO) / count(*), 6) AS mean_per_row, round(median(SALARIO), 6) AS median FROM customers GROUP BY 1""",
    ["customers"],
)
def _(t):
    return rounded(variation_by_group(e.customers(t), ["RELACION1"], "SALARIO"))


@query(
    "column_sums",
    """SELECT round(sum(saldo), 2) AS plain, CASE WHEN count(*) = count(creditos_monto) THEN sum(creditos_monto) END AS strict,
    round(sum(creditos_monto), 2) AS skipped FROM movements""",
    ["movements"],
)
def _(t):
    done = e.movements(t).agg(
        F.sum("saldo").alias("plain"), strict_sum("creditos_monto").alias("strict"), F.sum("creditos_monto").alias("skipped")
    )
    return rounded(done, 2)


@query(
    "means_covariance",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(avg({a}), 6) AS mean_a, round(avg({b}), 6) AS mean_b, round(covar_samp({a}, {b}), 3) AS covariance FROM lineitem"
        for a in ("l_quantity", "l_extendedprice")
        for b in ("l_quantity", "l_extendedprice")
    ),
)
def _(t):
    done = means_covariance(t("lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(rounded(done, 3, ["covariance"]))


# ---- windows ---------------------------------------------------------------------------------


@query("row_counter", "SELECT id_cliente, fecha, NO_CREDITO, meses FROM counted", ["counted"])
def _(t):
    return longs(daily.counted_panel(e.movements(t), e.openings(t)).select("id_cliente", "fecha", "NO_CREDITO", "meses"))


@query(
    "group_quantiles",
    "SELECT producto, round(p25, 6) AS percentil_25, round(p50, 6) AS percentil_50, round(p75, 6) AS percentil_75 FROM product_quartiles",
    ["product_quartiles"],
)
def _(t):
    return rounded(daily.duration_quantiles(daily.counted_panel(e.movements(t), e.openings(t))))


@query("credit_max", "SELECT id_cliente, fecha, NO_CREDITO, max_mes FROM longest", ["longest"])
def _(t):
    return daily.counted_panel(e.movements(t), e.openings(t)).select("id_cliente", "fecha", "NO_CREDITO", "max_mes")


DAILY_SQL = (
    f"SELECT NO_CREDITO, id_cliente, {M}, tenencia, tenencia_tdc, tenencia_pp, tenencia_dpf, max_mes, grupo, anomes_producto FROM panel"
)


@query("daily_panel", DAILY_SQL, ["panel"])
def daily_panel(t):
    return rounded(longs(daily.daily_panel(e.movements(t), e.openings(t))))


@query("customers_once", "SELECT DISTINCT identificacion FROM ratings", ["ratings"])
def _(t):
    return e.ratings(t).select("identificacion").distinct()


@query(
    "first_movement",
    """SELECT id_cliente, fecha, saldo FROM movements QUALIFY row_number() OVER (PARTITION BY id_cliente ORDER BY fecha, saldo) = 1""",
    ["movements"],
)
def _(t):
    rows = e.movements(t).select("id_cliente", "fecha", "saldo")
    return top_per_group(rows, ["id_cliente"], [F.asc("fecha"), F.asc("saldo")], 1).drop("rank")


@query(
    "score_ranks",
    """SELECT score, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (count(*) + 1) / 2.0 AS mid_rank
    FROM scored GROUP BY score""",
    ["scored"],
)
def _(t):
    return mid_ranks(e.scored(t), "score")


# ---- sorts, top-k, sets, reshape -------------------------------------------------------------


@query(
    "sorted_days",
    "SELECT id_cliente, fecha, round(saldo, 6) AS saldo FROM rollup ORDER BY id_cliente, fecha",
    ["rollup"],
)
def _(t):
    return rounded(daily.daily_rollup(e.movements(t)).select("id_cliente", "fecha", "saldo")).orderBy("id_cliente", "fecha")


@query("argmax_row", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def _(t):
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b")
    return t("orders").agg(best).select((-F.col("b.k")).alias("o_orderkey"), F.col("b.o_totalprice").alias("o_totalprice"))


@query(
    "topk_per_group",
    """SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3""",
)
def _(t):
    rows = t("part").select("p_brand", "p_partkey", "p_retailprice")
    return top_per_group(rows, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3).drop("rank")


@query(
    "bound_subsets",
    """SELECT o_orderkey, 'F' AS part FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'O' FROM orders WHERE o_orderstatus = 'O'""",
)
def _(t):
    rows = t("orders")
    part = lambda s: rows.where(F.col("o_orderstatus") == s).select("o_orderkey", F.lit(s).alias("part"))
    return part("F").unionByName(part("O"))


BRANDS = ["Brand#1", "Brand#2", "Brand#3"]


@query(
    "ratings_wide",
    "SELECT identificacion, "
    + ", ".join(f"max(rating) FILTER (producto1 = '{b}') AS \"{b}\"" for b in BRANDS)
    + " FROM ratings GROUP BY identificacion",
    ["ratings"],
)
def _(t):
    return long_to_wide(e.ratings(t), ["identificacion"], "producto1", "rating", BRANDS)


@query(
    "wide_to_long",
    " UNION ALL ".join(
        f"SELECT ID_CLIENTE, '{c}' AS variable, {c} AS valor FROM customers" for c in ("GENERO", "ESTADO_CIVIL", "JUBILADO")
    ),
    ["customers"],
)
def _(t):
    return wide_to_long(e.customers(t), ["ID_CLIENTE"], ["GENERO", "ESTADO_CIVIL", "JUBILADO"])


# ---- profiles --------------------------------------------------------------------------------

PROFILED = ["SALARIO", "VIDA", "SALDO_CA", "N_PP", "G_MAIL"]


@query(
    "table_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count(*) AS n, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd,
        min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
        max({c}) AS max, count(DISTINCT {c}) AS "distinct" FROM customers"""
        for c in PROFILED
    ),
    ["customers"],
)
def _(t):
    return rounded(table_profile(e.customers(t), PROFILED))


@query(
    "missing_profile",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_miss, round(100.0 * (count(*) - count({c})) / count(*), 6) AS pct_miss FROM customers"
        for c in ("ID_CLIENTE", "SALARIO", "VIDA", "N_PP", "GENERO", "JUBILADO", "G_MAIL")
    )
    + ")",
    ["customers"],
)
def _(t):
    return rounded(
        missing_profile(e.customers(t).select("ID_CLIENTE", "SALARIO", "VIDA", "N_PP", "GENERO", "JUBILADO", "G_MAIL"))
    )


@query(
    "missing_from_long",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, round(100.0 * (count(*) - count({c})) / count(*), 6) AS pct_miss FROM customers"
        for c in ("GENERO", "ESTADO_CIVIL", "JUBILADO")
    ),
    ["customers"],
)
def _(t):
    return rounded(missing_from_long(wide_to_long(e.customers(t), ["ID_CLIENTE"], ["GENERO", "ESTADO_CIVIL", "JUBILADO"])))


@query("any_incomplete", "SELECT coalesce(bool_or(SALARIO IS NULL OR VIDA IS NULL), false) AS any_incomplete FROM customers", ["customers"])
def _(t):
    return any_incomplete(e.customers(t).select("SALARIO", "VIDA"))


@query(
    "bar_counts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, CASE WHEN {c} = 0 THEN 'No' WHEN {c} <> 0 THEN 'Si' END AS value, count(*) AS n
        FROM customers GROUP BY 2"""
        for c in ("G_FUGA", "G_MAIL")
    ),
    ["customers"],
)
def _(t):
    flags = e.customers(t).select(tenure_flag("G_FUGA").alias("G_FUGA"), tenure_flag("G_MAIL").alias("G_MAIL"))
    return bar_counts(flags, ["G_FUGA", "G_MAIL"])


def _bins_sql(column: str, bins: int) -> str:
    x = f"CASE WHEN {column} > 0 THEN log10({column}) END"
    return f"""SELECT '{column}' AS variable, least(CAST(floor((x - lo) / ((hi - lo) / {bins})) AS BIGINT), {bins - 1}) AS bin, count(*) AS n
    FROM (SELECT {x} AS x FROM customers), (SELECT min({x}) AS lo, max({x}) AS hi FROM customers) WHERE x IS NOT NULL GROUP BY 2"""


@query("histogram_log10", " UNION ALL ".join(_bins_sql(c, 20) for c in ("SALDO_CA", "SALDOS_VISTA_6M")), ["customers"])
def _(t):
    return longs(histogram(e.customers(t), ["SALDO_CA", "SALDOS_VISTA_6M"], 20, log10=True))


@query(
    "correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem"
        for a in ("l_quantity", "l_extendedprice", "l_discount")
        for b in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def _(t):
    return rounded(correlation_matrix(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).drop("p"))


@query("embedding_correlations")
def _(t):
    """Correlation matrix with p-values of the embedding dimensions."""
    wide, names = e.wide_embeddings(t)
    return correlation_matrix(wide, names)


@query(
    "class_quantiles",
    """SELECT o_orderstatus, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 6) AS q0, round(quantile_cont(o_totalprice, 0.5), 6) AS q1,
    round(quantile_cont(o_totalprice, 0.75), 6) AS q2 FROM orders GROUP BY 1""",
)
def _(t):
    return rounded(class_quantiles(t("orders"), "o_orderstatus", "o_totalprice", [0.25, 0.5, 0.75]))


@query(
    "ecdf_by_class",
    """SELECT l_returnflag, l_quantity, round(sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS ecdf
    FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    return rounded(cumulative_distribution(t("lineitem"), "l_quantity", ["l_returnflag"]), columns=["ecdf"])


@query(
    "brand_median",
    "SELECT p_brand, round(median(p_retailprice), 6) AS mediana FROM part GROUP BY 1",
)
def _(t):
    return rounded(group_median(t("part"), ["p_brand"], "p_retailprice", "mediana"))

