"""Queries over sources, projections, column functions and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from inclina.catalog import entities as e
from inclina.catalog.base import Tables, longs, query, rounded
from inclina.functions.columns import (
    apply_types,
    is_in,
    log_value,
    map_columns,
    nullify,
    parse_decimal,
    year_month_label,
)
from inclina.operators.joins import align_columns, attach_checked, distinct_lookup, left_join_ns, semi_join_ns
from inclina.operators.projection import (
    complete_cases,
    feature_columns,
    first_rows,
    select_prefix,
    select_types,
)
from inclina.operators.sampling import hash_sample
from inclina.operators.score import join_scores
from inclina.plans import customer, daily, monthly
from inclina.session import checkpoint_folder, materialize
from inclina.sources.delimited import read_delimited, read_lookup, read_table, write_table


def _scratch(t: Tables, name: str) -> str:
    return f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources ---------------------------------------------------------------------------------

MOVEMENT_COLUMNS = [
    "fecha", "cuenta", "saldo", "saldo_promedio", "creditos_monto", "creditos_tx", "debitos_monto", "debitos_tx", "id_cliente",
]


@query(
    "headerless_movements",
    """SELECT id_cliente, fecha, round(saldo, 6) AS saldo, round(saldo_promedio, 6) AS saldo_promedio,
    creditos_monto, creditos_tx, debitos_monto, debitos_tx FROM movements""",
    ["movements"],
)
def _(t):
    """Headerless text with decimal commas, named by position (written by Spark from the orders)."""
    path = _scratch(t, "movements")
    rows = e.movements(t).withColumn("cuenta", F.lit("1")).select(*MOVEMENT_COLUMNS)
    write_table(rows, path, "csv", sep="~", header=False, mark=",", quoted=False)
    types = {"fecha": "date", **{c: "double" for c in daily.MEASURES}}
    back = read_delimited(t.spark, path, MOVEMENT_COLUMNS, types, header=False, mark=",")
    return rounded(back.drop("cuenta"))


@query("headed_customers", "SELECT ID_CLIENTE, SALARIO, GENERO, EDAD FROM customers", ["customers"])
def _(t):
    """Headed text with a null token, padded fields and typed columns."""
    path = _scratch(t, "customers")
    padded = e.customers(t).select(
        "ID_CLIENTE",
        F.coalesce(F.col("SALARIO").cast("string"), F.lit("NULL")).alias("SALARIO"),
        F.coalesce(F.concat(F.lit("  "), F.col("GENERO"), F.lit(" ")), F.lit("NA")).alias("GENERO"),
        "EDAD",
    )
    write_table(padded, path, "csv", sep="~", quoted=False)
    return read_delimited(
        t.spark, path, ["ID_CLIENTE", "SALARIO", "GENERO", "EDAD"], {"SALARIO": "double", "EDAD": "double"}
    )


@query("ratings_by_position", "SELECT identificacion, producto1, rating FROM ratings", ["ratings"])
def _(t):
    """Text whose header is replaced by position."""
    path = _scratch(t, "ratings")
    write_table(e.ratings(t).toDF("a", "b", "c"), path, "csv", sep="~", quoted=False)
    return read_delimited(t.spark, path, ["identificacion", "producto1", "rating"], {"rating": "double"})


@query("text_round_trip", "SELECT doc_id, text, lang, source FROM documents")
def _(t):
    """Texts with separators, quotes and line breaks through quoted CSV."""
    path = _scratch(t, "texts")
    columns = ["doc_id", "text", "lang", "source"]
    write_table(t("documents").select(*columns), path, "csv")
    return read_delimited(t.spark, path, columns, {"doc_id": "bigint"}, sep=",", quoted=True)


@query(
    "stored_intermediate",
    "SELECT id_cliente, fecha, round(saldo, 6) AS saldo FROM rollup",
    ["rollup"],
)
def _(t):
    """Partitioned Parquet written and read back with a column subset."""
    path = _scratch(t, "rollup")
    rows = daily.daily_rollup(e.movements(t)).withColumn("anio", F.year("fecha"))
    write_table(rows, path, partition_by=["anio"])
    return rounded(read_table(t.spark, path, ["id_cliente", "fecha", "saldo"]))


@query(
    "null_tokens",
    """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN event_type END AS event_type FROM events""",
)
def _(t):
    return t("events").select("event_id", nullify("event_type", ["error", "view"]).alias("event_type"))


@query(
    "decimal_comma",
    """SELECT o_orderkey, TRY_CAST(replace(replace(replace(CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR, '.', ','), '.', ''), ',', '.') AS DOUBLE) AS price
    FROM orders""",
)
def _(t):
    text = F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    return t("orders").select("o_orderkey", parse_decimal(text, ",").alias("price"))


@query("lookup_subset", "SELECT n_name, n_regionkey FROM nation")
def _(t):
    return read_lookup(t.spark, f"{t.folder}/nation.parquet", ["n_name", "n_regionkey"])


@query(
    "typed_columns",
    "SELECT doc_id, TRY_CAST(split_part(source, 'src', 2) AS INTEGER) AS source_no, TRY_CAST(lang AS DOUBLE) AS lang FROM documents",
)
def _(t):
    text = t("documents").select("doc_id", F.split_part("source", F.lit("src"), F.lit(2)).alias("source_no"), "lang")
    return apply_types(text, {"source_no": "int", "lang": "double"})


# ---- projections and filters -----------------------------------------------------------------


@query("select_columns", "SELECT id_cliente, fecha, saldo FROM movements", ["movements"])
def _(t):
    return e.movements(t).select("id_cliente", "fecha", "saldo")


@query("drop_listed", "SELECT * EXCLUDE (o_orderpriority, o_orderstatus) FROM orders")
def _(t):
    return t("orders").drop("o_orderpriority", "o_orderstatus")


@query("select_prefix", "SELECT ID_CLIENTE, SALDO_CA, SALDOS_VISTA_6M, SALDOS_VISTA_1SEM FROM customers", ["customers"])
def _(t):
    rows = e.customers(t)
    return rows.select("ID_CLIENTE", *select_prefix(rows, "SALDO").columns)


@query(
    "select_numeric",
    """SELECT ID_CLIENTE, SALARIO, VIDA, N_TC, N_PP, N_DPF, EDAD, SALDO_CA, SALDOS_VISTA_6M, SALDOS_VISTA_1SEM, POS, N_BANCOS,
    PP_MONTO_ORIGINAL, INGRESO_ESTIMADO, G_FUGA, G_MAIL FROM customers""",
    ["customers"],
)
def _(t):
    return select_types(e.customers(t), (T.NumericType,), keep=["ID_CLIENTE"])


@query(
    "select_nominal",
    """SELECT ID_CLIENTE, DESC_PROFESION, RELACION1, ESTATUS, PRODUCTO, DESC_EDUCACION, GENERO, ESTADO_CIVIL, COD_TIPOCLIENTE,
    COD_PROFESION, JUBILADO, RESIDENCIA_CORREGIMIENTO FROM customers""",
    ["customers"],
)
def _(t):
    return select_types(e.customers(t), (T.NumericType,), invert=True)


@query(
    "feature_columns",
    "SELECT saldo, saldo_promedio, creditos_monto, creditos_tx, debitos_monto, debitos_tx FROM movements",
    ["movements"],
)
def _(t):
    rows = e.movements(t)
    return rows.select(*feature_columns(rows, "fecha", ["id_cliente"]))


@query(
    "eligible_customers",
    """SELECT ID_CLIENTE, EDAD, COD_PROFESION FROM customers WHERE COD_TIPOCLIENTE = '1' AND COD_PROFESION NOT IN ('100', '1419', '102')
    AND EDAD < 60 AND EDAD > 21 AND JUBILADO = '0'""",
    ["customers"],
)
def _(t):
    return customer.eligible_customers(e.customers(t)).select("ID_CLIENTE", "EDAD", "COD_PROFESION")


@query("cancelled_relations", "SELECT ID_CLIENTE, RELACION1, VIDA FROM customers WHERE ESTATUS = 'CANCELADA'", ["customers"])
def _(t):
    return e.customers(t).where(F.col("ESTATUS") == "CANCELADA").select("ID_CLIENTE", "RELACION1", "VIDA")


@query("known_salary", "SELECT ID_CLIENTE, SALARIO FROM customers WHERE SALARIO IS NOT NULL", ["customers"])
def _(t):
    return e.customers(t).where(F.col("SALARIO").isNotNull()).select("ID_CLIENTE", "SALARIO")


@query(
    "complete_cases",
    "SELECT ID_CLIENTE, SALARIO, VIDA, GENERO FROM customers WHERE SALARIO IS NOT NULL AND VIDA IS NOT NULL AND GENERO IS NOT NULL",
    ["customers"],
)
def _(t):
    return complete_cases(e.customers(t).select("ID_CLIENTE", "SALARIO", "VIDA", "GENERO"), ["SALARIO", "VIDA", "GENERO"])


@query("point_lookup", "SELECT * FROM movements WHERE id_cliente = '42'", ["movements"])
def _(t):
    return e.movements(t).where(F.col("id_cliente") == "42")


@query(
    "align_columns",
    """SELECT a.ID_CLIENTE, a.GENERO, b.SALARIO FROM customers a LEFT JOIN (SELECT ID_CLIENTE, SALARIO FROM customers) b USING (ID_CLIENTE)""",
    ["customers"],
)
def _(t):
    rows = e.customers(t)
    return align_columns(rows.select("ID_CLIENTE", "GENERO"), rows.select("ID_CLIENTE", "SALARIO"), ["ID_CLIENTE"])


@query(
    "outside_genders",
    "SELECT ID_CLIENTE, GENERO FROM customers WHERE NOT coalesce(GENERO IN ('F', 'M'), false)",
    ["customers"],
)
def _(t):
    return e.customers(t).where(~is_in("GENERO", ["F", "M"])).select("ID_CLIENTE", "GENERO")


# ---- column functions ------------------------------------------------------------------------


@query(
    "tenure_flags",
    """SELECT ID_CLIENTE, """
    + ", ".join(f"CASE WHEN {c} = 0 THEN 'No' WHEN {c} <> 0 THEN 'Si' END AS {c}" for c in ("N_TC", "N_PP", "N_DPF", "G_FUGA"))
    + " FROM customers",
    ["customers"],
)
def _(t):
    return customer.flag_holdings(e.customers(t)).select("ID_CLIENTE", "N_TC", "N_PP", "N_DPF", "G_FUGA")


@query(
    "binary_flags",
    "SELECT ID_CLIENTE, "
    + ", ".join(f"CASE WHEN {c} = 0 THEN 0 WHEN {c} <> 0 THEN 1 END AS {c}1" for c in ("N_TC", "N_PP", "N_DPF"))
    + " FROM customers",
    ["customers"],
)
def _(t):
    return monthly.recoded(e.customers(t)).select("ID_CLIENTE", "N_TC1", "N_PP1", "N_DPF1")


@query(
    "zero_fill",
    "SELECT ID_CLIENTE, coalesce(SALARIO, 0) AS SALARIO, coalesce(VIDA, 0) AS VIDA, coalesce(N_PP, 0) AS N_PP FROM customers",
    ["customers"],
)
def _(t):
    return customer.zero_fill_numbers(e.customers(t).select("ID_CLIENTE", "SALARIO", "VIDA", "N_PP"))


@query("casts", "SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(left(o_orderpriority, 1) AS DOUBLE) AS p FROM orders")
def _(t):
    return t("orders").select(
        F.col("o_orderkey").cast("string").alias("k"), F.substring("o_orderpriority", 1, 1).try_cast("double").alias("p")
    )


@query("recode_years", f"SELECT ID_CLIENTE, DESC_EDUCACION, {e._YEARS} AS ANO_ESTUDIO FROM customers", ["customers"])
def _(t):
    return monthly.recoded(e.customers(t)).select("ID_CLIENTE", "DESC_EDUCACION", "ANO_ESTUDIO")


@query(
    "whitelist_codes",
    """SELECT ID_CLIENTE, CASE WHEN GENERO IN ('F', 'M') THEN GENERO ELSE 'ND' END AS GENERO1,
    CASE WHEN ESTADO_CIVIL IN ('CASADO/A', 'DIVORCIADO/A', 'SOLTERO/A', 'UNIDO/A', 'VIUDO/A') THEN ESTADO_CIVIL ELSE 'ND' END AS ESTADO_CIVIL1
    FROM customers""",
    ["customers"],
)
def _(t):
    return monthly.allowed_codes(e.customers(t)).select("ID_CLIENTE", "GENERO1", "ESTADO_CIVIL1")


@query("classify_products", "SELECT NO_CREDITO, NOM_PRODUCTO, producto FROM classified", ["classified"])
def _(t):
    return daily.classify_openings(e.openings(t)).select("NO_CREDITO", "NOM_PRODUCTO", "producto")


@query(
    "cut_bins",
    """SELECT ID_CLIENTE, CASE WHEN POS <= 529 THEN 'POS =< 529' WHEN POS > 529 THEN 'POS > 529' END AS POS_DISC,
    CASE WHEN N_BANCOS <= 2 THEN 'N_BANCOS <= 2' WHEN N_BANCOS > 2 THEN 'N_BANCOS > 2' END AS N_BANCOS_DISC,
    CASE WHEN SALDOS_VISTA_6M <= 0.33 THEN 'S_V_6M =< 0.33' WHEN SALDOS_VISTA_6M > 0.33 THEN 'S_V_6M > 0.33' END AS SALDOS_VISTA_6M_DISC,
    CASE WHEN INGRESO_ESTIMADO <= 594 THEN 'ING_E =< 594' WHEN INGRESO_ESTIMADO > 594 THEN 'ING_E > 594' END AS INGRESO_ESTIMADO_DISC
    FROM customers""",
    ["customers"],
)
def _(t):
    columns = ["POS_DISC", "N_BANCOS_DISC", "SALDOS_VISTA_6M_DISC", "INGRESO_ESTIMADO_DISC"]
    return customer.cut_bins(e.customers(t)).select("ID_CLIENTE", *columns)


@query(
    "date_parts",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders",
)
def _(t):
    d = F.col("o_orderdate")
    return longs(t("orders").select("o_orderkey", F.to_date(d).alias("day"), F.year(d).alias("y"), F.month(d).alias("m")))


@query(
    "year_month_label",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'NA_NA' ELSE year(o_orderdate) || '_' || month(o_orderdate) END AS label FROM orders""",
)
def _(t):
    known = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    return t("orders").select("o_orderkey", year_month_label(known).alias("label"))


@query(
    "holding_flags",
    """SELECT id_cliente, fecha, NO_CREDITO, tenencia, tenencia_tdc, tenencia_pp, tenencia_dpf, anomes_producto FROM counted""",
    ["counted"],
)
def _(t):
    return longs(
        daily.counted_panel(e.movements(t), e.openings(t)).select(
            "id_cliente", "fecha", "NO_CREDITO", "tenencia", "tenencia_tdc", "tenencia_pp", "tenencia_dpf", "anomes_producto"
        )
    )


@query(
    "log_balances",
    """SELECT c_custkey, round(CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END, 6) AS l1, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS l0 FROM customer""",
)
def _(t):
    return rounded(
        t("customer").select("c_custkey", log_value("c_acctbal").alias("l1"), log_value("c_acctbal", "log").alias("l0"))
    )


@query("half_even", "SELECT p_partkey, CAST(round_even(p_partkey / 8.0, 2) AS DOUBLE) AS r FROM part")
def _(t):
    return t("part").select("p_partkey", F.bround(F.col("p_partkey") / 8.0, 2).alias("r"))


@query("name_parts", "SELECT c_custkey, substring(c_name, 1, 8) AS head, upper(substring(c_name, 10)) AS tail FROM customer")
def _(t):
    return t("customer").select(
        "c_custkey", F.substring("c_name", 1, 8).alias("head"), F.upper(F.expr("substring(c_name, 10)")).alias("tail")
    )


@query(
    "many_columns",
    "SELECT ID_CLIENTE, CAST(N_TC AS VARCHAR) AS N_TC, CAST(G_FUGA AS VARCHAR) AS G_FUGA FROM customers",
    ["customers"],
)
def _(t):
    """Category casts of several columns in one projection."""
    return map_columns(e.customers(t), ["N_TC", "G_FUGA"], lambda c: c.cast("string")).select("ID_CLIENTE", "N_TC", "G_FUGA")


# ---- joins -----------------------------------------------------------------------------------


@query(
    "panel_join",
    "SELECT id_cliente, fecha, NO_CREDITO, producto, round(saldo, 6) AS saldo FROM joined",
    ["joined"],
)
def _(t):
    """Null-safe many-to-many left join of customer-days with openings."""
    credits = daily.classify_openings(e.openings(t))
    days = daily.daily_rollup(e.movements(t))
    return rounded(
        left_join_ns(days, credits, [("id_cliente", "ID_CLIENTE_N5")]).select("id_cliente", "fecha", "NO_CREDITO", "producto", "saldo")
    )


@query(
    "salary_imputation",
    "SELECT ID_CLIENTE, OCUPACIONES, round(mediana, 6) AS mediana, round(SALARIO1, 6) AS SALARIO1 FROM imputed",
    ["imputed"],
)
def _(t):
    done = monthly.impute_salary(e.customers(t), e.occupations(t))
    return rounded(done.select("ID_CLIENTE", "OCUPACIONES", "mediana", "SALARIO1"))


@query("life_imputation", "SELECT ID_CLIENTE, RELACION1, VIDA, vida_util, VIDA1 FROM imputed", ["imputed"])
def _(t):
    return monthly.impute_life(e.customers(t)).select("ID_CLIENTE", "RELACION1", "VIDA", "vida_util", "VIDA1")


@query("distance_lookup", "SELECT ID_CLIENTE, RESIDENCIA_CORREGIMIENTO, Distancia_km FROM imputed", ["imputed"])
def _(t):
    done = monthly.add_distance(e.customers(t), e.distances(t))
    return done.select("ID_CLIENTE", "RESIDENCIA_CORREGIMIENTO", "Distancia_km")


@query("distinct_lookup", "SELECT DISTINCT PROFESION, OCUPACIONES FROM occupations", ["occupations"])
def _(t):
    return distinct_lookup(e.occupations(t), ["PROFESION", "OCUPACIONES"])


@query(
    "gender_totals",
    """SELECT c.ID_CLIENTE, c.GENERO, g.n FROM customers c LEFT JOIN (SELECT GENERO, count(*) AS n FROM customers GROUP BY GENERO) g
    ON c.GENERO IS NOT DISTINCT FROM g.GENERO""",
    ["customers"],
)
def _(t):
    """A group statistic sent back to its rows; a missing key finds the statistic of missing keys."""
    rows = e.customers(t).select("ID_CLIENTE", "GENERO")
    return attach_checked(rows, materialize(rows.groupBy("GENERO").agg(F.count("*").alias("n"))), ["GENERO"])


@query(
    "score_join",
    """SELECT a.id_cliente, a.p AS dpf, b.p AS tdc, c.p AS pp FROM (SELECT id_cliente, max(creditos_tx) AS p FROM movements GROUP BY 1) a
    LEFT JOIN (SELECT id_cliente, max(debitos_tx) AS p FROM movements GROUP BY 1) b USING (id_cliente)
    LEFT JOIN (SELECT id_cliente, max(saldo) AS p FROM movements GROUP BY 1) c USING (id_cliente)""",
    ["movements"],
)
def _(t):
    rows = e.movements(t)
    parts = {"dpf": "creditos_tx", "tdc": "debitos_tx", "pp": "saldo"}
    return join_scores({k: rows.select("id_cliente", F.col(c).alias("p")) for k, c in parts.items()}, "id_cliente")


@query(
    "semi_join_sample",
    f"""SELECT m.id_cliente, m.fecha, m.saldo FROM movements m WHERE ('0x' || substr(md5('7:' || m.id_cliente), 1, 8))::BIGINT < {round(0.3 * 2**32)}""",
    ["movements"],
)
def _(t):
    """Movements of the sampled customers."""
    rows = e.movements(t)
    sample = hash_sample(rows.select("id_cliente").distinct(), "id_cliente", 0.3, seed=7)
    return semi_join_ns(rows, sample, ["id_cliente"]).select("id_cliente", "fecha", "saldo")


@query(
    "first_rows",
    "SELECT id_cliente, fecha, saldo FROM movements ORDER BY fecha, id_cliente, saldo LIMIT 10",
    ["movements"],
)
def _(t):
    """First ten rows in date order."""
    return first_rows(e.movements(t).select("id_cliente", "fecha", "saldo"), ["fecha", "id_cliente", "saldo"], 10)
