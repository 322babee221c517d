"""The bank's tables expressed over the test tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inclina.catalog.base import DERIVED, Tables
from inclina.functions.columns import hash_bucket


def _case(c, pairs, default=None):
    out = F
    for value, result in pairs:
        out = out.when(c == value, F.lit(result))
    return out.otherwise(F.lit(default)) if default is not None else out


def movements(t: Tables) -> DataFrame:
    """Account movements: an order is a credit when finished, a debit when open, unknown otherwise."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return t("orders").select(
        F.col("o_custkey").cast("string").alias("id_cliente"),
        F.to_date("o_orderdate").alias("fecha"),
        price.alias("saldo"),
        (price / 2).alias("saldo_promedio"),
        F.when(status == "F", price).when(status == "O", 0.0).alias("creditos_monto"),
        F.when(status == "F", 1.0).when(status == "O", 0.0).alias("creditos_tx"),
        F.when(status == "O", price).when(status == "F", 0.0).alias("debitos_monto"),
        F.when(status == "O", 1.0).when(status == "F", 0.0).alias("debitos_tx"),
    )


DERIVED["movements"] = (
    (),
    """SELECT CAST(o_custkey AS VARCHAR) AS id_cliente, CAST(o_orderdate AS DATE) AS fecha, o_totalprice AS saldo,
    o_totalprice / 2 AS saldo_promedio,
    CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN 0.0 END AS creditos_monto,
    CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0 END AS creditos_tx,
    CASE o_orderstatus WHEN 'O' THEN o_totalprice WHEN 'F' THEN 0.0 END AS debitos_monto,
    CASE o_orderstatus WHEN 'O' THEN 1.0::DOUBLE WHEN 'F' THEN 0.0 END AS debitos_tx FROM orders""",
)

PRODUCT_NAMES = [
    ("1-URGENT", "TARJETA CREDITO"),
    ("2-HIGH", "PRESTAMO PERSONAL"),
    ("3-MEDIUM", "DPF PLAZO FIJO"),
    ("4-NOT SPECIFIED", "HIPOTECA"),
    ("5-LOW", "AUTO"),
]


def openings(t: Tables) -> DataFrame:
    """Product openings: the finished orders."""
    return t("orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").cast("string").alias("ID_CLIENTE_N5"),
        F.col("o_orderkey").alias("NO_CREDITO"),
        _case(F.col("o_orderpriority"), PRODUCT_NAMES).alias("NOM_PRODUCTO"),
        F.to_date("o_orderdate").alias("fecha_apertura"),
    )


DERIVED["openings"] = (
    (),
    """SELECT CAST(o_custkey AS VARCHAR) AS ID_CLIENTE_N5, o_orderkey AS NO_CREDITO,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'TARJETA CREDITO' WHEN '2-HIGH' THEN 'PRESTAMO PERSONAL'
    WHEN '3-MEDIUM' THEN 'DPF PLAZO FIJO' WHEN '4-NOT SPECIFIED' THEN 'HIPOTECA' WHEN '5-LOW' THEN 'AUTO' END AS NOM_PRODUCTO,
    CAST(o_orderdate AS DATE) AS fecha_apertura FROM orders WHERE o_orderstatus = 'F'""",
)
DERIVED["classified"] = (
    ("openings",),
    """SELECT *, CASE WHEN regexp_matches(NOM_PRODUCTO, 'PERSONAL') THEN 'PP' WHEN regexp_matches(NOM_PRODUCTO, 'TARJETA') THEN 'TDC'
    WHEN regexp_matches(NOM_PRODUCTO, 'DPF') THEN 'DPF' ELSE 'OTRO' END AS producto FROM openings""",
)
_STRICT = "CASE WHEN count(*) = count({0}) THEN sum({0}) END AS {0}"
DERIVED["rollup"] = (
    ("movements",),
    "SELECT id_cliente, fecha, "
    + ", ".join(
        _STRICT.format(m) for m in ("saldo", "saldo_promedio", "creditos_monto", "creditos_tx", "debitos_monto", "debitos_tx")
    )
    + " FROM movements GROUP BY id_cliente, fecha",
)
DERIVED["joined"] = (
    ("rollup", "classified"),
    """SELECT r.*, c.NO_CREDITO, c.NOM_PRODUCTO, c.producto, c.fecha_apertura,
    CASE WHEN c.fecha_apertura <= r.fecha THEN 0 WHEN c.fecha_apertura > r.fecha THEN 1 END AS tenencia
    FROM rollup r LEFT JOIN classified c ON r.id_cliente = c.ID_CLIENTE_N5""",
)
DERIVED["counted"] = (
    ("joined",),
    """SELECT *, row_number() OVER (PARTITION BY id_cliente ORDER BY fecha, NO_CREDITO NULLS LAST) AS meses,
    CASE WHEN producto = 'TDC' AND tenencia = 1 THEN '1' ELSE '2' END AS tenencia_tdc,
    CASE WHEN producto = 'PP' AND tenencia = 1 THEN '1' ELSE '2' END AS tenencia_pp,
    CASE WHEN producto = 'DPF' AND tenencia = 1 THEN '1' ELSE '2' END AS tenencia_dpf,
    coalesce(year(fecha_apertura)::VARCHAR, 'NA') || '_' || coalesce(month(fecha_apertura)::VARCHAR, 'NA') AS anomes_producto
    FROM joined""",
)
DERIVED["longest"] = (
    ("counted",),
    "SELECT *, max(meses) OVER (PARTITION BY NO_CREDITO) AS max_mes FROM counted",
)
DERIVED["product_quartiles"] = (
    ("counted",),
    """SELECT producto, quantile_cont(meses, 0.25) AS p25, quantile_cont(meses, 0.5) AS p50, quantile_cont(meses, 0.75) AS p75
    FROM counted GROUP BY producto""",
)
DERIVED["panel"] = (
    ("longest", "product_quartiles"),
    """SELECT l.NO_CREDITO, l.id_cliente, coalesce(saldo, 0) AS saldo, coalesce(saldo_promedio, 0) AS saldo_promedio,
    coalesce(creditos_monto, 0) AS creditos_monto, coalesce(creditos_tx, 0) AS creditos_tx,
    coalesce(debitos_monto, 0) AS debitos_monto, coalesce(debitos_tx, 0) AS debitos_tx,
    tenencia, tenencia_tdc, tenencia_pp, tenencia_dpf, max_mes,
    CASE WHEN max_mes <= p25 THEN 'g1' WHEN max_mes <= p50 THEN 'g2' WHEN max_mes <= p75 THEN 'g3' ELSE 'g4' END AS grupo,
    anomes_producto
    FROM longest l LEFT JOIN product_quartiles q ON l.producto IS NOT DISTINCT FROM q.producto""",
)

EDUCATION = [
    (0, "BÁSICO INCOMPLETOS"),
    (1, "BÁSICO COMPLETOS"),
    (2, "MEDIOS INCOMPLETOS"),
    (3, "MEDIOS COMPLETOS"),
    (4, "TÉCNICOS"),
    (5, "UNIVERSITARIOS INCOMPLETO"),
    (6, "UNIVERSITARIOS COMPLETOS"),
    (7, "OTRA"),
]


def customers(t: Tables) -> DataFrame:
    """Customer snapshot with invented codes and missing values derived from the customer key."""
    key, balance, nation = F.col("c_custkey"), F.col("c_acctbal"), F.col("c_nationkey")
    number = lambda e: e.cast("double")
    return t("customer").select(
        key.cast("string").alias("ID_CLIENTE"),
        F.concat(F.lit("NATION_"), nation.cast("string")).alias("DESC_PROFESION"),
        F.when(key % 7 != 0, balance).alias("SALARIO"),
        F.when(key % 5 != 0, F.floor(balance / 100).cast("double")).alias("VIDA"),
        _case(key % 4, [(0, "OTROS"), (1, "PREST. PERSONAL"), (2, "TARJ. CREDITO")], "HIPOTECA").alias("RELACION1"),
        F.when(key % 3 == 0, "CANCELADA").otherwise("ACTIVA").alias("ESTATUS"),
        F.col("c_mktsegment").alias("PRODUCTO"),
        number(key % 3).alias("N_TC"),
        F.when(key % 11 != 0, number(key % 4)).alias("N_PP"),
        number(key % 2).alias("N_DPF"),
        _case(nation % 9, EDUCATION).alias("DESC_EDUCACION"),
        _case(key % 5, [(0, "F"), (1, "M"), (2, "F"), (3, "X")]).alias("GENERO"),
        _case(key % 6, [(0, "CASADO/A"), (1, "SOLTERO/A"), (2, "VIUDO/A"), (3, "UNIDO/A"), (4, "OTRO")]).alias("ESTADO_CIVIL"),
        F.when(key % 10 == 9, "2").otherwise("1").alias("COD_TIPOCLIENTE"),
        (nation + 90).cast("string").alias("COD_PROFESION"),
        number(key % 50 + 18).alias("EDAD"),
        F.when(key % 13 == 0, "1").when(key % 17 != 0, "0").alias("JUBILADO"),
        F.concat(F.lit("NATION_"), nation.cast("string")).alias("RESIDENCIA_CORREGIMIENTO"),
        balance.alias("SALDO_CA"),
        F.when(key % 6 != 0, balance / 10000).alias("SALDOS_VISTA_6M"),
        F.greatest(balance, F.lit(0.0)).alias("SALDOS_VISTA_1SEM"),
        number(key * 7 % 1000).alias("POS"),
        number(key % 5).alias("N_BANCOS"),
        F.when(key % 8 != 0, balance * 2).alias("PP_MONTO_ORIGINAL"),
        F.when(key % 9 != 0, balance / 8).alias("INGRESO_ESTIMADO"),
        number(key % 2).alias("G_FUGA"),
        F.when(key % 19 != 0, number(key % 3)).alias("G_MAIL"),
    )


def _sql_case(expr: str, pairs, default: str | None = None) -> str:
    body = " ".join(f"WHEN {v} THEN '{r}'" for v, r in pairs)
    return f"CASE {expr} {body}" + (f" ELSE '{default}' END" if default else " END")


DERIVED["customers"] = (
    (),
    f"""SELECT CAST(c_custkey AS VARCHAR) AS ID_CLIENTE, 'NATION_' || c_nationkey AS DESC_PROFESION,
    CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS SALARIO,
    CASE WHEN c_custkey % 5 <> 0 THEN CAST(floor(c_acctbal / 100) AS DOUBLE) END AS VIDA,
    {_sql_case('c_custkey % 4', [(0, 'OTROS'), (1, 'PREST. PERSONAL'), (2, 'TARJ. CREDITO')], 'HIPOTECA')} AS RELACION1,
    CASE WHEN c_custkey % 3 = 0 THEN 'CANCELADA' ELSE 'ACTIVA' END AS ESTATUS, c_mktsegment AS PRODUCTO,
    CAST(c_custkey % 3 AS DOUBLE) AS N_TC, CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 4 AS DOUBLE) END AS N_PP,
    CAST(c_custkey % 2 AS DOUBLE) AS N_DPF, {_sql_case('c_nationkey % 9', EDUCATION)} AS DESC_EDUCACION,
    {_sql_case('c_custkey % 5', [(0, 'F'), (1, 'M'), (2, 'F'), (3, 'X')])} AS GENERO,
    {_sql_case('c_custkey % 6', [(0, 'CASADO/A'), (1, 'SOLTERO/A'), (2, 'VIUDO/A'), (3, 'UNIDO/A'), (4, 'OTRO')])} AS ESTADO_CIVIL,
    CASE WHEN c_custkey % 10 = 9 THEN '2' ELSE '1' END AS COD_TIPOCLIENTE, CAST(c_nationkey + 90 AS VARCHAR) AS COD_PROFESION,
    CAST(c_custkey % 50 + 18 AS DOUBLE) AS EDAD,
    CASE WHEN c_custkey % 13 = 0 THEN '1' WHEN c_custkey % 17 <> 0 THEN '0' END AS JUBILADO,
    'NATION_' || c_nationkey AS RESIDENCIA_CORREGIMIENTO, c_acctbal AS SALDO_CA,
    CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal / 10000 END AS SALDOS_VISTA_6M, greatest(c_acctbal, 0.0) AS SALDOS_VISTA_1SEM,
    CAST(c_custkey * 7 % 1000 AS DOUBLE) AS POS, CAST(c_custkey % 5 AS DOUBLE) AS N_BANCOS,
    CASE WHEN c_custkey % 8 <> 0 THEN c_acctbal * 2 END AS PP_MONTO_ORIGINAL,
    CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal / 8 END AS INGRESO_ESTIMADO,
    CAST(c_custkey % 2 AS DOUBLE) AS G_FUGA, CASE WHEN c_custkey % 19 <> 0 THEN CAST(c_custkey % 3 AS DOUBLE) END AS G_MAIL
    FROM customer""",
)


def occupations(t: Tables) -> DataFrame:
    """Profession to occupation group, one row per supplier: the lookup repeats its rows."""
    return (
        t("supplier")
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_name").alias("PROFESION"), F.col("r_name").alias("OCUPACIONES"))
    )


DERIVED["occupations"] = (
    (),
    """SELECT n_name AS PROFESION, r_name AS OCUPACIONES FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""",
)


def distances(t: Tables) -> DataFrame:
    """District to distance; one region's districts are not listed."""
    return t("nation").where("n_regionkey <> 4").select(
        F.col("n_name").alias("RESIDENCIA_CORREGIMIENTO"), (F.col("n_nationkey") * 12.5).alias("Distancia_km")
    )


DERIVED["distances"] = (
    (),
    "SELECT n_name AS RESIDENCIA_CORREGIMIENTO, CAST(n_nationkey * 12.5 AS DOUBLE) AS Distancia_km FROM nation WHERE n_regionkey <> 4",
)
DERIVED["salaries"] = (
    ("customers",),
    "SELECT ID_CLIENTE, DESC_PROFESION, avg(SALARIO) AS salario FROM customers GROUP BY ALL",
)
DERIVED["grouped_salaries"] = (
    ("salaries", "occupations"),
    """SELECT s.*, o.OCUPACIONES FROM salaries s LEFT JOIN (SELECT DISTINCT PROFESION, OCUPACIONES FROM occupations) o
    ON s.DESC_PROFESION = o.PROFESION""",
)
DERIVED["occupation_medians"] = (
    ("grouped_salaries",),
    "SELECT *, median(salario) OVER (PARTITION BY OCUPACIONES) AS mediana FROM grouped_salaries",
)
DERIVED["life_medians"] = (
    ("customers",),
    "SELECT RELACION1, median(VIDA) AS vida_util FROM customers WHERE ESTATUS = 'CANCELADA' GROUP BY RELACION1",
)
_YEARS = """CASE DESC_EDUCACION WHEN 'BÁSICO INCOMPLETOS' THEN 5 WHEN 'BÁSICO COMPLETOS' THEN 8 WHEN 'MEDIOS INCOMPLETOS' THEN 10
    WHEN 'MEDIOS COMPLETOS' THEN 12 WHEN 'TÉCNICOS' THEN 15 WHEN 'UNIVERSITARIOS INCOMPLETO' THEN 15
    WHEN 'UNIVERSITARIOS COMPLETOS' THEN 17 ELSE 99 END"""
DERIVED["imputed"] = (
    ("occupation_medians", "life_medians", "distances"),
    f"""SELECT c.*, o.OCUPACIONES, o.mediana, l.vida_util, d.Distancia_km, coalesce(c.SALARIO, o.mediana) AS SALARIO1,
    CASE WHEN c.VIDA IS NULL AND c.RELACION1 IN ('OTROS', 'PREST. PERSONAL', 'TARJ. CREDITO') THEN l.vida_util ELSE c.VIDA END AS VIDA1,
    {_YEARS} AS ANO_ESTUDIO,
    CASE WHEN N_TC = 0 THEN 0 WHEN N_TC <> 0 THEN 1 END AS N_TC1, CASE WHEN N_PP = 0 THEN 0 WHEN N_PP <> 0 THEN 1 END AS N_PP1,
    CASE WHEN N_DPF = 0 THEN 0 WHEN N_DPF <> 0 THEN 1 END AS N_DPF1
    FROM customers c LEFT JOIN occupation_medians o ON c.ID_CLIENTE = o.ID_CLIENTE LEFT JOIN life_medians l ON c.RELACION1 = l.RELACION1
    LEFT JOIN distances d ON c.RESIDENCIA_CORREGIMIENTO = d.RESIDENCIA_CORREGIMIENTO""",
)


def ratings(t: Tables) -> DataFrame:
    """A customer's rating of a brand, 1 to 5, from the quantity bought."""
    return (
        t("lineitem")
        .select("l_orderkey", "l_partkey", "l_quantity")
        .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").cast("string").alias("identificacion"), F.col("p_brand").alias("producto1"))
        .agg((F.lit(1) + F.sum("l_quantity").cast("bigint") % 5).cast("double").alias("rating"))
    )


DERIVED["ratings"] = (
    (),
    """SELECT CAST(o_custkey AS VARCHAR) AS identificacion, p_brand AS producto1,
    CAST(1 + CAST(sum(l_quantity) AS BIGINT) % 5 AS DOUBLE) AS rating
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
DERIVED["centered"] = (
    ("ratings",),
    "SELECT *, avg(rating) OVER (PARTITION BY identificacion) AS user_mean, rating - avg(rating) OVER (PARTITION BY identificacion) AS centered FROM ratings",
)
DERIVED["similarity"] = (
    ("centered",),
    """SELECT a.producto1 AS item_i, b.producto1 AS item_j, sum(a.centered * b.centered) / (sqrt(sum(a.centered * a.centered)) * sqrt(sum(b.centered * b.centered))) AS sim,
    count(*) AS n FROM centered a JOIN centered b ON a.identificacion = b.identificacion AND a.producto1 <> b.producto1 GROUP BY 1, 2
    HAVING sum(a.centered * a.centered) > 0 AND sum(b.centered * b.centered) > 0""",
)
DERIVED["neighbours"] = (
    ("similarity",),
    "SELECT * FROM similarity QUALIFY row_number() OVER (PARTITION BY item_i ORDER BY sim DESC, item_j) <= 10",
)
DERIVED["predicted"] = (
    ("neighbours",),
    """SELECT r.identificacion, s.item_i AS producto1, any_value(r.user_mean) + sum(s.sim * r.centered) / sum(abs(s.sim)) AS prediction
    FROM centered r JOIN neighbours s ON r.producto1 = s.item_j GROUP BY 1, 2 HAVING sum(abs(s.sim)) > 0""",
)

DERIVED["by_region"] = (
    ("ratings",),
    """SELECT producto1 AS identificacion, CAST(c_nationkey AS VARCHAR) AS producto1, sum(rating) AS rating
    FROM ratings JOIN customer ON identificacion = CAST(c_custkey AS VARCHAR) GROUP BY 1, 2""",
)


def line_ratings(t: Tables, before: str | None = None) -> DataFrame:
    """A customer's rating of a product line (brand and type), 1 to 5, from the quantity bought (in orders before a day)."""
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if before:
        orders = orders.where(F.col("o_orderdate") < F.lit(before).cast("date"))
    line = F.concat_ws("/", "p_brand", "p_type")
    return (
        t("lineitem")
        .select("l_orderkey", "l_partkey", "l_quantity")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part").select("p_partkey", line.alias("producto1")), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").cast("string").alias("identificacion"), "producto1")
        .agg((F.lit(1) + F.sum("l_quantity").cast("bigint") % 5).cast("double").alias("rating"))
    )


DERIVED["line_ratings"] = (
    (),
    """SELECT CAST(o_custkey AS VARCHAR) AS identificacion, concat_ws('/', p_brand, p_type) AS producto1,
    CAST(1 + CAST(sum(l_quantity) AS BIGINT) % 5 AS DOUBLE) AS rating
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)


def near_lines(rows: str) -> str:
    """SQL of the 30 nearest product lines by the ratings in ``rows``."""
    return f"""WITH c AS (SELECT *, rating - avg(rating) OVER (PARTITION BY identificacion) AS centered FROM ({rows}))
    SELECT a.producto1 AS item_i, b.producto1 AS item_j, sum(a.centered * b.centered) / (sqrt(sum(a.centered * a.centered)) * sqrt(sum(b.centered * b.centered))) AS sim,
    count(*) AS n FROM c a JOIN c b ON a.identificacion = b.identificacion AND a.producto1 <> b.producto1 GROUP BY 1, 2
    HAVING sum(a.centered * a.centered) > 0 AND sum(b.centered * b.centered) > 0
    QUALIFY row_number() OVER (PARTITION BY item_i ORDER BY sim DESC, item_j) <= 30"""


def wide_embeddings(t: Tables) -> tuple[DataFrame, list[str]]:
    """Vectors as one column per dimension, as many as the longest vector has, and those columns' names."""
    rows = t("embeddings")
    names = [f"d{i}" for i in range(rows.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    return rows.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]), names


def scored(t: Tables) -> DataFrame:
    """Orders with a class, a score with many ties and the class at 0.5."""
    score = F.floor(F.col("o_totalprice") / 2500) / 200
    return t("orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("id_cliente"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("clase"),
        score.alias("score"),
        F.when(score >= 0.5, "yes").otherwise("no").alias("pred"),
    )


DERIVED["scored"] = (
    (),
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS id_cliente, CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS clase,
    floor(o_totalprice / 2500) / 200 AS score, CASE WHEN floor(o_totalprice / 2500) / 200 >= 0.5 THEN 'yes' ELSE 'no' END AS pred FROM orders""",
)
DERIVED["curve"] = (
    ("scored",),
    """SELECT score, pos, neg, coalesce(sum(pos) OVER above, 0) AS pos_before, coalesce(sum(neg) OVER above, 0) AS neg_before
    FROM (SELECT score, count(*) FILTER (clase = 'yes') AS pos, count(*) FILTER (clase = 'no') AS neg FROM scored GROUP BY score)
    WINDOW above AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)

TEXT_FEATURES = ["n_chars", "n_words", "n_lines", "n_digits", "n_upper", "n_marks"]


def labelled_texts(t: Tables) -> DataFrame:
    """Numeric features of whole documents with their quality label."""
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("double")
    return (
        t("documents")
        .join(t("labels"), "doc_id")
        .select(
            "doc_id",
            F.col("quality").cast("double").alias("label"),
            F.col("n_chars").cast("double").alias("n_chars"),
            count(r"[^ \n]+").alias("n_words"),
            count(r"\n").alias("n_lines"),
            count("[0-9]").alias("n_digits"),
            count("[A-Z]").alias("n_upper"),
            count("[.,;:!?]").alias("n_marks"),
        )
    )


def _counted(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(text, '{pattern}')) AS DOUBLE)"


DERIVED["labelled_texts"] = (
    (),
    rf"""SELECT d.doc_id, CAST(quality AS DOUBLE) AS label, CAST(n_chars AS DOUBLE) AS n_chars, {_counted(r'[^ \n]+')} AS n_words,
    {_counted(r'\n')} AS n_lines, {_counted('[0-9]')} AS n_digits, {_counted('[A-Z]')} AS n_upper, {_counted('[.,;:!?]')} AS n_marks
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)


def model_scores(t: Tables) -> DataFrame:
    """Three scores of every order in long form: the rule's, a hash's and their mean."""
    rows = scored(t).withColumn("azar", hash_bucket("o_orderkey", 10, 1, 0) / 10.0)
    models = {"regla": F.col("score"), "azar": F.col("azar"), "mezcla": (F.col("score") + F.col("azar")) / 2}
    return rows.select("o_orderkey", "clase", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), s.cast("double").alias("score")) for m, s in models.items()])))


DERIVED["model_scores"] = (
    ("scored",),
    """SELECT o_orderkey, clase, model, CASE model WHEN 'regla' THEN score WHEN 'azar' THEN azar ELSE (score + azar) / 2 END AS score
    FROM (SELECT *, (('0x' || substr(md5('1:0:' || o_orderkey), 1, 8))::BIGINT % 10) / 10.0::DOUBLE AS azar FROM scored), (VALUES ('regla'), ('azar'), ('mezcla')) v(model)""",
)
DERIVED["model_placements"] = (
    ("model_scores",),
    """SELECT o_orderkey, model, y, CASE WHEN y THEN (nb + neg / 2.0) / q ELSE (p - pb - pos / 2.0) / p END AS v FROM
    (SELECT *, clase = 'yes' AS y FROM model_scores) JOIN
    (SELECT *, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS q,
     coalesce(sum(pos) OVER below, 0) AS pb, coalesce(sum(neg) OVER below, 0) AS nb FROM
     (SELECT model, score, count(*) FILTER (clase = 'yes') AS pos, count(*) FILTER (clase = 'no') AS neg FROM model_scores GROUP BY 1, 2)
     WINDOW below AS (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) USING (model, score)""",
)
