"""The daily panel and the monthly features against plain Python, skew included; physical plans."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inclina.catalog import QUERIES
from inclina.plans import customer, daily, monthly

DAY = dt.date(2020, 1, 1)
M = "id_cliente string, fecha date, saldo double, saldo_promedio double, creditos_monto double, creditos_tx double, debitos_monto double, debitos_tx double"
O = "ID_CLIENTE_N5 string, NO_CREDITO string, NOM_PRODUCTO string, fecha_apertura date"


def bank(spark, seed=1, customers=12, hot_credits=40):
    """Movements and openings with one customer that holds most credits, customers without any, a null
    customer, null amounts, null credit numbers and null product names."""
    rng = random.Random(seed)
    ids = [str(i) for i in range(customers)] + [None]
    day = lambda: DAY + dt.timedelta(rng.randrange(25))
    moves = [
        (rng.choice(ids), day(), *[None if rng.random() < 0.05 else float(rng.randrange(100)) for _ in range(6)]) for _ in range(260)
    ]
    names = ["PRESTAMO PERSONAL", "TARJETA PERSONAL", "TARJETA", "DPF", "X", None]
    opens = [("3", f"h{i:03d}", rng.choice(names), day()) for i in range(hot_credits)]
    opens += [(rng.choice(ids[:6] + [None]), rng.choice([None, f"c{i:03d}"]), rng.choice(names), rng.choice([day(), None])) for i in range(25)]
    return moves, opens, spark.createDataFrame(moves, M).repartition(5), spark.createDataFrame(opens, O).repartition(3)


def brute_panel(moves, opens):
    """Rows (id, day, credit, meses, max_mes, grupo, tenencia) the long way round."""
    days = {}
    for i, d, *x in moves:
        days.setdefault((i, d), []).append(x)
    rolled = {k: [None if any(r[j] is None for r in v) else sum(r[j] for r in v) for j in range(6)] for k, v in days.items()}

    def product(name):
        for pattern, label in daily.PRODUCT_PATTERNS:
            if name is not None and pattern in name:
                return label
        return daily.OTHER_PRODUCT

    last = "~"
    rows = []
    for i in {k[0] for k in rolled}:
        own = sorted((o for o in opens if i is not None and o[0] == i), key=lambda o: (o[1] or last, o[3] or dt.date.max, o[2] or last))
        n = 0
        for d in sorted(k[1] for k in rolled if k[0] == i):
            for _, credit, name, opened in own or [(None, None, None, None)]:
                n += 1
                flag = None if opened is None else int(opened > d)
                rows.append([i, d, credit, n, product(name) if own else None, flag, rolled[i, d]])
    longest = {}
    for r in rows:
        longest[r[2]] = max(longest.get(r[2], 0), r[3])
    cuts = {p: np.quantile([r[3] for r in rows if r[4] == p], [0.25, 0.5, 0.75]) for p in {r[4] for r in rows}}
    out = []
    for i, d, credit, n, p, flag, sums in rows:
        top = longest[credit]
        grupo = next((f"g{j + 1}" for j in range(3) if top <= cuts[p][j]), "g4")
        out.append((i, d, credit, n, p, flag, top, grupo, sums))
    return out


def key(r):
    return tuple("~" if x is None else str(x) for x in r)


@pytest.mark.parametrize("chunk", [4096, 7])
def test_panel_equals_brute_force(spark, chunk):
    moves, opens, m, o = bank(spark)
    panel = daily.duration_groups(daily.counted_panel(m, o, chunk))
    got = [
        (r["id_cliente"], r["fecha"], r["NO_CREDITO"], r["meses"], r["producto"], r["tenencia"], r["max_mes"], r["grupo"])
        for r in panel.collect()
    ]
    want = [w[:8] for w in brute_panel(moves, opens)]
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_panel_sums_are_zero_filled_after_the_strict_rollup(spark):
    moves, opens, m, o = bank(spark)
    got = daily.daily_panel(m, o).agg(*[F.sum(c) for c in daily.MEASURES]).first()
    want = np.sum([[0 if x is None else x for x in w[8]] for w in brute_panel(moves, opens)], axis=0)
    assert np.allclose(list(got), want)


def test_labels_and_quantiles_without_the_fan_out(spark):
    _, _, m, o = bank(spark)
    panel = daily.counted_panel(m, o)
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert key(daily.labels_of(m, o)) == key(daily.customer_labels(panel))
    days, credits, _, _ = daily._sides(m, o)
    assert key(daily.counter_quantiles(days, credits)) == key(daily.duration_quantiles(panel))


def test_labels_need_every_flag_known(spark):
    rows = [("a", 1, "1", "2", "2"), ("a", 1, "2", "2", "2"), ("b", 1, "2", "2", "2"), ("b", None, "2", "1", "2"), ("c", 0, "2", "2", "2"), (None, 1, "2", "2", "1")]
    panel = spark.createDataFrame(rows, "id_cliente string, tenencia int, tenencia_tdc string, tenencia_pp string, tenencia_dpf string")
    got = {r["id_cliente"]: tuple(r)[1:] for r in daily.customer_labels(panel).collect()}
    assert got == {"a": ("1", "1", "2", "2"), "b": ("2", "2", "1", "2"), "c": ("2", "2", "2", "2"), None: ("1", "2", "2", "1")}


def test_scoring_rows_are_shaped_like_training_rows(spark):
    rows = spark.createDataFrame([("a", 3, None, 1.0, None, 1.0, 2.0, None)], "id_cliente string, max_meses int, " + ", ".join(f"{c} double" for c in daily.MEASURES))
    got = daily.scoring_rows(rows, "max_meses")
    assert set(got.columns) == {"id_cliente", "max_mes", *daily.MEASURES}
    assert got.select(*daily.MEASURES).first() == (0.0, 1.0, 0.0, 1.0, 2.0, 0.0)


def test_training_rows_read_the_panel_a_few_times(spark):
    """Distance, split, stored training rows and the test rows: four times; the recipe and the sampling read what is stored."""
    rows = [(k, f"c{k % 40:02d}", *[float((k * p) % 97) for p in (3, 5, 7, 11, 13, 17)], "1" if k % 3 else "2", k % 50) for k in range(400)]
    names = "NO_CREDITO long, id_cliente string, " + ", ".join(f"{m} double" for m in daily.MEASURES) + ", tenencia_tdc string, max_mes long"
    read = spark.sparkContext.accumulator(0)

    def watch(parts):
        for part in parts:
            read.add(len(part))
            yield part

    train, test = daily.training_rows(spark.createDataFrame(rows, names).mapInPandas(watch, names))
    assert len(test.collect()) == 280 and 0 < len(train.collect()) <= 120
    assert read.value <= 4 * len(rows)


# ---- monthly ---------------------------------------------------------------------------------

C = "ID_CLIENTE string, DESC_PROFESION string, SALARIO double, VIDA double, RELACION1 string, ESTATUS string, PRODUCTO string, DESC_EDUCACION string, N_TC double, N_PP double, N_DPF double, JUBILADO string, RESIDENCIA_CORREGIMIENTO string"


def market(spark):
    rows = [
        ("1", "chef", 100.0, 5.0, "OTROS", "CANCELADA", "p", "TÉCNICOS", 0.0, 2.0, None, "0", "north"),
        ("2", "chef", None, None, "OTROS", "ACTIVA", "p", None, 1.0, 0.0, 0.0, "0", "south"),
        ("3", "cook", 300.0, 7.0, "OTROS", "CANCELADA", "p", "MEDIOS INCOMPLETOS", 2.0, None, 1.0, "0", None),
        ("4", None, 50.0, None, "HIPOTECA", "ACTIVA", "p", "OTRA", 0.0, 0.0, 0.0, "0", "north"),
        ("5", "poet", None, None, None, "ACTIVA", "p", "OTRA", 0.0, 0.0, 0.0, "0", "north"),
        ("6", "chef", 900.0, 1.0, "OTROS", "ACTIVA", "p", "OTRA", 0.0, 0.0, 0.0, "1", "north"),
        (None, "chef", 800.0, 1.0, "OTROS", "ACTIVA", "p", "OTRA", 0.0, 0.0, 0.0, "0", "north"),
    ]
    lookup = [("chef", "kitchen"), ("cook", "kitchen"), ("chef", "kitchen")]
    return (
        spark.createDataFrame(rows, C),
        spark.createDataFrame(lookup, "PROFESION string, OCUPACIONES string"),
        spark.createDataFrame([("north", 12.0)], "RESIDENCIA_CORREGIMIENTO string, Distancia_km double"),
    )


def test_monthly_features(spark):
    got = {r["ID_CLIENTE"]: r for r in monthly.monthly_features(*market(spark)).collect()}
    assert set(got) == {"1", "2", "3", "4", "5"}  # no retired customer, no missing id
    assert got["2"]["SALARIO1"] == 550.0  # median of 100, 300, 900, 800 in the kitchen group
    assert got["5"]["SALARIO1"] == 50.0  # unmatched and missing professions share a group
    assert (got["2"]["VIDA1"], got["4"]["VIDA1"], got["5"]["VIDA1"]) == (6.0, 0.0, 0.0)
    assert [got[i]["ANO_ESTUDIO"] for i in "12345"] == [15.0, 99.0, 10.0, 99.0, 99.0]
    assert [got[i]["N_PP1"] for i in "123"] == [1.0, 0.0, 0.0] and got["1"]["N_DPF1"] == 0.0
    assert [got[i]["Distancia_km"] for i in "123"] == [12.0, 0.0, 0.0]
    assert not set(got["1"].asDict()) & {"SALARIO", "VIDA", "mediana", "vida_util", "N_TC", "JUBILADO"}


def test_bin_labels_state_the_cut(spark):
    for cut, low, high in customer.CUTS.values():
        assert str(cut) in low and str(cut) in high


# ---- physical plans --------------------------------------------------------------------------

CHECKED = [
    "daily_rollup", "daily_panel", "customer_labels", "monthly_features", "salary_imputation", "panel_join", "auc_exact",
    "ibcf_predict", "score_customers", "hash_split", "downsample", "standardise", "semi_join_sample", "table_profile",
]


@pytest.mark.parametrize("name", CHECKED)
def test_plans_hold_no_cross_join_and_no_row_function(spark, plan_of, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_only_used_columns_are_read(spark, plan_of):
    plan = plan_of(QUERIES["customer_maximum"](spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan


def test_filters_reach_the_scan(spark, plan_of):
    plan = plan_of(QUERIES["bound_subsets"](spark, "/root/testdata/sf0.001"))
    assert "EqualTo(o_orderstatus,F)" in plan and "EqualTo(o_orderstatus,O)" in plan
