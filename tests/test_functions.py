"""Missing-value, parsing and recoding rules on rows made for them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from inclina.functions import aggregates as A
from inclina.functions import columns as C
from inclina.operators.projection import eligible, glance
from inclina.plans import monthly
from inclina.sources.delimited import read_delimited, write_table


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_decimal_comma_with_grouping(spark):
    assert column(spark, ["1.234,5", "1234,56", " 7 ", "x", None], "string", C.parse_decimal("x", ",")) == [1234.5, 1234.56, 7.0, None, None]


def test_decimal_point_with_grouping(spark):
    assert column(spark, ["1,234.5", "-3", ""], "string", C.parse_decimal("x")) == [1234.5, -3.0, None]


def test_null_tokens(spark):
    assert column(spark, ["NULL", "NA", "", "a", None], "string", C.nullify("x")) == [None, None, None, "a", None]


def test_flags_keep_missing(spark):
    assert column(spark, [0, 3, None], "int", C.tenure_flag("x")) == ["No", "Si", None]
    assert column(spark, [0, 3, None], "int", C.binary_flag("x")) == [0, 1, None]


def test_membership_of_missing_is_false(spark):
    assert column(spark, ["F", "Z", None], "string", C.is_in("x", ["F"])) == [True, False, False]
    assert column(spark, ["F", "Z", None], "string", C.whitelist("x", ["F"])) == ["F", "ND", "ND"]


def test_first_pattern_wins_and_missing_is_default(spark):
    rules = [("PERSONAL", "PP"), ("TARJETA", "TDC")]
    assert column(spark, ["TARJETA PERSONAL", "TARJETA", "X", None], "string", C.classify_by_pattern("x", rules, "OTRO")) == [
        "PP", "TDC", "OTRO", "OTRO",
    ]


def test_bins_are_right_closed(spark):
    bins = C.bin_by_cuts("x", [2, 5], ["low", "mid", "high"])
    assert column(spark, [2.0, 2.1, 5.0, 5.1, None], "double", bins) == ["low", "mid", "mid", "high", None]


def test_month_label_is_not_padded(spark):
    days = [dt.date(2019, 1, 5), dt.date(2019, 11, 5), None]
    assert column(spark, days, "date", C.year_month_label("x")) == ["2019_1", "2019_11", "NA_NA"]


def test_education_years(spark):
    values = [*monthly.STUDY_YEARS, "OTRA", None]
    got = column(spark, values, "string", C.recode("x", monthly.STUDY_YEARS, monthly.UNKNOWN_YEARS))
    assert got == [5, 8, 10, 12, 15, 15, 17, 99, 99]


def test_log_modes(spark):
    assert column(spark, [0.0, -5.0], "double", C.log_value("x")) == [0.0, None]
    assert column(spark, [0.0, 1.0], "double", C.log_value("x", "log")) == [None, 0.0]
    with pytest.raises(ValueError):
        C.log_value("x", "log2")


def test_zero_for_null_and_nan(spark):
    assert column(spark, [float("nan"), None, 2.0], "double", C.zero_if_missing("x")) == [0.0, 0.0, 2.0]


def test_strict_aggregates_are_missing_with_any_missing(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, x double")
    got = {r["k"]: tuple(r)[1:] for r in rows.groupBy("k").agg(A.strict_sum("x"), A.strict_min("x"), A.strict_max("x"), A.missing("x")).collect()}
    assert got == {"a": (None, None, None, 1), "b": (5.0, 2.0, 3.0, 0)}


def test_life_is_imputed_for_named_relations_only(spark):
    rows = spark.createDataFrame(
        [(1, None, "OTROS"), (2, None, "HIPOTECA"), (3, 4.0, "OTROS"), (4, None, None)], "i int, v double, r string"
    ).withColumn("stat", F.lit(9.0))
    got = rows.orderBy("i").select(C.impute_within("v", "r", monthly.RELATIONS, "stat")).collect()
    assert [r[0] for r in got] == [9.0, None, 4.0, None]


def test_life_median_uses_cancelled_relations(spark):
    rows = spark.createDataFrame(
        [("a", "OTROS", "CANCELADA", 4.0), ("b", "OTROS", "CANCELADA", 6.0), ("c", "OTROS", "ACTIVA", 100.0), ("d", "OTROS", "ACTIVA", None),
         ("e", "HIPOTECA", "ACTIVA", None), ("f", None, "ACTIVA", None)],
        "ID_CLIENTE string, RELACION1 string, ESTATUS string, VIDA double",
    )
    got = {r["ID_CLIENTE"]: r["VIDA1"] for r in monthly.impute_life(rows).collect()}
    assert got == {"a": 4.0, "b": 6.0, "c": 100.0, "d": 5.0, "e": None, "f": None}


def test_eligibility_drops_unknown_predicates(spark):
    rows = spark.createDataFrame([("1", "5", 30.0), ("1", None, 30.0), (None, "5", 30.0), ("1", "5", None), ("1", "5", 60.0)], "t string, p string, a double")
    assert eligible(rows, {"t": "1"}, {"p": ["100"]}, {"a": (21, 60)}).count() == 1


def test_delimited_text(spark, tmp_path):
    path = tmp_path / "raw.txt"
    path.write_text('a~b~c\n 1.234,5 ~ x ~"open\nNULL~NA~\nbad~é~z\n', encoding="utf-8")
    got = read_delimited(spark, str(path), ["n", "t", "u"], {"n": "double"}, mark=",").collect()
    assert [tuple(r) for r in got] == [(1234.5, "x", '"open'), (None, None, None), (None, "é", "z")]


def test_headerless_text(spark, tmp_path):
    path = tmp_path / "raw.txt"
    path.write_text("2019-01-02~1,5\n2019-13-40~2\n")
    got = read_delimited(spark, str(path), ["d", "x"], {"d": "date", "x": "double"}, header=False, mark=",").collect()
    assert [tuple(r) for r in got] == [(dt.date(2019, 1, 2), 1.5), (None, 2.0)]


def test_written_text_has_no_row_numbers(spark, tmp_path):
    write_table(spark.createDataFrame([(1, 2.5)], "a int, b double"), str(tmp_path / "o"), "csv", sep="~", mark=",", quoted=False)
    lines = [p.read_text().split() for p in (tmp_path / "o").glob("part-*.csv")]  # a part without rows may hold the header alone
    assert all(x[0] == "a~b" for x in lines) and [r for x in lines for r in x[1:]] == ["1~2,5"]


def test_glance(spark):
    assert [tuple(r) for r in glance(spark.createDataFrame([(1, "x")], "a int, b string")).collect()] == [(1, "a", "int"), (2, "b", "string")]


def test_any_text_survives_quoted_csv(spark, tmp_path):
    texts = ["a,b", 'say "hi"', "two\nlines", "\r\n", "", None, " padded ", "~", "\\", '\\"', "NULL", "NA", '"', ",", "é\t"]
    rows = [(i, t) for i, t in enumerate(texts)]
    for sep in (",", "~"):
        path = str(tmp_path / f"t{ord(sep)}")
        write_table(spark.createDataFrame(rows, "i int, t string").repartition(2), path, "csv", sep=sep)
        back = read_delimited(spark, path, ["i", "t"], {"i": "int"}, sep=sep, quoted=True)
        assert sorted(map(tuple, back.collect())) == rows


def test_unquoted_csv_refuses_separators(spark, tmp_path):
    import pytest

    with pytest.raises(Exception, match="separator"):
        write_table(spark.createDataFrame([("a~b",)], "t string"), str(tmp_path / "x"), "csv", sep="~", quoted=False)
