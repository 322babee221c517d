"""Column expressions: recodes, flags, dates, parsing and hashing. No Python runs per row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- text to value -------------------------------------------------------------------------


def nullify(c: Column | str, tokens: Iterable[str] = ("NULL", "NA", "")) -> Column:
    """Null for any of the null tokens, else the text itself."""
    c = _col(c)
    return F.when(~c.isin(list(tokens)), c)


def parse_decimal(c: Column | str, mark: str = ".", grouping: str | None = None) -> Column:
    """Text number in a decimal-point or decimal-comma locale to double; null when unreadable."""
    grouping = grouping if grouping is not None else ("." if mark == "," else ",")
    text = F.replace(F.trim(_col(c)), F.lit(grouping), F.lit("")) if grouping else F.trim(_col(c))
    if mark != ".":
        text = F.replace(text, F.lit(mark), F.lit("."))
    return text.try_cast("double")


# ---- flags and recodes -----------------------------------------------------------------------


def tenure_flag(c: Column | str) -> Column:
    """0 becomes 'No', any other number 'Si'; null stays null."""
    c = _col(c)
    return F.when(c == 0, "No").when(c != 0, "Si")


def binary_flag(c: Column | str) -> Column:
    """0 stays 0, any other number becomes 1; null stays null."""
    c = _col(c)
    return F.when(c == 0, F.lit(0)).when(c != 0, F.lit(1))


def is_in(c: Column | str, values: Sequence) -> Column:
    """Membership test that is false, never null, for a null value."""
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def recode(c: Column | str, mapping: Mapping, default=None) -> Column:
    """Value-to-value recode; the default also catches null."""
    c = _col(c)
    out = F
    for source, target in mapping.items():
        out = out.when(c == F.lit(source), F.lit(target))
    return out.otherwise(F.lit(default)) if mapping else F.lit(default)


def whitelist(c: Column | str, allowed: Sequence[str], other: str = "ND") -> Column:
    """The value when allowed, else ``other`` (also for null)."""
    c = _col(c)
    return F.when(c.isin(list(allowed)), c).otherwise(F.lit(other))


def classify_by_pattern(c: Column | str, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first regular expression found in the text, else ``default``."""
    c = _col(c)
    out = F
    for pattern, label in rules:
        out = out.when(c.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(default))


def bin_by_cuts(c: Column | str, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed intervals: label i for value <= cuts[i], the last label above every cut."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("one label more than cuts is needed")
    c = _col(c)
    out = F
    for cut, label in zip(cuts, labels):
        out = out.when(c <= F.lit(cut), F.lit(label))
    return out.when(c > F.lit(cuts[-1]), F.lit(labels[-1]))


def impute_within(c: Column | str, group: Column | str, groups: Sequence[str], value: Column | str) -> Column:
    """``value`` for a null measure whose group is one of ``groups``; the measure otherwise."""
    c = _col(c)
    return F.when(c.isNull() & is_in(group, groups), _col(value)).otherwise(c)


# ---- numbers ---------------------------------------------------------------------------------


def zero_if_missing(c: Column | str) -> Column:
    """0 for null and for NaN."""
    c = _col(c).cast("double")
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def log_value(c: Column | str, mode: str = "log1p") -> Column:
    """Natural log: ``log1p`` suits zero-filled balances, ``log`` is null at or below 0."""
    c = _col(c)
    if mode == "log1p":
        return F.when(c > -1, F.log1p(c))
    if mode == "log":
        return F.when(c > 0, F.log(c))
    raise ValueError(f"unknown log mode {mode!r}")


# ---- dates -----------------------------------------------------------------------------------


def year_month_label(c: Column | str) -> Column:
    """``2019_1`` style label without padding; a null date reads ``NA_NA``."""
    c = _col(c)
    part = lambda p: F.coalesce(p.cast("string"), F.lit("NA"))
    return F.concat_ws("_", part(F.year(c)), part(F.month(c)))


def holding_flag(opened: Column | str, day: Column | str) -> Column:
    """1 on days before the product is opened (a buyer to be), 0 from then on, null if unknown."""
    opened, day = _col(opened), _col(day)
    return F.when(opened <= day, F.lit(0)).when(opened > day, F.lit(1))


def product_label(product: Column | str, flag: Column | str, wanted: str) -> Column:
    """'1' on the days that precede an opening of the wanted product, '2' otherwise."""
    return F.when((_col(product) == F.lit(wanted)) & (_col(flag) == 1), "1").otherwise("2")


# ---- hashing ---------------------------------------------------------------------------------


def hash_text(key: Column | str, *salt) -> Column:
    """md5 of ``salt:...:key`` as 32 hex digits; the same value in every engine and partitioning."""
    parts = [F.lit(str(s)) for s in salt] + [_col(key).cast("string")]
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(key: Column | str, buckets: int, *salt) -> Column:
    """Bucket 0..buckets-1 from the first eight hex digits of the salted md5."""
    return F.conv(F.substring(hash_text(key, *salt), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


# ---- whole-frame helpers ---------------------------------------------------------------------


def map_columns(df: DataFrame, names: Iterable[str], fn) -> DataFrame:
    """Apply one column function to many columns in a single projection."""
    return df.withColumns({n: fn(F.col(n)) for n in names})


def apply_types(df: DataFrame, types: Mapping[str, str], mark: str = ".") -> DataFrame:
    """Convert text columns; unreadable values become null, columns not named are kept."""
    changed = {}
    for name, kind in types.items():
        numeric = kind in ("double", "float")
        changed[name] = parse_decimal(name, mark) if numeric else F.col(name).try_cast(kind)
    return df.withColumns(changed)
