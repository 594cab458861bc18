"""Column expressions: casts, derived measurements, labels and code texts. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thirty days and six months, in minutes.
DAYS_30, MONTHS_6 = 30 * 24 * 60, 6 * 30 * 24 * 60


def literals(one_row: DataFrame) -> dict[str, Column]:
    """The cells of a table of one row as literals: an aggregate's few numbers go through the driver, no rows are joined."""
    row = one_row.first()
    return {f.name: F.lit(row[f.name]).cast(f.dataType) for f in one_row.schema.fields}


def strict_number(text: Column, kind: str = "double") -> Column:
    """Trimmed text as a number; text that is none raises an error; null stays null."""
    return F.trim(text).cast(kind)


def lenient_number(text: Column, kind: str = "double") -> Column:
    """Trimmed text as a number; null, blank and other text are null, and so is NaN."""
    value = F.trim(text.cast("string")).try_cast(kind)
    return F.when(~F.isnan(value.cast("double")), value)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def sex_is_male(sex: Column) -> Column:
    return sex == "M"


def bmi_of_table(weight_kg: Column, height_cm: Column) -> Column:
    """Null unless the height is above 10 cm."""
    return F.when(height_cm > 10, weight_kg / F.pow(height_cm / 100, F.lit(2)))


def bmi_of_subject(weight_kg: Column, height_cm: Column) -> Column:
    """Null if the height is below 0.1 m or the weight isn't positive; a height of exactly 10 cm counts here."""
    metres = height_cm / 100
    return F.when((metres >= 0.1) & (weight_kg > 0), weight_kg / F.pow(metres, F.lit(2)))


def minutes_between(start: Column, end: Column) -> Column:
    return end - start


def died_within(death_time: Column, orout_time: Column, minutes: int = DAYS_30) -> Column:
    """Whether death came before orout_time + minutes; false if either is unknown. Deaths before orout_time count."""
    return F.coalesce(death_time < orout_time + minutes, F.lit(False))


def normal_icd(code: Column) -> Column:
    """Upper case, without dots or blanks at the ends."""
    return F.upper(F.replace(F.trim(code), F.lit("."), F.lit("")))


def dotted_icd(code: Column) -> Column:
    """ABC.D for codes of over three characters."""
    plain = normal_icd(code)
    return F.when(F.length(plain) > 3, F.concat(F.substring(plain, 1, 3), F.lit("."), F.substring(plain, F.lit(4), F.length(plain)))).otherwise(plain)


def time_units(minutes: Column) -> dict[str, Column]:
    """Hours, days, weeks and years of 52 weeks."""
    per = {"hours": 60, "days": 60 * 24, "weeks": 60 * 24 * 7, "years": 60 * 24 * 7 * 52}
    return {name: minutes / n for name, n in per.items()}


def normal_frailty(label: Column) -> Column:
    plain = F.lower(F.trim(label))
    unknown = plain.isin("unknown(no diagnoses)", "unknown", "no diagnoses")
    return F.when(unknown, "unknown (no diagnoses)").when(plain == "intermediary", "intermediate").otherwise(plain)


def normal_outcome(label: Column) -> Column:
    plain = F.lower(F.trim(label))
    return F.when(plain.contains("die"), "died").when(plain.contains("surv"), "survived")


def atc_levels(code: Column) -> dict[str, Column]:
    """The keys of the five levels; null for codes of four characters or fewer and for those that begin with 0."""
    fit = (F.length(code) > 4) & ~code.startswith("0")
    return {f"level_{i}": F.when(fit, F.substring(code, 1, n)) for i, n in enumerate((1, 3, 4, 5, 7), 1)}
