"""Named predicates; where the field has several definitions, each has its own name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truthy(x: Column) -> Column:
    """Neither null nor zero."""
    return x.isNotNull() & (x != 0)


def is_stub(fatal: Column, scenario: Column, rep: Column) -> Column:
    """A failure record without a trial."""
    return fatal.isNotNull() | scenario.isNull() | rep.isNull()


def dnf_prefix(flag: Column, reason: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(reason.startswith("DNF"), F.lit(False))


def dnf_word(flag: Column, reason: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.lower(reason).rlike("dnf|error"), F.lit(False))


def finished_text(flag: Column) -> Column:
    """In exported text, where flags are ``True`` or ``False``."""
    return flag.isNull() | (flag != "True")


def cut_short(reason: Column) -> Column:
    return F.coalesce(F.lower(reason).contains("length"), F.lit(False))


def zero_output_stall(reason: Column, tokens: Column, trace_len: Column) -> Column:
    return (reason == "DNF:stall") & (F.coalesce(tokens, F.lit(0)) == 0) & (F.coalesce(trace_len, F.lit(0)) == 0)


def functional_energy(energy: Column, dnf: Column, wall_s: Column | None = None) -> Column:
    """Measured energy of a finished run; one definition also wants a positive duration."""
    keep = (energy > 0) & ~F.coalesce(dnf, F.lit(False))
    return keep if wall_s is None else keep & (wall_s > 0)


def is_baseline(model: Column) -> Column:
    return model.startswith("baseline")


def numeric(value: Column) -> Column:
    """The number that a JSON text is, flags being 1 and 0; null for texts, lists, objects and null."""
    text = F.trim(value)
    return F.when(text == "true", 1.0).when(text == "false", 0.0).when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), text.try_cast("double"))


def safe_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$")


def contains_ci(value: Column, needle: str) -> Column:
    return F.lower(value).contains(needle.lower())


def exclude(rows: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    return rows.filter(~F.col(key).isin(list(values)) | F.col(key).isNull()) if values else rows
