"""Column expressions: casts, conditionals, recoding, means, model names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short model codes and the public names they stand for.
MODEL_NAMES = {
    "gpt2": "gpt2",
    "gpt2m": "gpt2-medium",
    "gpt2l": "gpt2-large",
    "gpt2xl": "gpt2-xl",
}
# Family prefix of locally trained replicas, and where a replica lives.
REPLICA_FAMILY = "100M"
REPLICA_PATH = "models/%s/checkpoint-%s"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """Text to double; bad text and NaN become NULL."""
    value = _col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Division that gives NULL for a zero denominator."""
    return _col(numerator) / F.nullif(_col(denominator), F.lit(0.0))


def mean_strict(c: str | Column) -> Column:
    """Mean that is NULL as soon as one value of the group is missing."""
    value = _col(c)
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def pair_difference(prefix: str = "", suffix: str = "") -> Column:
    """Prepositional minus double-object value of one pair."""
    return F.col(f"{prefix}PDsentence{suffix}") - F.col(f"{prefix}DOsentence{suffix}")


def choose(selector: str | Column, options: Mapping[str, str | Column]) -> Column:
    """Value of the option named by ``selector``; NULL when none matches."""
    chosen = None
    for label, value in options.items():
        test = _col(selector) == F.lit(label)
        chosen = F.when(test, _col(value)) if chosen is None else chosen.when(test, _col(value))
    return chosen


def answered_correctly(score: str | Column, kind: str | Column, low: str = "low") -> Column:
    """1 when a low item scored below zero or any other item above it, else 0; NULL stays NULL."""
    z = _col(score)
    hit = F.when(_col(kind) == F.lit(low), z < 0).otherwise(z > 0)
    return F.when(z.isNotNull() & _col(kind).isNotNull(), hit.cast("int"))


def recode(c: str | Column, renames: Mapping[str, str]) -> Column:
    """Replace listed values and keep all others."""
    value = _col(c)
    table = F.create_map(*[F.lit(v) for kv in renames.items() for v in kv])
    return F.coalesce(table[value], value)


def level_position(c: str | Column, levels: Sequence[str]) -> Column:
    """1-based position in an explicit category order; NULL for unlisted values."""
    table = F.create_map(*[x for i, v in enumerate(levels, 1) for x in (F.lit(v), F.lit(i))])
    return table[_col(c)]


def row_mean(columns: Sequence[str | Column]) -> Column:
    """Mean across columns of one row, skipping missing values."""
    cols = [_col(c) for c in columns]
    total, present = F.lit(0.0), F.lit(0)
    for c in cols:
        total = total + F.coalesce(c, F.lit(0.0))
        present = present + c.isNotNull().cast("int")
    return total / F.nullif(present, F.lit(0))


def model_family(code: str | Column) -> Column:
    """Part of a model code before its first underscore."""
    return F.substring_index(_col(code), "_", 1)


def model_name(code: str | Column, checkpoint: str | Column) -> Column:
    """Loadable name of a model code; NULL when the code is not known."""
    value = _col(code)
    table = F.create_map(*[F.lit(v) for kv in MODEL_NAMES.items() for v in kv])
    mark = F.lit(checkpoint) if isinstance(checkpoint, str) else checkpoint
    replica = F.when(
        model_family(value) == F.lit(REPLICA_FAMILY), F.format_string(REPLICA_PATH, value, mark)
    )
    return F.coalesce(table[value], replica)
