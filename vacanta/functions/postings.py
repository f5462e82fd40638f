"""Column expressions over the nested posting document."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructType

from vacanta.schemas import POSTING_SCHEMA, SKILL_FIELDS

NO_STRINGS = "array<string>"


def zero_filled(path: str, schema: StructType = POSTING_SCHEMA) -> Column:
    """The document at a column path with '', 0 and false for missing scalars. Missing lists stay NULL.

    Written as one SQL text, since building some three hundred column objects takes seconds.
    """
    return F.expr(_zero_struct(path, schema))


def _zero_struct(path: str, schema: StructType) -> str:
    return f"named_struct({', '.join(f"'{f.name}', {_zero_field(f'{path}.{f.name}', f.dataType)}" for f in schema.fields)})"


def _zero_field(path: str, kind) -> str:
    if isinstance(kind, StructType):
        return _zero_struct(path, kind)
    if isinstance(kind, ArrayType):
        return f"transform({path}, x -> coalesce(x, ''))"
    if isinstance(kind, LongType):
        return f"coalesce({path}, 0L)"
    if isinstance(kind, BooleanType):
        return f"coalesce({path}, false)"
    return f"coalesce({path}, '')"


def list_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.array().cast(NO_STRINGS))


def join_list(col: Column, separator: str) -> Column:
    return F.coalesce(F.array_join(col, separator), F.lit(""))


def flat_skills(posting: Column) -> Column:
    """All six skill lists as one list, blanks and duplicates included."""
    tech = posting.getField("requirements").getField("technical_skills")
    return F.concat(*[list_or_empty(tech.getField(name)) for name in SKILL_FIELDS])


def skill_counts(posting: Column) -> tuple[Column, Column]:
    """Number of required technical skills and of nice-to-have items."""
    nice = list_or_empty(posting.getField("requirements").getField("nice_to_have"))
    return F.size(flat_skills(posting)).cast("bigint"), F.size(nice).cast("bigint")


def salary_text(low: Column, high: Column, currency: Column) -> Column:
    """'min-max currency' as listed: '' when a bound is NULL, a trailing blank without a currency."""
    return F.coalesce(
        F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" "), F.coalesce(currency, F.lit(""))),
        F.lit(""),
    )
