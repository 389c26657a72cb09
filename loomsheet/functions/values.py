"""How values are typed, shown as text and measured; every operator uses these rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.StructType, T.MapType, T.VariantType)


def kind(dt: T.DataType) -> str:
    """The logical type of a Spark type."""
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, T.DecimalType):
        return "integer" if dt.scale == 0 else "float"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "float"
    for one, name in (
        (T.BooleanType, "boolean"), (T.TimestampType, "datetime"), (T.TimestampNTZType, "datetime"), (T.DateType, "date"), (T.BinaryType, "binary"),
        (T.ArrayType, "list"), (T.StructType, "struct"), (T.NullType, "null"),
    ):
        if isinstance(dt, one):
            return name
    return "time" if dt.typeName().startswith("time(") or dt.typeName() == "time" else "unknown"


def dtype(df: DataFrame, column: str) -> T.DataType:
    if column not in df.columns:
        raise ValueError(f"there is no column {column!r}; the columns are {', '.join(df.columns)}")
    return df.schema[column].dataType


def quoted(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(name: str, columns: list[str]) -> str:
    """A name like this one that no column starts with."""
    while any(c.startswith(name) for c in columns):
        name = f"_{name}"
    return name


def as_text(column: Column, dt: T.DataType) -> Column:
    """Strings as they are, nested values as JSON, others as Spark prints them."""
    if isinstance(dt, T.StringType):
        return column
    if isinstance(dt, NESTED):
        return F.to_json(column, {"ignoreNullFields": "false"})
    return column.cast("string")


def size_of(column: Column, dt: T.DataType) -> Column:
    """Items of a list, else characters of the text."""
    return F.array_size(column) if isinstance(dt, T.ArrayType) else F.char_length(as_text(column, dt))


def words_of(column: Column, dt: T.DataType) -> Column:
    """Pieces of a split on one space."""
    return F.size(F.split(as_text(column, dt), " ", -1))


def unicode(pattern: str, ignore_case: bool = False) -> str:
    """A pattern whose classes and case folding know all of Unicode."""
    return f"(?{'iu' if ignore_case else ''}U){pattern}"


def literal(text: str, ignore_case: bool = False) -> str:
    """A pattern that matches just this text."""
    return unicode("\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E", ignore_case)


def replacement(text: str) -> str:
    """A replacement in Java's dialect from one with ``$1 ${1} $name ${name} $$``."""
    out, k = [], 0
    while k < len(text):
        c = text[k]
        if c == "\\":
            out.append("\\\\")
        elif c == "$" and text[k + 1 : k + 2] == "$":
            out.append("\\$")
            k += 1
        elif c == "$":
            if text[k + 1 : k + 2] == "{" and "}" in text[k:]:
                end = text.index("}", k)
                name, k = text[k + 2 : end], end
            else:
                end = k + 1
                while end < len(text) and (text[end].isalnum() or text[end] == "_"):
                    end += 1
                name, k = text[k + 1 : end], end - 1
            if not name:
                out.append("\\$")
            elif name.isdigit():
                # Java would go on reading digits that follow, so the group stands alone.
                out.append(f"${name}" if not text[k + 1 : k + 2].isdigit() else f"${name}\\{text[k + 1]}")
                k += text[k + 1 : k + 2].isdigit()
            else:
                out.append(f"${{{name}}}")
        else:
            out.append(c)
        k += 1
    return "".join(out)


def verbatim(text: str) -> str:
    """A replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def typed(value, dt: T.DataType):
    """A value given as text, in the type of the column; text that can't be one stays text."""
    if not isinstance(value, str):
        return value
    what = kind(dt)
    try:
        if what == "integer":
            number = float(value)
            return int(value) if value.strip().lstrip("+-").isdigit() else int(number) if number == int(number) else number
        if what == "float":
            return float(value)
    except (ValueError, OverflowError):
        return value
    if what == "boolean":
        return value.strip().lower() in ("true", "1", "yes")
    return value


def constant(value, dt: T.DataType) -> Column:
    """A typed literal that can be compared with a column of the type."""
    value = typed(value, dt)
    what = kind(dt)
    if isinstance(value, str) and what in ("integer", "float", "boolean"):
        raise ValueError(f"{value!r} is not a value of type {what}")
    if what in ("date", "datetime") and isinstance(value, str):
        return F.lit(value).try_cast(dt)
    return F.lit(value)


def coerced(value, dt: T.DataType) -> Column:
    """An edited value as a literal of the column's type, or a readable error."""
    if value is None:
        return F.lit(None).cast(dt)
    what = kind(dt)
    try:
        if what == "integer":
            number = float(value)
            if number != int(number):
                raise ValueError
            return F.lit(int(value) if isinstance(value, (int, str)) and str(value).strip().lstrip("+-").isdigit() else int(number)).cast(dt)
        if what == "float":
            return F.lit(float(value)).cast(dt)
        if what == "boolean":
            if isinstance(value, str):
                if value.strip().lower() not in ("true", "false", "1", "0", "yes", "no"):
                    raise ValueError
                value = value.strip().lower() in ("true", "1", "yes")
            return F.lit(bool(value))
        if what in ("date", "datetime"):
            import datetime

            if isinstance(value, str):
                value = datetime.datetime.fromisoformat(value)
            return F.lit(value).cast(dt)
    except (ValueError, TypeError, OverflowError):
        raise ValueError(f"{value!r} is not a value of type {what}") from None
    if isinstance(dt, T.StringType):
        return F.lit(value if isinstance(value, str) else str(value))
    return F.lit(value).cast(dt)


def hashable(df: DataFrame) -> list[Column]:
    """The columns that Spark can hash: all but those with maps or variants."""
    return [quoted(f.name) for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))] or [F.lit(0)]
