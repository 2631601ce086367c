"""Expressions on text values: the numeric guard, sort keys, case-insensitive comparison, and quoting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what counts as a number.
NUMERIC = r"^[\t-\r ]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[\t-\r ]*$"
NUMERIC_WORD = r"^[\t-\r ]*((?i:nan)|[+-]?(?i:infinity))[\t-\r ]*$"


def number_of(v: Column) -> Column:
    """The value as a double, or null: plain and scientific notation, NaN and Infinity, white space around; no separators."""
    return F.when(v.rlike(f"{NUMERIC}|{NUMERIC_WORD}"), v.try_cast("double"))


def exact_of(num: Column) -> Column:
    """A double as the decimal that its digits show, or null if that has more than 16 digits before the point or 8 after it. Sums
    of such decimals round nothing and don't depend on the order of rows."""
    exact = num.try_cast("decimal(24,8)")
    return F.when(exact.cast("double") == num, exact)


def sort_key(v: Column) -> Column:
    """Blank, then numbers by value, then text: a total order that numbers, text and blanks have among themselves."""
    num = number_of(v)
    kind = F.when(v == "", 0).when(num.isNotNull(), 1).otherwise(2)
    ordered = F.struct((~F.isnan(num)).alias("real"), F.when(F.isnan(num), 0.0).otherwise(num).alias("value"))
    none = F.struct(F.lit(False).alias("real"), F.lit(0.0).alias("value"))
    return F.struct(kind.alias("kind"), F.coalesce(F.when(kind == 1, ordered), none).alias("num"), F.when(kind == 2, v).otherwise("").alias("text"))


def key_columns(df: DataFrame, v: Column, prefix: str) -> tuple[DataFrame, list[str]]:
    """df with the parts of a value's sort key as plain columns, which sorts compare without evaluating anything: the kind
    (blank, NaN, number, text), the number, and the text of what isn't one. The number is made first, so it is parsed once."""
    kind, num, text = (f"{prefix}_{x}" for x in ("kind", "num", "text"))
    df = df.withColumn(num, number_of(v))
    other = F.col(num).isNull()
    df = df.withColumns({kind: F.when(v == "", 0).when(other, 3).when(F.isnan(num), 1).otherwise(2), text: F.when(other, v).otherwise("")})
    return df, [kind, num, text]


def folded(v: Column) -> Column:
    """Compares without case."""
    return F.collate(v, "UTF8_LCASE")


def valid_regex(spark: SparkSession, pattern: str) -> tuple[bool, str | None]:
    """Whether Spark can run a pattern, and why not."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException) as e:
        return False, str(e)
    return True, None


def csv_field(v: Column) -> Column:
    return F.when(v.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def tsv_field(v: Column) -> Column:
    return F.translate(v, "\t\r\n", "   ")


def csv_value(v: str) -> str:
    return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\r\n') else v


def tsv_value(v: str) -> str:
    return v.translate({9: " ", 13: " ", 10: " "})


def shown_number(x: float) -> str:
    """At most four decimals, thousands separated; very large and very small numbers in scientific notation."""
    if abs(x) >= 1e12 or (x != 0 and abs(x) < 1e-4):
        mantissa, exponent = f"{x:.4e}".split("e")
        return f"{mantissa.rstrip('0').rstrip('.')}e{int(exponent):+d}"
    text = f"{x:,.4f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text
