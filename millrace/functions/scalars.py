"""Column expressions used by loads, reports and the generator; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def exact_sum(column: str | Column) -> Column:
    """Sum of money or quantities held as doubles, exact to the cent in any order of addition."""
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(c.cast(MONEY)).cast("double")


#: Fixed value: what of a connection string is its password.
PASSWORD = ":[^:]*@"


def mask_dsn(c: Column) -> Column:
    """A connection string without its password."""
    return F.regexp_replace(c, PASSWORD, ":***@")


def format_duration(seconds: Column) -> Column:
    """``1h 2m 3s``, without leading parts that are zero."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    text = lambda x: x.cast("long").cast("string")
    return F.when(h > 0, F.concat(text(h), F.lit("h "), text(m), F.lit("m "), text(r), F.lit("s"))).when(m > 0, F.concat(text(m), F.lit("m "), text(r), F.lit("s"))).otherwise(F.concat(text(r), F.lit("s")))


def size_pretty(size: Column) -> Column:
    """Bytes as PostgreSQL prints them: a unit is used from 10 of the next on, halves round up."""
    out = F.when(F.abs(size) < 10 * 1024, F.concat(size.cast("string"), F.lit(" bytes")))
    for k, unit in enumerate(("kB", "MB", "GB", "TB"), 1):
        scaled = F.floor((size + (1 << (10 * k - 1))) / F.lit(1 << (10 * k)).cast("double")).cast("long").cast("string")
        out = out.when(F.abs(size) < (20479 << (10 * k - 1)), F.concat(scaled, F.lit(f" {unit}"))) if unit != "TB" else out.otherwise(F.concat(scaled, F.lit(" TB")))
    return out


def to_int_half_even(x: Column) -> Column:
    """Float to int as PostgreSQL casts it, halves to even; a plain cast truncates."""
    return F.rint(x).cast("int")


def quote_identifier(c: Column) -> Column:
    """Quoted unless a plain lower-case name."""
    return F.when(c.rlike("^[a-z_][a-z0-9_]*$"), c).otherwise(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))
