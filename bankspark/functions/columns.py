"""Column expressions shared by the operators. All stay inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from bankspark.sources import dims


def nvl(first: Column, second: Column) -> Column:
    return F.coalesce(first, second)


def all_of(*conditions: Column) -> Column:
    """AND of the given conditions; true when there are none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def is_active(status: Column) -> Column:
    """A product is active unless its status is one of the closed ones."""
    return ~status.isin(*dims.CLOSED_STATUSES)


def is_staff(role: Column) -> Column:
    return F.coalesce(role.isin(*dims.STAFF_ROLES), F.lit(False))


def is_senior(role: Column) -> Column:
    return F.coalesce(role.isin(*dims.SENIOR_ROLES), F.lit(False))


def yes_no(flag: Column) -> Column:
    """'Y' stays 'Y', everything else including NULL becomes 'N'."""
    return F.when(flag == "Y", "Y").otherwise("N")


def country_label(code: Column) -> Column:
    """Country name for an account page; an unknown code is shown as it is."""
    return (
        F.when(code == "BGR", "Bulgaria").when(code == "USA", "United States").when(code == "OTH", "Other").otherwise(code)
    )


def contract_country(code: Column) -> Column:
    """Country name inside a contract; everything else is the code OTH."""
    return F.when(code == "BGR", "Bulgaria").when(code == "USA", "United States").otherwise("OTH")


def address_line(address: Column, country_code: Column) -> Column:
    """Address as written in a contract. NULL and '' both count as missing."""
    country = contract_country(country_code)
    has_address = F.coalesce(address != "", F.lit(False))
    return (
        F.when((country == "OTH") & has_address, address)
        .when(country == "OTH", "Not Specified")
        .when(has_address, F.concat(address, F.lit(", "), country))
        .otherwise(F.concat(F.lit("in "), country))
    )


def standard_label(flag: Column) -> Column:
    return F.when(flag == "Y", "Standard").otherwise("Custom")


def moment(as_of) -> Column:
    """A date or datetime as a timestamp without zone; through text, so no time zone shifts it."""
    return F.lit(str(as_of)).cast("timestamp_ntz")


def day(as_of) -> Column:
    """The day of a date or datetime."""
    return moment(as_of).cast("date")


def long_date(day: Column) -> Column:
    """Date as 'May 05, 2024'."""
    return F.date_format(day, "MMMM dd, yyyy")


def shown_date(day: Column) -> Column:
    """Date as '2024-05-05', or 'Unspecified'."""
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("Unspecified"))


def verification_badge(code: Column) -> Column:
    emojis = {row[0]: row[2] for row in dims.VERIFICATIONS}
    return F.create_map(*[F.lit(x) for pair in emojis.items() for x in pair])[code]


def attribute_text(column_type: Column, prefix: str = "") -> Column:
    """The one value of an attribute row that its type says, as text."""
    c = lambda name: F.col(prefix + name)
    return (
        F.when(column_type == "integer", c("int_value").cast("string"))
        .when(column_type == "float", c("float_value").cast("string"))
        .when(column_type.isin("char", "varchar"), c("varchar_value"))
        .when(column_type == "text", c("text_value"))
        .when(column_type == "date", long_date(c("date_value")))
        .when(column_type == "datetime", F.date_format(c("datetime_value"), "MMMM dd, yyyy HH:mm:ss"))
    )


def typed_defaults(column_type: Column, default: Column) -> dict[str, Column]:
    """Default text of an attribute in the typed column its type says; dirty text gives NULL."""
    return {
        "int_value": F.when(column_type == "integer", default.try_cast("bigint")),
        "float_value": F.when(column_type == "float", default.try_cast("double")),
        "varchar_value": F.when(column_type.isin("char", "varchar"), default),
        "text_value": F.when(column_type == "text", default),
        "date_value": F.when(column_type == "date", default.try_cast("date")),
        "datetime_value": F.when(column_type == "datetime", default.try_cast("timestamp_ntz")),
    }
