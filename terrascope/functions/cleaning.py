"""Column expressions that clean raw text fields. All of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Property type labels of the sales file, lower case.
PROPERTY_TYPE_LABELS = {
    "MAISON": ["maison"],
    "APPARTEMENT": ["appartement"],
    "DEPENDANCE": ["dépendance", "dependance"],
    "LOCAL": [
        "local industriel. commercial ou assimilé",
        "local industriel commercial ou assimile",
        "local",
    ],
}


def blank_to_null(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return blank_to_null(c).isNull()


def clean_text(c: Column) -> Column:
    """Trim, drop every double quote, empty becomes NULL."""
    return F.nullif(F.replace(F.trim(c), F.lit('"'), F.lit("")), F.lit(""))


def parse_int(c: Column) -> Column:
    """Whole numbers only: "3.7", blanks and garbage give NULL."""
    text = F.trim(c)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def parse_double(c: Column) -> Column:
    """Decimal comma or point; blanks and garbage give NULL."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def strip_quotes(c: Column) -> Column:
    """Remove one pair of surrounding quotes."""
    text = F.trim(c)
    quoted = (F.length(text) >= 2) & text.startswith('"') & text.endswith('"')
    return F.when(quoted, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def parse_money(c: Column) -> Column:
    """Decimal(15,2) from text with a decimal comma; NULL when it cannot be read."""
    text = F.replace(F.replace(c, F.lit(","), F.lit(".")), F.lit('"'), F.lit(""))
    return F.trim(text).try_cast("decimal(15,2)")


def parse_sale_date(c: Column) -> Column:
    """Strict yyyy-MM-dd date; NULL otherwise."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def parcel_section(c: Column) -> Column:
    """The four characters before the last four of a parcel id of at least eight characters."""
    return F.when(F.length(c) >= 8, F.trim(F.substring(c, F.length(c) - 7, F.lit(4))))


def parcel_plan(c: Column) -> Column:
    return F.when(F.length(c) >= 8, F.right(c, F.lit(4)))


def parcel_rejected(c: Column) -> Column:
    """Parcel ids of six or seven characters make their whole row invalid."""
    return F.coalesce(F.length(c).isin(6, 7), F.lit(False))


def split_parcel(c: Column) -> Column:
    return F.struct(parcel_section(c).alias("section"), parcel_plan(c).alias("plan_number"))


def map_property_type(c: Column) -> Column:
    label = F.lower(c)
    out = F
    for code, labels in PROPERTY_TYPE_LABELS.items():
        out = out.when(label.isin(labels), F.lit(code))
    return out


def full_insee_code(commune: Column, dept: Column) -> Column:
    """Commune codes of five characters pass; shorter ones are completed with the department."""
    commune, dept = F.trim(commune), F.trim(dept)
    # lpad would cut longer text, so pad only what is short
    dept2 = F.when(F.length(dept) == 1, F.concat(F.lit("0"), dept)).otherwise(dept)
    commune3 = F.when(F.length(commune) < 3, F.lpad(commune, 3, "0")).otherwise(commune)
    return F.when(F.length(commune) >= 5, commune).otherwise(F.concat(dept2, commune3))


def address_line(number: Column, street_type: Column, postal: Column, city: Column) -> Column:
    """`number type, postal city`, leaving out what is missing."""
    def present(c):
        return F.nullif(c, F.lit(""))

    street = present(F.concat_ws(" ", present(number), present(street_type)))
    place = F.concat_ws(" ", present(postal), present(city))
    return F.when(street.isNotNull(), F.concat(street, F.lit(", "), place)).otherwise(place)
