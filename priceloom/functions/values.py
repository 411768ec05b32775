"""Tolerant parsing and normalisation of single values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from priceloom import schema as S


def trim_upper(value: Column) -> Column:
    return F.upper(F.trim(value.cast("string")))


def empty_to_missing(value: Column, missing: str = S.MISSING) -> Column:
    text = value.cast("string")
    return F.when(text.isNull() | text.isin(S.EMPTY_TOKENS), F.lit(missing)).otherwise(text)


def map_value(value: Column, mapping: dict[str, str]) -> Column:
    """One lookup, no chaining; values outside the dictionary stay."""
    if not mapping:
        return value
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(table, value), value)


def locale_number(value: Column, percent_sign: bool = True) -> Column:
    """``"12,5"`` and ``"19,6%"`` to doubles; anything unreadable or null to 0."""
    text = F.replace(value.cast("string"), F.lit(","), F.lit("."))
    if percent_sign:
        text = F.replace(text, F.lit("%"), F.lit(""))
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def tolerant_number(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def vat_rate(value: Column) -> Column:
    """Rates above 1 are percentages; exactly 1 stays 100 %."""
    rate = locale_number(value)
    return F.when(rate > 1, rate / 100).otherwise(rate)


def price_without_vat(price: Column, vat: Column | None) -> Column:
    amount = locale_number(price, percent_sign=False)
    return amount if vat is None else amount / (F.lit(1.0) + F.greatest(vat_rate(vat), F.lit(0.0)))


DATE_FORMATS = ["dd-MM-yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy", "yyyy/MM/dd"]


def parse_date(value: Column, formats: list[str] | None = None) -> Column:
    """First format that reads the text wins; empty tokens and failures are null."""
    text = F.trim(value.cast("string"))
    text = F.when(~text.isin(S.DATE_EMPTY_TOKENS), text)
    attempts = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in formats or DATE_FORMATS]
    return F.coalesce(*attempts).cast("date")


def date_failed(value: Column, parsed: Column) -> Column:
    """A non-null value that did not parse."""
    return value.isNotNull() & parsed.isNull()


def sentinel(value: Column) -> Column:
    return F.coalesce(value, F.lit(S.SENTINEL_DATE).cast("date"))


def day_first_text(value: Column) -> Column:
    return F.date_format(value, "dd-MM-yyyy")


def is_present(value: Column, null_tokens: list[str] | None = None) -> Column:
    """Not null and, when tokens are given, not one of the spellings of absence."""
    if not null_tokens:
        return value.isNotNull()
    return value.isNotNull() & ~F.trim(value.cast("string")).isin(null_tokens)


def present_flag(value: Column) -> Column:
    """1 when the value is neither null nor blank."""
    return F.coalesce((F.trim(value.cast("string")) != "").cast("int"), F.lit(0))


def any_present_flag(values: list[Column], null_tokens: list[str] | None = None) -> Column:
    if not values:
        return F.lit(0)
    found = is_present(values[0], null_tokens)
    for value in values[1:]:
        found = found | is_present(value, null_tokens)
    return found.cast("int")


def _warning(feature: str, text: Column, target: str) -> Column:
    return F.format_string(f"Could not convert {feature}=%s to {target}", F.coalesce(text, F.lit("None")))


def request_flag(value: Column, feature: str) -> Column:
    """Request text to ``struct(value, warning)`` for a 0/1 feature."""
    text = F.lower(F.trim(value))
    number = text.try_cast("double")
    known = text.isin(S.TRUE_TOKENS + S.FALSE_TOKENS) | number.isNotNull()
    flag = (
        F.when(text.isin(S.TRUE_TOKENS), 1)
        .when(text.isin(S.FALSE_TOKENS), 0)
        .when(number.isNotNull() & (number != 0), 1)
        .otherwise(0)
    )
    warning = F.when(~F.coalesce(known, F.lit(False)), _warning(feature, value, "int, using 0"))
    return F.struct(flag.alias("value"), warning.alias("warning"))


def request_count(value: Column, feature: str) -> Column:
    """Request text to ``struct(value, warning)``, truncating toward zero."""
    number = F.trim(value).try_cast("double").try_cast("int")
    warning = F.when(number.isNull(), _warning(feature, value, "int, using 0"))
    return F.struct(F.coalesce(number, F.lit(0)).alias("value"), warning.alias("warning"))


def request_measure(value: Column, feature: str) -> Column:
    number = F.trim(value).try_cast("double")
    warning = F.when(number.isNull(), _warning(feature, value, "float, using 0.0"))
    return F.struct(F.coalesce(number, F.lit(0.0)).alias("value"), warning.alias("warning"))


def request_category(value: Column) -> Column:
    """Trimmed, upper-cased text; the vocabulary is upper case, so this is its spelling too."""
    return F.coalesce(trim_upper(value), F.lit(S.MISSING))


def unknown_category(value: Column, feature: str) -> Column:
    """True when the normalised value is outside the vocabulary of the feature."""
    return ~value.isin(S.KNOWN_CATEGORIES[feature]) if feature in S.KNOWN_CATEGORIES else F.lit(False)


def strip_log_timestamp(line: Column) -> Column:
    return F.regexp_replace(F.trim(line), r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\s*-\s*", "")


def pair_key(family: Column, siren: Column) -> Column:
    client = F.when(siren.isNull() | siren.isin("nan", "None", ""), F.lit("UNKNOWN")).otherwise(siren)
    return F.concat_ws("__", F.coalesce(family, F.lit("UNKNOWN")), client)


def pair_family(key: Column) -> Column:
    return F.split_part(key, F.lit("__"), F.lit(1))


def pair_client(key: Column) -> Column:
    return F.split_part(key, F.lit("__"), F.lit(2))


def model_key(name: Column) -> Column:
    """Registry spelling of a name; used when saving and when looking up."""
    return F.regexp_replace(name, r"[^a-zA-Z0-9_]", "_")


def log_price(price: Column) -> Column:
    return F.log1p(price)


def price_from_log(value: Column) -> Column:
    return F.expm1(value)


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return F.when(value.isNull(), None).otherwise(F.greatest(F.least(value, high), low))


def price_delta(base: Column, new: Column) -> Column:
    return F.round(new - base, 6)


def percent_delta(base: Column, new: Column) -> Column:
    return F.round(F.try_divide(new - base, base) * 100, 4)


def stable_hash(key: Column) -> Column:
    """52 hash bits of a key as a bigint: every value is exact as a double too."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint")
