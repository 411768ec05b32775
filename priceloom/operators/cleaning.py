"""From the consolidated to the cleaned table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom import schema as S
from priceloom.functions import values as V
from priceloom.functions.distribution import melted_counts, quantiles
from priceloom.functions.scale import join_lookup, settle
from priceloom.operators.consolidate import string_columns
from priceloom.sources.readers import require_columns


def project_keep_list(df: DataFrame, keep: Sequence[str] = tuple(S.KEEP_COLUMNS)) -> DataFrame:
    return df.select(*[c for c in keep if c in df.columns])


def str_trim_upper(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = string_columns(df) if columns is None else [c for c in columns if c in df.columns]
    return df.withColumns({c: V.trim_upper(F.col(c)) for c in names})


def normalize_empty_tokens(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: V.empty_to_missing(F.col(c)) for c in columns if c in df.columns})


def validate_mappings(mappings: Mapping[str, Mapping[str, str]]) -> None:
    for column, mapping in mappings.items():
        for key, value in mapping.items():
            if not isinstance(key, str) or not isinstance(value, str):
                raise ValueError(f"Invalid mapping entry for {column}: {key} -> {value}")


def map_values(df: DataFrame, mappings: Mapping[str, Mapping[str, str]] = S.VALUE_MAPS) -> DataFrame:
    """Empty tokens to ``MISSING`` first, then one dictionary lookup per column."""
    validate_mappings(mappings)
    return df.withColumns(
        {c: V.map_value(V.empty_to_missing(F.col(c)), m) for c, m in mappings.items() if c in df.columns}
    )


def flag_present(df: DataFrame, columns: Sequence[str] = tuple(S.ISBN_COLUMNS)) -> DataFrame:
    return df.withColumns({c: V.present_flag(F.col(c)) for c in columns if c in df.columns})


def flag_any_present(
    df: DataFrame,
    sources: Mapping[str, Sequence[str]] = S.FLAG_SOURCES,
    null_tokens: Sequence[str] | None = None,
) -> DataFrame:
    """0/1 flags over groups of columns; a group without columns gives 0 and ``MISSING`` columns."""
    flags, absent = {}, {}
    for flag, columns in sources.items():
        present = [c for c in columns if c in df.columns]
        flags[flag] = V.any_present_flag([F.col(c) for c in present], list(null_tokens or []))
        if not present:
            absent |= {c: F.lit(S.MISSING) for c in columns}
    return df.withColumns(flags | absent)


def fill_typed(df: DataFrame) -> DataFrame:
    """Fills of the first step; a column keeps its type when the fill fits it."""
    fills: dict[str, object] = {}
    fills |= {c: 0 for c in S.FILL_ZERO}
    fills |= {c: -1 for c in S.FILL_MINUS_ONE}
    fills |= {c: 1 for c in S.FILL_ONE}
    fills |= {c: S.MISSING for c in S.FILL_MISSING}
    types = {f.name: f.dataType for f in df.schema.fields}
    changes = {}
    for name, value in fills.items():
        if name not in types:
            continue
        column = F.col(name)
        if isinstance(types[name], T.StringType) or isinstance(value, str):
            changes[name] = F.coalesce(column.cast("string"), F.lit(str(value)))
        else:
            changes[name] = F.coalesce(column, F.lit(value).cast(types[name]))
    return df.withColumns(changes)


def initial_cleaning(df: DataFrame, null_tokens: Sequence[str] | None = None) -> DataFrame:
    kept = flag_present(project_keep_list(df))
    return require_columns(fill_typed(flag_any_present(kept, null_tokens=null_tokens)))


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with one distinct value or none, null counted as a value.

    One pass of minima, maxima and null counts; no distinct sets are built. The
    single result row is what decides the schema, so it is read on the driver.
    """
    probes = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        probes.append(
            F.struct(
                (F.min(col).eqNullSafe(F.max(col))).alias("same"),
                F.count_if(col.isNull()).alias("nulls"),
                F.count(col).alias("filled"),
            ).alias(c)
        )
    row = df.agg(*probes).first()
    return [c for c in df.columns if row[c]["same"] and (row[c]["nulls"] == 0 or row[c]["filled"] == 0)]


def drop_constant_columns(
    df: DataFrame, keep: Sequence[str] = tuple(S.CONSTANT_COLUMNS_TO_KEEP)
) -> DataFrame:
    return df.drop(*[c for c in constant_columns(df) if c not in keep])


def clean_dates(df: DataFrame, columns: Sequence[str] = tuple(S.DATE_COLUMNS)) -> DataFrame:
    """Parse to real dates; an unreadable or absent date becomes the sentinel."""
    return df.withColumns({c: V.sentinel(V.parse_date(F.col(c))) for c in columns if c in df.columns})


def date_range_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per date column: beyond the sentinel, before 1900, not readable."""
    audits = []
    for c in columns:
        parsed = V.parse_date(F.col(c)) if not isinstance(df.schema[c].dataType, T.DateType) else F.col(c)
        audits.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(parsed > F.lit(S.SENTINEL_DATE).cast("date")).alias("beyond_sentinel"),
                F.count_if(parsed < F.lit("1900-01-01").cast("date")).alias("before_1900"),
                F.count_if(V.date_failed(F.col(c), parsed)).alias("unreadable"),
            )
        )
    return df.agg(F.array(*audits).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def mode_impute_in_group(
    df: DataFrame,
    group: str = "binding_type",
    group_value: str = "SS",
    column: str = "cover_size",
    missing: str = S.MISSING,
    ignore_tokens: Sequence[str] = (),
) -> DataFrame:
    """Replace ``missing`` within one family by its most frequent value, smallest on ties.

    The mode is one value, taken as a scalar subquery over the value counts.
    """
    inside = df.where(F.col(group) == group_value)
    if ignore_tokens:
        inside = inside.where(~F.col(column).isin(list(ignore_tokens)))
    counts = inside.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col(column).isNotNull())
    mode = counts.orderBy(F.desc("n"), F.asc(column)).limit(1).select(column).scalar()
    hit = (F.col(group) == group_value) & (F.col(column) == missing)
    return df.withColumn(column, F.when(hit, F.coalesce(mode, F.col(column))).otherwise(F.col(column)))


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tolerant numeric parse, then null to the column median (exact)."""
    parsed = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})
    medians = quantiles(melted_counts(parsed, [], columns), ["column"], {"median": 0.5})
    wide = medians.agg(
        F.struct(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in columns]).alias("m")
    ).scalar()
    return parsed.withColumns({c: F.coalesce(F.col(c), wide.getField(c)) for c in columns})


def filter_training_target(df: DataFrame, target: str = "unit_price", minimum: float = 0.5) -> DataFrame:
    """Numeric target above the minimum; an empty result is an error."""
    kept = df.withColumn(target, F.col(target).cast("string").try_cast("double")).where(F.col(target) > minimum)
    if kept.isEmpty():
        raise ValueError("No rows left after target filtering")
    return kept


def training_clean(df: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Target filter, median imputation, lower-case ``missing`` for absent categories."""
    rows = median_impute(filter_training_target(df), numbers)
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in categories}
    return rows.withColumns({c: F.when(t.isin("nan", "None"), "missing").otherwise(t) for c, t in text.items()})


def filter_nonzero_price(df: DataFrame) -> DataFrame:
    return df.where(F.col("unit_price") != 0)


def filter_positive_pairs(df: DataFrame) -> DataFrame:
    return df.where((F.col("quantity") > 0) & (F.col("unit_price_ht") > 0))


def filter_min_group_size(df: DataFrame, group: str, minimum: int) -> DataFrame:
    """Rows of groups with at least ``minimum`` rows, by a join with the group counts."""
    large = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum).select(group)
    return join_lookup(df, large, [group], "left_semi")


def fill_final(df: DataFrame, dates: Sequence[str] = tuple(S.DATE_COLUMNS)) -> DataFrame:
    """Remaining null texts to ``MISSING``, trimmed and upper-cased; numbers keep their type."""
    names = [c for c in string_columns(df) if c not in dates]
    return df.withColumns({c: V.trim_upper(F.coalesce(F.col(c), F.lit(S.MISSING))) for c in names})


def full_cleaning(df: DataFrame, null_tokens: Sequence[str] | None = None) -> DataFrame:
    """All cleaning steps in order."""
    # repeated rows change no minimum, maximum or null count, so constants are looked for before the shuffle
    rows = settle(distinct_rows(drop_constant_columns(initial_cleaning(df, null_tokens))), "distinct")
    rows = clean_dates(map_values(str_trim_upper(rows)))
    if {"binding_type", "cover_size"} <= set(rows.columns):
        rows = mode_impute_in_group(rows)
    return fill_final(rows)
