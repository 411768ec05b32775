"""Client indicators, features, their checks and their use on orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom import schema as S
from priceloom.functions import values as V
from priceloom.functions.distribution import melted_counts, quantiles
from priceloom.functions.scale import join_lookup, settle

MIN_SAMPLES = 8
MIN_PRICE_CV = 0.05


def price_ht(df: DataFrame) -> DataFrame:
    """Add ``unit_price_ht``: price without VAT; no VAT column means the price itself, no price means 0."""
    if "unit_price" not in df.columns:
        return df.withColumn("unit_price_ht", F.lit(0.0))
    if "tva" not in df.columns:
        return df.withColumn("unit_price_ht", V.price_without_vat(F.col("unit_price"), None))
    ht = V.price_without_vat(F.col("unit_price"), F.col("tva"))
    return df.withColumns({
        "unit_price_ht": ht,
        "unit_price": V.locale_number(F.col("unit_price"), percent_sign=False),
        "tva": V.vat_rate(F.col("tva")),
    })


def _client_prices(df: DataFrame) -> DataFrame:
    return df.where(F.col("siren").isNotNull()).groupBy("siren").agg(
        F.avg("unit_price_ht").alias("_mean"),
        F.coalesce(F.stddev_samp("unit_price_ht"), F.lit(0.0)).alias("_std"),
    )


def _index(price: Column, mean: Column) -> Column:
    return F.coalesce(F.try_divide(price, mean), F.lit(1.0))


def client_indicators(df: DataFrame) -> DataFrame:
    """Both indicators from one aggregate and one join."""
    if "siren" not in df.columns or "unit_price_ht" not in df.columns:
        return df.withColumns({"relative_price_index": F.lit(1.0), "price_volatility": F.lit(0.0)})
    joined = join_lookup(df, _client_prices(df), ["siren"])
    return joined.withColumns({
        "relative_price_index": _index(F.col("unit_price_ht"), F.col("_mean")),
        "price_volatility": F.coalesce("_std", F.lit(0.0)),
    }).drop("_mean", "_std")


def relative_price_index(df: DataFrame) -> DataFrame:
    """Price over the client's mean price; a zero mean or null gives 1.

    The mean is a pre-aggregated join and not a window, so that one client with
    a third of all rows is not sorted in one task.
    """
    return client_indicators(df).drop("price_volatility")


def price_volatility(df: DataFrame) -> DataFrame:
    """Sample standard deviation of the client's prices; a single row gives 0."""
    return client_indicators(df).drop("relative_price_index")


def _order_date(df: DataFrame) -> Column:
    """Reception date as a date; the sentinel of the cleaned table means no date."""
    date = F.col("reception_date")
    if "reception_date" in df.columns and not isinstance(df.schema["reception_date"].dataType, T.DateType):
        date = V.parse_date(date)
    return F.nullif(date, F.lit(S.SENTINEL_DATE).cast("date"))


def client_aggregate(df: DataFrame) -> DataFrame:
    """One row per client; the aggregates depend on the columns that exist."""
    date = _order_date(df)
    available = {
        "unit_price_ht": [
            F.count("unit_price_ht").alias("client_nb_orders"),
            F.avg("unit_price_ht").alias("client_avg_price_ht"),
            F.stddev_samp("unit_price_ht").alias("client_price_std_ht"),
        ],
        "quantity": [F.avg("quantity").alias("client_avg_quantity")],
        "price_volatility": [F.avg("price_volatility").alias("client_price_volatility")],
        "relative_price_index": [F.avg("relative_price_index").alias("client_relative_price")],
        "reception_date": [F.min(date).alias("client_first_order"), F.max(date).alias("client_last_order")],
    }
    aggregates = [a for name, group in available.items() if name in df.columns for a in group]
    rows = df.where(F.col("siren").isNotNull()).groupBy("siren")
    return rows.agg(*aggregates) if aggregates else rows.agg(F.lit(None).alias("_")).drop("_")


def client_recency_seniority(clients: DataFrame) -> DataFrame:
    """Years since the first and days since the last order, against the latest order of all."""
    if not {"client_first_order", "client_last_order"} <= set(clients.columns):
        return clients.withColumns({"client_seniority_years": F.lit(0.0), "client_recency_days": F.lit(0)})
    today = F.coalesce(clients.agg(F.max("client_last_order")).scalar(), F.current_date())
    years = F.datediff(today, "client_first_order").cast("double") / F.lit(365.0)
    return clients.withColumns({
        "client_seniority_years": F.coalesce(F.round(years, 2), F.lit(0.0)),
        "client_recency_days": F.coalesce(F.datediff(today, "client_last_order"), F.lit(0)),
    })


def _elasticity_aggregates() -> list[Column]:
    valid = (F.col("quantity") > 0) & (F.col("unit_price_ht") > 0)
    price = F.when(valid, F.col("unit_price_ht"))
    log_q = F.when(valid, F.ln("quantity"))
    log_p = F.when(valid, F.ln("unit_price_ht"))
    return [
        F.count(price).alias("_n"),
        F.avg(price).alias("_valid_mean"),
        F.stddev_samp(price).alias("_valid_std"),
        F.regr_slope(log_q, log_p).alias("_slope"),
        F.regr_r2(log_q, log_p).alias("_r2"),
    ]


def _elasticity_columns(min_samples: int, min_cv: float) -> dict[str, Column]:
    cv = F.try_divide(F.col("_valid_std"), F.col("_valid_mean"))
    code = (
        F.when(F.col("_n") < min_samples, "insufficient_samples")
        .when((F.col("_valid_mean") == 0) | (F.col("_valid_std") == 0), "zero_variance")
        .when(cv < min_cv, "low_price_variation")
        .otherwise("success")
    )
    fitted = code == "success"
    return {
        "client_price_elasticity": F.when(fitted, F.col("_slope")).otherwise(F.lit(0.0)),
        "elasticity_r2": F.when(fitted, F.col("_r2")),
        "elasticity_n_samples": F.col("_n"),
        "elasticity_cv": cv,
        "elasticity_code": code,
        "elasticity_status": F.when(
            code == "insufficient_samples", F.concat(F.lit("insufficient_samples_"), F.col("_n"))
        )
        .when(code == "low_price_variation", F.format_string("low_price_variation_%.3f", cv))
        .otherwise(code),
    }


_ELASTICITY_WORK = ["_n", "_valid_mean", "_valid_std", "_slope", "_r2"]


def client_elasticity(
    df: DataFrame, min_samples: int = MIN_SAMPLES, min_cv: float = MIN_PRICE_CV
) -> DataFrame:
    """Slope of ln(quantity) on ln(price) per client, in one grouped aggregate."""
    rows = df.where(
        F.col("siren").isNotNull() & (F.col("quantity") > 0) & (F.col("unit_price_ht") > 0)
    ).groupBy("siren")
    return rows.agg(*_elasticity_aggregates()).withColumns(_elasticity_columns(min_samples, min_cv)).drop(
        *_ELASTICITY_WORK
    )


def _finite(value: Column) -> Column:
    return F.when(value.isin(float("inf"), float("-inf")), F.lit(0.0)).otherwise(value)


FILL_WITH_ZERO = [
    "client_price_volatility", "client_price_std_ht", "client_relative_price",
    "client_price_elasticity", "client_seniority_years", "client_recency_days",
]


def _filled(clients: DataFrame) -> DataFrame:
    doubles = {
        f.name: _finite(F.col(f.name)) for f in clients.schema.fields if isinstance(f.dataType, T.DoubleType)
    }
    fills = {c: F.coalesce(doubles.get(c, F.col(c)), F.lit(0)) for c in FILL_WITH_ZERO if c in clients.columns}
    return clients.withColumns(doubles | fills)


def join_client_elasticity(clients: DataFrame, elasticity: DataFrame) -> DataFrame:
    """Both sides have one row per client, so a plain left join suffices."""
    columns = elasticity.select("siren", "client_price_elasticity", "elasticity_status")
    return _filled(clients.join(columns, "siren", "left"))


def client_features(
    df: DataFrame, min_samples: int = MIN_SAMPLES, min_cv: float = MIN_PRICE_CV
) -> DataFrame:
    """All client features from raw orders with a single shuffle of the orders.

    Within a client the mean of ``price / mean(price)`` is 1 and the mean of the
    constant volatility is the volatility, so neither indicator has to be joined
    back to the rows first; tests check this against the step-by-step form.
    """
    rows = price_ht(df).where(F.col("siren").isNotNull())
    base = rows.groupBy("siren").agg(
        F.count("unit_price_ht").alias("client_nb_orders"),
        F.avg("unit_price_ht").alias("client_avg_price_ht"),
        F.stddev_samp("unit_price_ht").alias("client_price_std_ht"),
        F.avg("quantity").alias("client_avg_quantity"),
        F.coalesce(F.stddev_samp("unit_price_ht"), F.lit(0.0)).alias("client_price_volatility"),
        F.lit(1.0).alias("client_relative_price"),
        F.min(_order_date(rows)).alias("client_first_order"),
        F.max(_order_date(rows)).alias("client_last_order"),
        *_elasticity_aggregates(),
    )
    elastic = {
        name: F.when(F.col("_n") > 0, column)
        for name, column in _elasticity_columns(min_samples, min_cv).items()
        if name in ("client_price_elasticity", "elasticity_status")
    }
    clients = settle(base.withColumns(elastic).drop(*_ELASTICITY_WORK), "client-features")
    return _filled(client_recency_seniority(clients))


def client_mean_price(df: DataFrame) -> DataFrame:
    """``siren`` and ``client_avg_price_ht`` as in ``client_features``, without the buffers of its other columns."""
    rows = price_ht(df).where(F.col("siren").isNotNull())
    return _filled(rows.groupBy("siren").agg(F.avg("unit_price_ht").alias("client_avg_price_ht")))


# Moments of price, valid price and the logarithms: name, its count, its mean's name.
_SPREADS = {"price_m2": ("price_n", "price_mean"), "valid_m2": ("valid_n", "valid_mean"), "log_p_m2": ("valid_n", "log_p_mean")}


def client_moments(df: DataFrame) -> DataFrame:
    """Per client what ``client_features`` needs of its orders, in a form that ``merge_moments`` can add up.

    Counts, means, sums of squared and crossed deviations, extremes. Rows without ``siren``
    are left out; missing prices and quantities are not counted.
    """
    rows = price_ht(df).where(F.col("siren").isNotNull())
    valid = (F.col("quantity") > 0) & (F.col("unit_price_ht") > 0)
    price, log_q, log_p = (F.when(valid, c) for c in (F.col("unit_price_ht"), F.ln("quantity"), F.ln("unit_price_ht")))

    def spread(value: Column) -> Column:
        return F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0))

    return rows.groupBy("siren").agg(
        F.count("unit_price_ht").alias("price_n"), F.avg("unit_price_ht").alias("price_mean"), spread(F.col("unit_price_ht")).alias("price_m2"),
        F.count("quantity").alias("quantity_n"), F.avg("quantity").alias("quantity_mean"),
        F.min(_order_date(rows)).alias("first_order"), F.max(_order_date(rows)).alias("last_order"),
        F.count(price).alias("valid_n"), F.avg(price).alias("valid_mean"), spread(price).alias("valid_m2"),
        F.min(price).alias("valid_min"), F.max(price).alias("valid_max"),
        F.avg(log_q).alias("log_q_mean"), F.avg(log_p).alias("log_p_mean"), spread(log_p).alias("log_p_m2"),
        F.coalesce(F.covar_pop(log_q, log_p) * F.count(price), F.lit(0.0)).alias("log_c"),
    )


def merge_moments(one: DataFrame, two: DataFrame) -> DataFrame:
    """Moments of the orders of both; a client may be on either side or on both. One row per client and side, so no key is hot."""
    a, b = one.alias("a"), two.alias("b")
    means = {"price_mean": "price_n", "quantity_mean": "quantity_n", "valid_mean": "valid_n", "log_q_mean": "valid_n", "log_p_mean": "valid_n"}

    def count(side: str, n: str) -> Column:
        return F.coalesce(F.col(f"{side}.{n}"), F.lit(0))

    def both(n: str) -> Column:
        return count("a", n) + count("b", n)

    def gap(mean: str) -> Column:
        return F.coalesce(F.col(f"b.{mean}") - F.col(f"a.{mean}"), F.lit(0.0))

    def between(n: str, first: str, second: str) -> Column:
        return F.coalesce(F.try_divide(gap(first) * gap(second) * count("a", n) * count("b", n), both(n)), F.lit(0.0))

    def added(name: str) -> Column:
        return F.coalesce(F.col(f"a.{name}"), F.lit(0.0)) + F.coalesce(F.col(f"b.{name}"), F.lit(0.0))

    merged = {n: both(n) for n in ("price_n", "quantity_n", "valid_n")}
    for mean, n in means.items():
        step = gap(mean) * F.try_divide(count("b", n), both(n))
        merged[mean] = F.when(F.col(f"a.{mean}").isNull(), F.col(f"b.{mean}")).when(F.col(f"b.{mean}").isNull(), F.col(f"a.{mean}")).otherwise(F.col(f"a.{mean}") + step)
    for name, (n, mean) in _SPREADS.items():
        merged[name] = added(name) + between(n, mean, mean)
    merged["log_c"] = added("log_c") + between("valid_n", "log_q_mean", "log_p_mean")
    for name, pick in {"first_order": F.least, "last_order": F.greatest, "valid_min": F.least, "valid_max": F.greatest}.items():
        merged[name] = pick(f"a.{name}", f"b.{name}")
    joined = a.join(b, F.col("a.siren") == F.col("b.siren"), "full")
    return joined.select(F.coalesce("a.siren", "b.siren").alias("siren"), *[merged[c].alias(c) for c in one.columns if c != "siren"])


def features_of_moments(moments: DataFrame, min_samples: int = MIN_SAMPLES, min_cv: float = MIN_PRICE_CV) -> DataFrame:
    """The columns of ``client_features`` from a written table of moments."""

    def deviation(m2: str, n: str) -> Column:
        return F.when(F.col(n) > 1, F.sqrt(F.col(m2) / (F.col(n) - 1)))

    std = deviation("price_m2", "price_n")
    work = {
        "_n": F.col("valid_n"), "_valid_mean": F.col("valid_mean"),
        # equal prices have no spread, whatever rounding left of it
        "_valid_std": F.when((F.col("valid_n") > 1) & (F.col("valid_min") == F.col("valid_max")), 0.0).otherwise(deviation("valid_m2", "valid_n")),
        "_slope": F.try_divide(F.col("log_c"), F.col("log_p_m2")), "_r2": F.lit(None).cast("double"),
    }
    elastic = _elasticity_columns(min_samples, min_cv)
    clients = moments.withColumns(work).select(
        "siren", F.col("price_n").alias("client_nb_orders"), F.col("price_mean").alias("client_avg_price_ht"), std.alias("client_price_std_ht"),
        F.col("quantity_mean").alias("client_avg_quantity"), F.coalesce(std, F.lit(0.0)).alias("client_price_volatility"),
        F.lit(1.0).alias("client_relative_price"), F.col("first_order").alias("client_first_order"), F.col("last_order").alias("client_last_order"),
        *[F.when(F.col("_n") > 0, elastic[c]).alias(c) for c in ("client_price_elasticity", "elasticity_status")],
    )
    return _filled(client_recency_seniority(clients))


def join_enrich_orders(orders: DataFrame, features: DataFrame) -> DataFrame:
    """Features on every order; absent numbers 0, absent status ``none``, absent dates null."""
    added = [f for f in features.schema.fields if f.name != "siren"]
    joined = join_lookup(orders.drop(*[f.name for f in added]), features, ["siren"])
    fills = {}
    for field in added:
        if isinstance(field.dataType, T.NumericType):
            fills[field.name] = F.coalesce(F.col(field.name), F.lit(0).cast(field.dataType))
        elif isinstance(field.dataType, T.StringType):
            fills[field.name] = F.coalesce(F.col(field.name), F.lit("none"))
    return joined.withColumns(fills)


def lookup_client(requests: DataFrame, features: DataFrame) -> DataFrame:
    """Features by the text form of ``siren``, with a ``found`` flag."""
    keyed = features.withColumns({"siren": F.col("siren").cast("string"), "found": F.lit(True)})
    asked = requests.withColumn("siren", F.col("siren").cast("string"))
    return join_lookup(asked, keyed, ["siren"]).withColumn("found", F.coalesce("found", F.lit(False)))


def validate_client_features(features: DataFrame) -> DataFrame:
    """One row of statistics with the list of issues; no rows gives zero clients."""
    e = F.col("client_price_elasticity")
    nulls = sum((F.count_if(F.col(c).isNull()) for c in features.columns[1:]), F.count_if(F.col(features.columns[0]).isNull()))
    stats = features.agg(
        F.count(F.lit(1)).alias("n_clients"),
        F.lit(len(features.columns) - 1).alias("n_features"),
        nulls.alias("missing_values"),
        F.count_if(e != 0).alias("clients_with_elasticity"),
        F.avg(e).alias("elasticity_mean"),
        F.stddev_samp(e).alias("elasticity_std"),
        F.min(e).alias("elasticity_min"),
        F.max(e).alias("elasticity_max"),
        F.avg("client_seniority_years").alias("seniority_mean"),
        F.avg("client_recency_days").alias("recency_mean"),
        F.avg("client_avg_price_ht").alias("avg_price_mean"),
    )
    few = F.col("clients_with_elasticity") < F.col("n_clients") * F.lit(0.3)
    issues = F.array(
        F.when(F.col("n_clients") == 0, "empty_dataframe"),
        F.when(F.col("missing_values") > 0, "missing_values"),
        F.when(few, "few_clients_with_elasticity"),
    )
    return stats.withColumn("issues", F.array_compact(issues))


def numeric_profile(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, deviation, extremes and quartiles per numeric column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = features.select(F.explode(cells).alias("c")).select("c.*")
    moments = long.groupBy("column").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quarters = quantiles(
        melted_counts(features, [], columns), ["column"], {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    )
    return moments.join(quarters.drop("total"), "column")


def correlation_matrix(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, all in one aggregate."""
    upper = {
        (i, j): F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i <= j
    }
    row = features.agg(F.struct(*[v.alias(f"r_{i}_{j}") for (i, j), v in upper.items()]).alias("m"))
    cells = [
        F.struct(
            F.lit(a).alias("column_a"),
            F.lit(b).alias("column_b"),
            F.col(f"m.r_{min(i, j)}_{max(i, j)}").alias("correlation"),
        )
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def histogram(df: DataFrame, value: str, bins: int = 30, label: str | None = None) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed; empty bins included."""
    span = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).alias("s"))
    s = span.scalar()
    flat = s["lo"] == s["hi"]
    low = F.when(flat, s["lo"] - 0.5).otherwise(s["lo"])
    high = F.when(flat, s["hi"] + 0.5).otherwise(s["hi"])
    place = F.floor((F.col(value).cast("double") - low) / (high - low) * bins)
    counts = (
        df.where(F.col(value).isNotNull())
        .select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edges = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (low + (high - low) * F.col("id") / bins).alias("low"),
        (low + (high - low) * (F.col("id") + 1) / bins).alias("high"),
    )
    return edges.join(counts, "bin", "left").select(
        F.lit(label or value).alias("column"), "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n")
    )


def histogram_30(features: DataFrame) -> DataFrame:
    """The four distributions of the client report."""
    nonzero = features.where(F.col("client_price_elasticity") != 0)
    parts = [histogram(nonzero, "client_price_elasticity")]
    parts += [histogram(features, c) for c in ("client_seniority_years", "client_recency_days", "client_avg_price_ht")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
