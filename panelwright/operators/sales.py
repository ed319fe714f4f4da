"""Store sales: dimension join, competition, promotion, holiday and domain features."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.arithmetic import distance_bin, in_promo_month, months_since, sales_per_customer
from panelwright.operators.clean import fill_zero, filter_rows
from panelwright.operators.encode import categories_of, one_hot
from panelwright.plans.lookup import bytes_of, key_lookup


@dataclass(frozen=True)
class SalesConfig:
    competition: bool = True
    fill_distance_missing: str = "median"  # median, max or zero
    months_since_competition: bool = True
    distance_bins: tuple[int, ...] = ()
    distance_interaction: bool = False
    promotion: bool = True
    months_since_promo2: bool = True
    promo_month: bool = True
    month_aliases: dict = field(default_factory=dict)
    holidays: bool = True
    store_categories: bool = True
    sales_per_customer: bool = True
    customers_indicator: bool = True
    remove_closed: bool = True
    remove_zero_sales: bool = False


def merge_store_data(df: DataFrame, store: DataFrame, store_bytes: int | None = None) -> DataFrame:
    """Left join of the fact rows with the store dimension, which is measured (a one-row job)
    unless its size is given."""
    return key_lookup(df, store, ["Store"], size=bytes_of(store) if store_bytes is None else store_bytes)


def distance_fill(df: DataFrame, method: str, column: str = "CompetitionDistance") -> DataFrame:
    """One row with the value that replaces missing distances, learned on ``df``. The median
    weighs every distance with its rows: a distance belongs to a store, so one pass counts the
    few distinct values and the median is taken over those."""
    if method == "median":
        counts = df.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(F.percentile("v", 0.5, F.col("n")).alias("fill"))
    if method == "max":
        return df.agg(F.max(column).cast("double").alias("fill"))
    return df.sparkSession.range(1).select(F.lit(0.0).alias("fill"))


def impute_distance(df: DataFrame, fill: DataFrame, column: str = "CompetitionDistance") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), fill.scalar()))


def competition_features(df: DataFrame, config: SalesConfig, fill: DataFrame | None = None) -> DataFrame:
    if not config.competition:
        return df
    if "CompetitionDistance" in df.columns:
        fill = fill if fill is not None else distance_fill(df, config.fill_distance_missing)
        df = impute_distance(df, fill)
        if config.distance_bins:
            df = df.withColumn("CompetitionDistanceBin", distance_bin("CompetitionDistance", config.distance_bins))
    if config.months_since_competition:
        gap = months_since("CompetitionOpenSinceYear", "CompetitionOpenSinceMonth", "Date")
        df = df.withColumn("MonthsSinceCompetition", gap)
        if config.distance_interaction and "CompetitionDistance" in df.columns:
            product = F.col("CompetitionDistance") * F.col("MonthsSinceCompetition")
            df = df.withColumn("CompetitionDistanceXMonths", product)
    return df


def promotion_features(df: DataFrame, config: SalesConfig) -> DataFrame:
    """Months since the continuing promotion began (its start week is read as a month, weeks
    beyond 12 count as unknown) and whether the month is on the promotion list."""
    if not config.promotion or "Promo2" not in df.columns:
        return df
    if config.months_since_promo2:
        df = df.withColumn("MonthsSincePromo2", months_since("Promo2SinceYear", "Promo2SinceWeek", "Date"))
    if config.promo_month and "PromoInterval" in df.columns:
        df = df.withColumn("IsPromoMonth", in_promo_month("PromoInterval", "Date", config.month_aliases or None))
    return df


def domain_features(df: DataFrame, config: SalesConfig) -> DataFrame:
    if config.sales_per_customer and {"Customers", "Sales"} <= set(df.columns):
        df = df.withColumn("SalesPerCustomer", sales_per_customer("Sales", "Customers"))
    if config.customers_indicator and "Customers" in df.columns:
        df = df.withColumn("HasCustomerData", F.when(F.col("Customers") > 0, 1).otherwise(0))
    return df


@dataclass(frozen=True)
class SalesPreprocessor:
    """What is learned on the training rows and applied to all: categories and the distance
    fill value."""

    config: SalesConfig
    store: DataFrame
    categories: dict
    fill: DataFrame
    store_bytes: int | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        c = self.config
        out = merge_store_data(df, self.store, self.store_bytes)
        out = competition_features(out, c, self.fill)
        out = promotion_features(out, c)
        present = {k: v for k, v in self.categories.items() if k in out.columns}
        out = one_hot(out, present)
        out = domain_features(out, c)
        return fill_zero(filter_rows(out, c.remove_closed, c.remove_zero_sales))


def fit_store_preprocess(
    df: DataFrame,
    store: DataFrame,
    config: SalesConfig = SalesConfig(),
    categories: dict[str, list[str]] | None = None,
    store_bytes: int | None = None,
) -> SalesPreprocessor:
    """Categories may be given; otherwise they are read from the training rows and the
    dimension."""
    if categories is None:
        categories = {}
        if config.holidays and "StateHoliday" in df.columns:
            categories["StateHoliday"] = categories_of(df, "StateHoliday")
        if config.store_categories:
            for c in ("StoreType", "Assortment"):
                if c in store.columns:
                    categories[c] = categories_of(store, c)
    fill = distance_fill(merge_store_data(df, store, store_bytes), config.fill_distance_missing)
    return SalesPreprocessor(config, store, categories, fill, store_bytes)


def store_preprocess(df: DataFrame, store: DataFrame, config: SalesConfig = SalesConfig(), **kw) -> DataFrame:
    return fit_store_preprocess(df, store, config, **kw).transform(df)
