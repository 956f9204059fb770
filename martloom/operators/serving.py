"""KPIs, charts, file detail and filter options over the mart metadata tables."""

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from martloom.functions.dates import covered_months, month_bucket, month_label
from martloom.functions.numbers import round2
from martloom.operators.paging import Sort, page as take_page

# What a request may name.
FILTER_KEYS = ("source", "partition_month")
DETAIL_KEYS = ("source-files",)
SORT_FIELDS = ("source_name", "partition_month", "file_path", "row_count", "last_build_id")
DEFAULT_SORT = (("partition_month", "desc"), ("source_name", "asc"), ("file_path", "asc"))
GRANULARITIES = ("hour", "day", "week", "month")
CHART_LIMITS = {"rows_by_month": 12, "files_by_source": 20}
DASHBOARD_CARDS = ("rows_loaded", "source_files", "source_tables", "covered_months", "avg_rows_per_file")
MONTH_ONLY_WARNING = "rows_by_month is always bucketed by month"


class UnknownDataset(LookupError):
    """The mart holds no dataset of that name."""


@dataclass(frozen=True)
class SummaryRequest:
    dataset: str
    start: dt.date | None = None
    end: dt.date | None = None
    filters: dict = field(default_factory=dict)


@dataclass(frozen=True)
class ChartRequest:
    dataset: str
    chart_id: str
    granularity: str = "day"
    limit: int = 31
    start: dt.date | None = None
    end: dt.date | None = None
    filters: dict = field(default_factory=dict)

    def __post_init__(self):
        if not 1 <= self.limit <= 366:
            raise ValueError("limit must be between 1 and 366")
        if self.granularity not in GRANULARITIES:
            raise ValueError(f"unsupported granularity: {self.granularity}")


@dataclass(frozen=True)
class DetailRequest:
    dataset: str
    detail_key: str = "source-files"
    filters: dict = field(default_factory=dict)
    page: int = 1
    page_size: int = 50
    sort: tuple = ()

    def __post_init__(self):
        if self.page < 1 or not 1 <= self.page_size <= 500:
            raise ValueError("page must be at least 1 and page_size between 1 and 500")


_YEAR_MONTH = re.compile(r"(\d{4})-(\d{1,2})")


def parse_month(text: str) -> dt.date:
    """First day of a month given as year and month."""
    found = _YEAR_MONTH.fullmatch(text)
    if not found or not 1 <= int(found[2]) <= 12 or int(found[1]) == 0:
        raise ValueError(f"a month is written like 2026-03, not {text!r}")
    return dt.date(int(found[1]), int(found[2]), 1)


def check_filters(filters: dict) -> None:
    for name in filters:
        if name not in FILTER_KEYS:
            raise ValueError(f"no filter named {name!r}; known are {' and '.join(FILTER_KEYS)}")


def ensure_dataset(datasets: DataFrame, dataset: str) -> None:
    if datasets.where(F.col("dataset_name") == dataset).limit(1).isEmpty():
        raise UnknownDataset(dataset)


def filter_window(files: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """Both ends are taken to their month's first day and both are inclusive."""
    if start is not None:
        files = files.where(F.col("partition_start") >= F.lit(start.replace(day=1)))
    if end is not None:
        files = files.where(F.col("partition_start") <= F.lit(end.replace(day=1)))
    return files


def filter_sources(files: DataFrame, sources: list[str] | None) -> DataFrame:
    return files.where(F.col("source_name").isin(list(sources))) if sources else files


def filter_months(files: DataFrame, months: list[str] | None) -> DataFrame:
    return files.where(F.col("partition_start").isin([parse_month(m) for m in months])) if months else files


def select_files(
    files: DataFrame,
    dataset: str,
    filters: dict | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    filters = filters or {}
    check_filters(filters)
    chosen = filter_window(files.where(F.col("dataset_name") == dataset), start, end)
    return filter_months(filter_sources(chosen, filters.get("source")), filters.get("partition_month"))


def kpi_summary(files: DataFrame, request: SummaryRequest) -> DataFrame:
    """One row, also when nothing matches."""
    totals = select_files(files, request.dataset, request.filters, request.start, request.end).agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("total_files"),
        F.countDistinct("source_name").alias("source_tables"),
        F.min("partition_start").alias("min_partition_start"),
        F.max("partition_start").alias("max_partition_start"),
    )
    mean = round2(F.col("total_rows") / F.when(F.col("total_files") > 0, F.col("total_files")))
    return totals.withColumn("avg_rows_per_file", F.coalesce(mean, F.lit(0.0))).withColumn(
        "covered_months", covered_months(F.col("min_partition_start"), F.col("max_partition_start"))
    )


def kpi_cards(summary: DataFrame) -> DataFrame:
    """The five KPI values as (key, value, precision) rows."""
    values = {
        "rows_loaded": ("total_rows", "integer"),
        "source_files": ("total_files", "integer"),
        "source_tables": ("source_tables", "integer"),
        "avg_rows_per_file": ("avg_rows_per_file", "decimal"),
        "covered_months": ("covered_months", "integer"),
    }
    cards = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.col(c).cast("double").alias("value"), F.lit(p).alias("precision"))
            for k, (c, p) in values.items()
        ]
    )
    return summary.select(F.inline(cards))


def rows_by_month(files: DataFrame, request: ChartRequest) -> DataFrame:
    """Newest ``limit`` months, shown oldest first."""
    return (
        select_files(files, request.dataset, request.filters, request.start, request.end)
        .groupBy("partition_start")
        .agg(F.sum("row_count").alias("value"))
        .orderBy(F.col("partition_start").desc())
        .limit(request.limit)
        .orderBy("partition_start")
        .select(month_bucket(F.col("partition_start")).alias("bucket"), "value")
    )


def files_by_source(files: DataFrame, request: ChartRequest) -> DataFrame:
    return (
        select_files(files, request.dataset, request.filters, request.start, request.end)
        .groupBy(F.col("source_name").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("value"))
        .orderBy(F.col("value").desc(), F.col("bucket").asc())
        .limit(request.limit)
        .select("bucket", "value", F.col("bucket").alias("label"))
    )


CHARTS: dict[str, Callable[[DataFrame, ChartRequest], DataFrame]] = {
    "rows_by_month": rows_by_month,
    "files_by_source": files_by_source,
}


def chart(files: DataFrame, request: ChartRequest) -> DataFrame:
    if request.chart_id not in CHARTS:
        raise ValueError(f"no chart named {request.chart_id!r}")
    return CHARTS[request.chart_id](files, request)


def chart_warnings(request: ChartRequest) -> list[str]:
    monthly = request.chart_id != "rows_by_month" or request.granularity == "month"
    return [] if monthly else [MONTH_ONLY_WARNING]


def sort_terms(sort: tuple | list) -> list[Sort]:
    terms = []
    for name, direction in sort:
        if name not in SORT_FIELDS:
            raise ValueError(f"rows can't be sorted by {name!r}")
        if direction not in ("asc", "desc"):
            raise ValueError(f"a sort goes asc or desc, not {direction!r}")
        terms.append(Sort(name, direction == "desc"))
    return terms


def full_sort(sort: tuple | list) -> list[Sort]:
    """The given terms, and the default ones behind them to settle ties."""
    named = {name for name, _ in sort}
    return sort_terms([*sort, *[(n, d) for n, d in DEFAULT_SORT if n not in named]])


def detail(files: DataFrame, dataset: str, filters: dict | None = None, detail_key: str = "source-files") -> DataFrame:
    """All detail rows; the date window of summaries and charts does not apply here."""
    if detail_key not in DETAIL_KEYS:
        raise ValueError(f"no detail rows named {detail_key!r}")
    return select_files(files, dataset, filters).select(
        "source_name", F.col("partition_start").alias("partition_month"), "file_path", "row_count", "last_build_id"
    )


def detail_sorted(files: DataFrame, request: DetailRequest) -> DataFrame:
    rows = detail(files, request.dataset, request.filters, request.detail_key)
    return rows.orderBy(*[t.column for t in full_sort(request.sort or DEFAULT_SORT)])


def detail_page(files: DataFrame, request: DetailRequest) -> DataFrame:
    rows = detail(files, request.dataset, request.filters, request.detail_key)
    return take_page(rows, full_sort(request.sort or DEFAULT_SORT), request.page, request.page_size)


def detail_total(files: DataFrame, request: DetailRequest) -> DataFrame:
    rows = detail(files, request.dataset, request.filters, request.detail_key)
    return rows.agg(F.count(F.lit(1)).alias("total"))


def source_options(sources: DataFrame, dataset: str) -> DataFrame:
    return sources.where(F.col("dataset_name") == dataset).select(F.col("source_name").alias("value")).distinct().orderBy("value")


def month_options(files: DataFrame, dataset: str) -> DataFrame:
    months = files.where(F.col("dataset_name") == dataset).select("partition_start").distinct()
    return months.select(month_label(F.col("partition_start")).alias("value")).distinct().orderBy(F.col("value").desc())


def dashboard(files: DataFrame, sources: DataFrame, datasets: DataFrame, dataset: str, filters: dict | None = None,
              preview_size: int = 20) -> dict[str, DataFrame]:
    """The frames of the operations overview: cards, both charts, detail preview, filter options."""
    ensure_dataset(datasets, dataset)
    filters = filters or {}
    frames = {
        "refreshed": datasets.where(F.col("dataset_name") == dataset).select("dataset_name", "last_refreshed_at"),
        "cards": kpi_cards(kpi_summary(files, SummaryRequest(dataset, filters=filters))).where(
            F.col("key").isin(*DASHBOARD_CARDS)
        ),
        "source_options": source_options(sources, dataset),
        "month_options": month_options(files, dataset),
        "detail_preview": detail_page(files, DetailRequest(dataset, filters=filters, page_size=preview_size)),
    }
    for chart_id, limit in CHART_LIMITS.items():
        frames[chart_id] = chart(files, ChartRequest(dataset, chart_id, "month", limit, filters=filters))
    return frames


@dataclass(frozen=True)
class ServedMart:
    """The promoted metadata tables; every call names a dataset, and one that the mart doesn't hold raises ``UnknownDataset``."""

    files: DataFrame
    sources: DataFrame
    datasets: DataFrame

    @classmethod
    def of_store(cls, store) -> "ServedMart":
        """All three tables of one version."""
        version = store.current_version()
        return cls(*(store.table_of(name, version) for name in ("files", "sources", "datasets")))

    def summary(self, request: SummaryRequest) -> DataFrame:
        ensure_dataset(self.datasets, request.dataset)
        return kpi_summary(self.files, request)

    def chart(self, request: ChartRequest) -> DataFrame:
        ensure_dataset(self.datasets, request.dataset)
        return chart(self.files, request)

    def detail(self, request: DetailRequest) -> tuple[DataFrame, DataFrame]:
        """A page of rows and their total."""
        ensure_dataset(self.datasets, request.dataset)
        return detail_page(self.files, request), detail_total(self.files, request)

    def export_rows(self, request: DetailRequest) -> DataFrame:
        ensure_dataset(self.datasets, request.dataset)
        return detail_sorted(self.files, request)

    def filter_options(self, dataset: str) -> tuple[DataFrame, DataFrame]:
        """Sources and months."""
        ensure_dataset(self.datasets, dataset)
        return source_options(self.sources, dataset), month_options(self.files, dataset)

    def dashboard(self, dataset: str, filters: dict | None = None) -> dict[str, DataFrame]:
        return dashboard(self.files, self.sources, self.datasets, dataset, filters)
