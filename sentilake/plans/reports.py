"""The two report pages as sets of DataFrames."""

from pyspark.sql import DataFrame

from sentilake import constants as K
from sentilake.operators import compare as C
from sentilake.operators import panels as P
from sentilake.operators import trends as R
from sentilake.schemas import require_columns
from sentilake.session import materialise


def _present(cube: DataFrame) -> dict:
    """How many sources, days and brands the cube holds; one row of counts comes to the driver."""
    if not {"source", "scraped_date", "keyword"} & set(cube.columns):
        return {}
    return P.guards(cube).first().asDict()


def analysis_report(
    fact: DataFrame, keyword: str = "All", notes: DataFrame | None = None, cube: DataFrame | None = None,
    threshold: float = K.ALERT_POINTS, tie=None,
) -> dict[str, DataFrame]:
    """Every panel that applies to the data, by name.

    Count panels read one pre-aggregated cube, computed here once, so the comments are scanned once for all of them.
    Pass a stored `cube` of the whole fact table to share it between reports. `tie` orders comments of equal score; by
    default their id, or what the fact table stores.
    """
    require_columns(fact, "sentiment")
    tie = tie or [c for c in ("id", "comment_key", "article_url", "comment") if c in fact.columns][:2]
    rows = P.keyword_filter(fact, keyword)
    cube = materialise(P.summary_cube(rows)) if cube is None else P.keyword_filter(cube, keyword)
    present = _present(cube)
    report = {
        "kpis": P.kpi_row(cube),
        "classes": P.class_counts(cube),
        "cards": P.comment_cards(rows, tie=tie),
        "table": P.comment_table(rows),
        "shown": P.filtered_count(cube),
    }
    if "score" in fact.columns:
        report["scores"] = P.score_histogram(cube)
    if present.get("n_source", 0) > 1:
        report["sources"] = P.source_breakdown(cube)
    if present.get("n_scraped_date", 0) > 1:
        report["alert"] = R.change_alert(cube, by=(), threshold=threshold)
        trend = R.sentiment_trend(cube)
        name = "All data" if keyword == "All" else keyword
        report["trend"] = trend if notes is None else R.overlay(trend, notes, name)
    return report


def compare_report(fact: DataFrame, brands=None, cube: DataFrame | None = None) -> dict[str, DataFrame]:
    """Brand comparison; empty with fewer than two brands."""
    cube = materialise(P.summary_cube(fact)) if cube is None else cube
    if _present(cube).get("n_keyword", 0) < 2:
        return {}
    chosen = C.select_brands(cube, brands)
    summary = C.brand_summary(chosen)
    report = {"summary": summary, "distribution": C.brand_summary_long(summary)}
    if _present(chosen).get("n_scraped_date", 0) > 1:
        report["trend"] = R.brand_trend(chosen)
    return report
