"""One HTML page of a run: small aggregates are collected and drawn on the driver."""

from __future__ import annotations

import html
from collections.abc import Sequence

from ..sources.store import TableStore
from . import named

#: Sections in order: title, query, column drawn as bars (else none), rows shown.
SECTIONS = (
    ("Weekly sales", "weekly_sales_trend", "revenue", 16),
    ("ABC classes", "abc_classification", "revenue_90d", 15),
    ("Stock-outs by store", "stockout_rate_by_store", "stockout_pct", 20),
    ("Promotion lift", "promo_lift", "lift_multiplier", 15),
    ("Models", "forecast_accuracy_leaderboard", "series_won", 10),
    ("Orders", "replenishment_summary", "order_cost", 20),
    ("Stock-out risk", "stockout_risk_top", "priority", 10),
    ("Days of cover", "days_of_cover", "days_of_cover", 20),
    ("Inventory health", "inventory_health_distribution", "n_series", 5),
    ("Order cost", "order_cost_by_category", "order_cost", 20),
    ("Forecast totals", "forecast_rollup", "horizon_units", 30),
    ("Evaluation", "evaluation_summary", "wape", 10),
    ("Evaluation history", "evaluation_history", "wape", 20),
    ("Bias by category", "forecast_bias_by_category", "avg_bias", 20),
    ("Upcoming promotions", "promo_calendar_upcoming", None, 20),
    ("Runs", "run_history", None, 10),
)
STYLE = "body{font:14px sans-serif;margin:2em;color:#222}table{border-collapse:collapse}td,th{padding:2px 8px;border-bottom:1px solid #ddd;text-align:left}rect{fill:#4269a5}"


def bar_chart(labels: Sequence[str], values: Sequence[float | None], width: int = 480) -> str:
    """Horizontal bars; missing values have none."""
    top = max((abs(v) for v in values if v is not None), default=0) or 1
    rows = [f'<text x="0" y="{18 * i + 13}">{html.escape(str(a)[:24])}</text><rect x="180" y="{18 * i + 3}" height="12" width="{abs(v or 0) / top * (width - 180):.1f}"/>' for i, (a, v) in enumerate(zip(labels, values))]
    return f'<svg role="img" width="{width}" height="{18 * len(rows) + 6}">{"".join(rows)}</svg>'


def _table(columns: Sequence[str], rows: Sequence[Sequence]) -> str:
    cell = lambda v: "" if v is None else html.escape(f"{v:,.2f}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><tr>{head}</tr>{''.join('<tr>' + ''.join(f'<td>{cell(v)}</td>' for v in r) + '</tr>' for r in rows)}</table>"


def render(store: TableStore, run_id: int) -> str:
    """The page; a section whose query has no rows says so."""
    store.views()
    parts = []
    for title, name, bars, limit in SECTIONS:
        params = {"run_id": run_id} if "run_id" in named.parameters(name) else {}
        frame = named.run(store.spark, name, **params)
        rows = frame.limit(limit).collect()
        body = _table(frame.columns, rows) if rows else "<p>Not available.</p>"
        if rows and bars:
            body = bar_chart([r[0] for r in rows], [r[bars] for r in rows]) + body
        parts.append(f"<section><h2>{title}</h2>{body}</section>")
    policy = "default-src 'none'; style-src 'unsafe-inline'; img-src data:"
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{policy}"><title>Run {run_id}</title><style>{STYLE}</style></head><body><h1>Run {run_id}</h1>{"".join(parts)}</body></html>'
