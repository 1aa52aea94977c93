"""Name -> report function, with the parameters each report accepts."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from distkpi.plans import documented, lists, sales, stock, supply

REPORTS: dict[str, Callable] = {
    # mounted reports
    "sales_summary": sales.sales_summary,
    "cover_days": stock.cover_days,
    "closing_inventory_date": stock.closing_inventory_date,
    "cover_days_total": stock.cover_days_total,
    "forecast_accuracy_monthly": sales.forecast_accuracy_monthly,
    "target_to_date": sales.target_to_date,
    "forecast_accuracy_yearly": sales.forecast_accuracy_yearly,
    "inventory_days": stock.inventory_days,
    "above_below_threshold": stock.above_below_threshold,
    "forecast_accuracy_category_monthly": sales.forecast_accuracy_category_monthly,
    "forecast_accuracy_category_yearly": sales.forecast_accuracy_category_yearly,
    "distributor_vs_company_target": sales.distributor_vs_company_target,
    "service_measure": stock.service_measure,
    "target_vs_actual_cover": stock.target_vs_actual_cover,
    "dispatch_vs_order": supply.dispatch_vs_order,
    "wip": supply.wip,
    "stock_valuation": supply.stock_valuation,
    "item_filter_list": lists.item_filter_list,
    "branch_list": lists.branch_list,
    "sku_count_by_class": lists.sku_count_by_class,
    "table_page": lists.page,
    "list_tables": lists.tables,
    # documented sales metrics and lists
    "gross_summary": documented.gross_summary,
    "revenue_total": documented.revenue_total,
    "customer_universe": documented.customer_universe,
    "purchase_frequency": documented.purchase_frequency,
    "outlets_with_n_purchases": documented.outlets_with_n_purchases,
    "productive_outlets": documented.productive_outlets,
    "top_sku_class_a": documented.top_sku_class_a,
    "business_lines": documented.business_lines,
    "products": documented.products,
    "locations": documented.locations,
    "regional_distributors": documented.regional_distributors,
}


def parameters(name: str) -> list[str]:
    """Parameter names a report takes after the tables."""
    return list(inspect.signature(REPORTS[name]).parameters)[1:]


def run(report: str, tables, strict: bool = False, **params):
    """Call a report with the parameters it accepts.

    Like the report endpoints, parameters a report does not use are ignored;
    ``strict=True`` rejects them instead.
    """
    accepted = set(parameters(report))
    extra = {k for k, v in params.items() if v not in (None, "", []) and k not in accepted}
    if extra and strict:
        raise TypeError(f"report {report!r} does not take {sorted(extra)}")
    return REPORTS[report](tables, **{k: v for k, v in params.items() if k in accepted})
