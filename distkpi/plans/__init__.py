"""Report plans: each function takes the logical tables and returns a lazy DataFrame."""

from distkpi.plans import documented, lists, sales, stock, supply

__all__ = ["documented", "lists", "sales", "stock", "supply"]
