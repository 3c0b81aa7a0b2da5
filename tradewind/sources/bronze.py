"""The nine raw tables, whatever they are read from."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Bronze:
    orders: DataFrame
    customers: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame
    products: DataFrame
    sellers: DataFrame
    geolocation: DataFrame
    product_category_name_translation: DataFrame

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in self.names()]
