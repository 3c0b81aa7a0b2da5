"""A few hand-made raw tables with the edge rows no generated table has."""

from __future__ import annotations

from decimal import Decimal

from tradewind.schemas import BRONZE
from tradewind.sources.bronze import Bronze


def money(x):
    return None if x is None else Decimal(str(x))


ORDERS = [
    # order, customer, status, purchase, approved, carrier, delivered, estimated
    ("o1", "c1", "delivered", "2018-01-05 10:00:00", "2018-01-05 12:00:00", "2018-01-07 00:00:00", "2018-01-10 09:00:00", "2018-01-20 00:00:00"),
    ("o2", "c2", "delivered", "2018-02-01 10:00:00", "2018-02-01 11:00:00", "2018-02-03 00:00:00", None, "2018-02-20 00:00:00"),
    ("o3", "c3", "shipped", "2018-02-10 10:00:00", "2018-02-10 11:00:00", None, None, "2018-03-01 00:00:00"),
    ("o4", "c4", "delivered", "2018-03-01 10:00:00", "2018-03-01 11:00:00", "2018-03-02 00:00:00", "2018-04-02 00:00:00", "2018-03-20 00:00:00"),
    ("o5", "c5", "delivered", "2018-03-05 10:00:00", "not a time", "2018-03-07 00:00:00", "2018-03-09 00:00:00", "2018-03-20 00:00:00"),
    ("o6", "c6", "delivered", "2018-04-05 10:00:00", "2018-04-05 10:00:00", "2018-04-07 00:00:00", "2018-04-09 00:00:00", "2018-04-20 00:00:00"),
]
CUSTOMERS = [
    ("c1", "ann", 1000, " Sao Paulo ", "sp"),
    ("c2", "bob", 2000, "Rio", "rj"),
    ("c3", "cat", 2000, "Rio", "rj"),
    ("c4", "ann", 3000, "Campinas", "sp"),  # ann moved; the greater customer_id wins
    ("c5", "dan", 9999, "Nowhere", "xx"),  # zip without a point
    ("c6", "cat", 2000, "Rio", "rj"),  # cat's first order was never delivered
]
ITEMS = [
    ("o1", 1, "p1", "s1", "2018-01-08 00:00:00", money("10.00"), money("1.50")),
    ("o1", 2, "p1", "s1", "2018-01-08 00:00:00", money("10.00"), money("1.50")),
    ("o1", 3, "p2", "s2", "2018-01-08 00:00:00", money("5.00"), money("0.50")),
    ("o4", 1, "p3", "s1", "2018-03-03 00:00:00", money("7.00"), money("2.00")),
    ("o6", 1, "p2", "s1", "2018-04-06 00:00:00", money("8.00"), money("2.00")),
    ("gone", 1, "p1", "s3", "2018-03-03 00:00:00", money("9.00"), money("1.00")),  # no such order
]
PAYMENTS = [
    ("o1", 1, "credit_card", 3, money("20.00")),
    ("o1", 2, "voucher", 1, money("8.50")),
    ("o2", 1, "boleto", 1, money("30.00")),
    ("o3", 1, "credit_card", 2, money("11.00")),
    ("o4", 1, "credit_card", 6, money("9.00")),
    ("o6", 1, "debit_card", 1, money("0.00")),
]  # o5 has no payment and drops out
REVIEWS = [
    ("r1", "o1", 2, None, "first\nline", "2018-01-11 00:00:00", "2018-01-12 00:00:00"),
    ("r2", "o1", 5, None, None, "2018-01-11 00:00:00", "2018-01-13 00:00:00"),
    ("r3", "o1", 4, None, None, "2018-01-11 00:00:00", "2018-01-13 00:00:00"),  # same answer time: greater id wins
    ("r4", "o4", 1, None, None, "2018-04-03 00:00:00", "2018-04-03 00:00:00"),
]
PRODUCTS = [
    ("p1", "moveis", 10, 20, 1, 100.0, 2.0, 3.0, 4.0),
    ("p2", "raro", 10, 20, 1, 100.0, 1.0, 1.0, 1.0),  # category without a translation
    ("p3", None, None, None, None, None, None, 1.0, 1.0),  # no category
]
SELLERS = [("s1", 1000, " Sao Paulo", "sp"), ("s2", 2000, "RIO ", "rj"), ("s3", 1000, "x", "sp"), ("s4", 1000, "idle", "sp")]
POINTS = [
    (1000, -23.5, -46.6, "sao paulo", "SP"), (1000, -23.7, -46.8, "saopaulo", "SP"),
    (2000, -22.9, -43.2, "rio", "RJ"), (3000, -22.9, -47.0, "campinas", "SP"),
]
TRANSLATION = [("moveis", "furniture")]


def bronze(spark) -> Bronze:
    rows = {
        "orders": ORDERS, "customers": CUSTOMERS, "order_items": ITEMS, "order_payments": PAYMENTS,
        "order_reviews": REVIEWS, "products": PRODUCTS, "sellers": SELLERS, "geolocation": POINTS,
        "product_category_name_translation": TRANSLATION,
    }
    return Bronze(**{name: spark.createDataFrame(data, BRONZE[name]) for name, data in rows.items()})
