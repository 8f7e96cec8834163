"""Explicit schemas of the five raw text tables and of the missing-items table."""

from __future__ import annotations

from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in columns.items()])


ORDERS = _schema(order_id=StringType, date=StringType, order_amount=StringType, region=StringType,
                 items_delivered=IntegerType, items_missing=IntegerType, delivery_hour=StringType,
                 driver_id=StringType, customer_id=StringType)
CUSTOMERS = _schema(customer_id=StringType, customer_name=StringType, customer_age=IntegerType)
# The product key is misspelled in the raw files.
PRODUCTS = _schema(produc_id=StringType, product_name=StringType, category=StringType, price=StringType)
DRIVERS = _schema(driver_id=StringType, driver_name=StringType, age=IntegerType, Trips=IntegerType)
ORDER_ITEMS = _schema(order_id=StringType, product_id=StringType)
MISSING_ITEMS = _schema(order_id=StringType, product_id_1=StringType, product_id_2=StringType,
                        product_id_3=StringType)

RAW_TABLES = {"orders": ORDERS, "customers": CUSTOMERS, "products": PRODUCTS, "drivers": DRIVERS,
              "order_items": ORDER_ITEMS}
