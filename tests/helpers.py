"""Small delivery tables for the tests."""

from __future__ import annotations

import datetime as dt

from parcelscope.functions.cleaning import with_order_flags

ORDER_SCHEMA = ("order_id bigint, date date, amount_cents bigint, order_amount double, region string, items_delivered int, "
                "items_missing int, delivery_hour int, driver_id bigint, customer_id bigint")


def day(text):
    return dt.date.fromisoformat(text)


def orders(spark, rows):
    """Rows as dicts; what is left out gets a plain default."""
    out = []
    for i, row in enumerate(rows, 1):
        r = {"order_id": i, "date": "2023-01-02", "amount_cents": 1000, "region": "North", "items_delivered": 4,
             "items_missing": 0, "delivery_hour": 9, "driver_id": 1, "customer_id": 1, **row}
        out.append((r["order_id"], day(r["date"]) if r["date"] else None, r["amount_cents"], r["amount_cents"] / 100.0,
                    r["region"], r["items_delivered"], r["items_missing"], r["delivery_hour"], r["driver_id"],
                    r["customer_id"]))
    return with_order_flags(spark.createDataFrame(out, ORDER_SCHEMA))


def drivers(spark, rows):
    return spark.createDataFrame([(i, f"Driver {i}", 40, trips) for i, trips in rows],
                                 "driver_id bigint, driver_name string, age int, trips int")


def customers(spark, rows):
    return spark.createDataFrame([(i, f"Customer {i}", age) for i, age in rows],
                                 "customer_id bigint, customer_name string, customer_age int")


def column(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def by_key(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
