"""Delivery-quality analytics as PySpark DataFrame operators."""
