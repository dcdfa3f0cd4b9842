"""Checkout, cash-on-delivery and returns analytics as Spark DataFrame operators."""
