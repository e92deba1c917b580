"""Supplier-document analytics as Spark DataFrame transformations."""
