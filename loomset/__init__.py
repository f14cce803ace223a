"""Spark DataFrame operators for preparing, scoring and logging fine-tuning data."""
