"""Demand forecasting and inventory analytics as Spark DataFrame jobs."""
