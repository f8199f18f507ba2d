"""Inventory control formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Z-scores of the named service levels.
SERVICE_Z = {"90%": 1.282, "95%": 1.645, "97.5%": 1.960, "99%": 2.326}
# Z-scores of the sensitivity grid.
SENSITIVITY_Z = {"85%": 1.036, "90%": 1.282, "95%": 1.645, "97.5%": 1.960, "99%": 2.326}


def check_lead_time(days: int) -> int:
    if days <= 0:
        raise ValueError(f"a lead time of {days} days is too short")
    return days


def safety_stock(error_std: Column, z: Column | float, lead_time_days: int) -> Column:
    z = z if isinstance(z, Column) else F.lit(float(z))
    return z * error_std * F.sqrt(F.lit(float(check_lead_time(lead_time_days))))


def reorder_point(mean_daily: Column, lead_time_days: int, safety: Column) -> Column:
    return mean_daily * F.lit(float(check_lead_time(lead_time_days))) + safety


def economic_order_quantity(
    annual_demand: Column, order_cost: float, holding_cost: Column | float
) -> Column:
    """sqrt(2DS/H); 0 without demand. A non-positive holding cost stops the job."""
    if order_cost < 0:
        raise ValueError(f"order cost below zero: {order_cost}")
    if not isinstance(holding_cost, Column):
        if holding_cost <= 0:
            raise ValueError(f"holding cost not above zero: {holding_cost}")
        holding_cost = F.lit(float(holding_cost))
    root = F.sqrt(F.lit(2.0) * annual_demand * F.lit(float(order_cost)) / holding_cost)
    return (
        F.when(annual_demand <= 0, F.lit(0.0))
        .when(holding_cost <= 0, F.raise_error(F.lit("holding cost not above zero")).cast("double"))
        .otherwise(root)
    )


def order_up_to(reorder: Column, target_days: int, mean_daily: Column) -> Column:
    if target_days < 0:
        raise ValueError(f"cannot cover {target_days} days")
    return reorder + F.lit(float(target_days)) * mean_daily
