"""Time-series aggregation for energy-system planning, on Spark."""
