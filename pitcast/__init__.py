"""pitcast: point-in-time forecasting analytics expressed as Spark DataFrame jobs."""
