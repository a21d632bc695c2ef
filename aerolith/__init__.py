"""Multi-horizon forecasting of hourly station series as Spark jobs."""
