"""Point-in-time-correct time-series analytics and model evaluation on Spark."""
