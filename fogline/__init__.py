"""Forecast-verification and gridded-nowcast analytics on Spark."""
