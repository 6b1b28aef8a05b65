from panelloom.plans import conflict, forecast, merged, model_ready, structural, volatility

__all__ = ["conflict", "forecast", "merged", "model_ready", "structural", "volatility"]
