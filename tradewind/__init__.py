"""Commerce analytics as Spark jobs: models, readers, experiments, scoring and forecasts."""
