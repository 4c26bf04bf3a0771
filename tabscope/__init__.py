"""tabscope: tabular profiling, model evaluation and forecasting as Spark jobs."""
