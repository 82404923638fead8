"""tideline: time-series and corpus analytics expressed as Spark jobs."""
