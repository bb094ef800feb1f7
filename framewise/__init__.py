"""Analytics over exact, ordered, per-frame data, as Spark jobs."""
