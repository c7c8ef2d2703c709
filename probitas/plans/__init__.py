"""From checks to Spark aggregations and back to results."""
