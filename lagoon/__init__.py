"""Analytics over operational and latency data as Spark DataFrame operators."""
