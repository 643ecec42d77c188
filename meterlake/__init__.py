"""Usage metering on Spark: daily usage facts, their caches, and the queries on them."""
