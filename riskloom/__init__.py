"""Insurance-claim risk analytics as set-at-a-time Spark operators."""
