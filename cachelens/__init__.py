"""Analytics for object-cache fleets on Spark: routing, membership, requests, signing and telemetry as DataFrame operations."""
