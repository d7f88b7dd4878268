"""Network-flow analytics and threshold detection on Spark."""
