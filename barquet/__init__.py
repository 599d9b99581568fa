"""Daily equity-bar analytics as Spark DataFrame transforms."""
