"""Patent-record analytics as ordinary Spark jobs."""
