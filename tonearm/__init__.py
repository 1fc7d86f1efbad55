"""tonearm: media-catalog analytics written for Spark's DataFrame and SQL APIs."""
