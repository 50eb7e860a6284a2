"""refloom: citation analytics and text processing expressed as Spark DataFrame plans."""
