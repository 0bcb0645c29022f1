"""Timeline analytics on PySpark: timed text, named media, segments and shot plans as DataFrame operators."""
