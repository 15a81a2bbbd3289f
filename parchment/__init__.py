"""Document capture on Spark: page geometry, filters, capture quality, text boxes and lines, sessions, exports."""
