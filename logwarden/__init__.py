"""Security-log analytics on Spark: plain DataFrame-to-DataFrame functions."""
