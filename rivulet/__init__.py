"""Event-log analytics on Spark: scans, filters, transforms, windows, joins, log maintenance."""
