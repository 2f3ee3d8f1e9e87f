"""The contact feed over the driver's tables, and the queries run on it."""
