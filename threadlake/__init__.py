"""Agent-session analytics on Spark: an event log, its derived views and the queries over them."""
