"""Web-discovery analytics on Spark: captured pages and archive exports in, discovery records and reports out."""
