"""Named queues of JSON events on Spark: ingest, read, archive, route, measure."""
