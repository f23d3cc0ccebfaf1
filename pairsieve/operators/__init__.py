"""Table operators: joins, aggregates, windows, graph and model jobs."""
