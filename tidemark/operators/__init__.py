"""DataFrame operators: joins, windows, identity, aggregation, validation, selection, state."""
