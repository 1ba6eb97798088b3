"""DataFrame -> DataFrame operators (filters, aggregates, windows, clustering, alerts)."""
