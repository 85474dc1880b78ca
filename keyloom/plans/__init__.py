"""From a query, however written, to an intermediate form, an access path and a DataFrame."""
