"""DataFrame operators over ordered traces: rows with a whole-number order column, and optional keys that name a stream."""
