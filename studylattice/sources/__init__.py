"""Table schemas, file scans, sinks and the bindings to the star-schema test tables."""
