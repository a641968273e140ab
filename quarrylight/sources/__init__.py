"""Sources and sinks: record files, indexes, predictions, mappings, benchmark files and artifacts."""
