"""Sources and sinks of series."""
