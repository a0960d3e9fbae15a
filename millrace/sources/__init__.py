"""Table sources, script sources and sinks."""
