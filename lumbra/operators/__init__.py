"""Operators on DataFrames: chunking, search, snapshots, symbol graph, telemetry, retention and scheduling."""
