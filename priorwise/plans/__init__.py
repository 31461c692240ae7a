"""Assembled jobs: carrier views, feature frames, backtests and the query registry."""
