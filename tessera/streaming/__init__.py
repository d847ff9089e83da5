"""Results that come bit by bit: rows, pages, and streams of events."""
