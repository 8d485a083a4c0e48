"""State, change detection, and the drain."""
