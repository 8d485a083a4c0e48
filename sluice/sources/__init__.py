"""Sources: polling, reconciliation of what a poll observed, schedules."""
