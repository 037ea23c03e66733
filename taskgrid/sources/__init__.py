"""Sources: the task-list readers and the fixtures derived from test tables."""
