"""Sinks: tables, assignment workbooks (as folders) and JSON records."""
