"""Readers and writers: tab-separated traces, logs, fixed-width binary records, sound, profiles and reports."""
