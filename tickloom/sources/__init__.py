"""Readers and writers: partition discovery in paths, archive rows, user series, report files."""
