"""Spark jobs over large collections of meeting records: transcripts, notes, tasks, jobs and logs."""
