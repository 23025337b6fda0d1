"""Veridale: audit analytics over document records, written as Spark jobs."""
