"""Spark jobs over strand-aware genomic intervals: pile-ups, stop-signal statistics, sites, motifs, reports."""
