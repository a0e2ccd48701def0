"""evisite: evidence for marked sequence sites, as plain PySpark DataFrame jobs."""
