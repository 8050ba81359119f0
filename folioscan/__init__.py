"""Literature-corpus analytics on Spark: search, chunking, extraction and index upkeep as DataFrame plans."""
