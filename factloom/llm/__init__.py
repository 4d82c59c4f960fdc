"""Training-data operators: language ID, dedup, decontamination, packing and the like."""
