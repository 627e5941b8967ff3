"""Training-data operators: near-duplicate, decontamination, packing, archive and model scoring jobs."""
