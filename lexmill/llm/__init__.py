"""Training-data operators: dedup, decontamination, mixing, extraction, labelling and binary output."""
