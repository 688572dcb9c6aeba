"""Text operators for training data: packing, evaluation leakage, sentence units."""
