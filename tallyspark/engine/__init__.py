"""Sessions, guards, evidence and the helpers that every operator shares."""
