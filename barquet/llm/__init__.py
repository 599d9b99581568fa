"""Training-data operators: filtering, formats, packing, linking and scoring of text."""
