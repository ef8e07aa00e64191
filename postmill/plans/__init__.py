"""Jobs end to end, composed from operators."""
