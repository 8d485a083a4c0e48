"""The computations as DataFrame plans."""
