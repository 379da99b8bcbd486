"""Engine tables derived from the driver's tables."""
