"""Part of reelgrid."""
