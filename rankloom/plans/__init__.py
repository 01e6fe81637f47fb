"""Training plans (epochs, batches, schedules) and experiment grids."""
