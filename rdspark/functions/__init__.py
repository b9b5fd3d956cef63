"""Column functions: results arithmetic, rate ladders, pixel conversions, sampling draws."""
