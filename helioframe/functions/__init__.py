"""Column expressions: NULL-preserving arithmetic, time axis, sun geometry, irradiance."""
