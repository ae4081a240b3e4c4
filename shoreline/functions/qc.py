"""Quality bits of the products. The values are fixed."""

#: Inundation and snapshot.
EXTRAPOLATED, SPATIAL_FALLBACK, INSUFFICIENT, DATUM_INVALID, DATUM_APPROX = 1, 2, 4, 8, 16
MIN_SPACING, CONNECTIVITY, VALIDITY_BOUNDARY, MAX_REFINEMENT, NODATA = 32, 64, 128, 256, 65535
#: Exposure.
X_DEGRADED, X_INSUFFICIENT, X_DATUM_APPROX, X_NO_TERMINAL, X_PARTIAL, X_SUBMERGED, X_EXPOSED = 1, 2, 4, 8, 16, 32, 64
#: Conversion.
C_NATIVE, C_EXTRAPOLATED, C_NODATA = 0, 1, 2
