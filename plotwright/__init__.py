"""Curve data recovered from charts, corrected, compared and bound, as lazy DataFrame transformations."""
