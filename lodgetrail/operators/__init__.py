"""Keyed, windowed and set-shaped steps that the plans are composed of."""
