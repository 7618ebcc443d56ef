"""Interval algebra, alignment, filters, maps, detection, hiccups and reports over recordings."""
