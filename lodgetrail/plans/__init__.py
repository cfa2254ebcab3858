"""Whole questions: catalogue pages, counters, facets, maps, exports, scans."""
