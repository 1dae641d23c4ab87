"""Registered queries, each with the SQL that gives the same rows."""

from loomgrid.plans import documents, graphs, grids, layouts, names, ranges, regions, rules, scores, texts

MODULES = [grids, names, graphs, texts, ranges, rules, layouts, regions, documents, scores]
