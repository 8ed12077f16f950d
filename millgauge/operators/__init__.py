"""Reusable table operators: quality gate, typing, rollups, dispatch, layout."""
