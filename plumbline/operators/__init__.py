"""Relational operators of integrity analysis: links, graphs, ladders, windows, sets, reports."""
