"""Plans over streams.

The plan operators that keep no state (filters, projections, bag unions, joins with a static table) are DataFrame functions and
run on streaming DataFrames as they are. Watermarks, windows and state are outside this engine's scope.
"""
