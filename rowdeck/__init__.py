"""rowdeck: reorder large tables on Spark and prove that no row was lost.

A DataFrame has no row order, so order is data here: every table carries a dense
position column (``0 .. rows-1``) and every operator returns a new position column.
Rows only move physically where an operator or an ordered sink needs it.
"""
