"""Review operators, each a function from DataFrames to a DataFrame.

``keys`` names the columns of one report group, usually product and week.
"""
