"""Point-in-time analytics on Spark DataFrames.

Every version of a value is kept together with the dates between which it was
believed; every read answers a table of ``(ticker, as_of)`` requests exactly as
it could have been answered on each date.
"""
