"""Product-analytics operators on Spark DataFrames.

``sources``    typed readers, result writers, scratch tables
``functions``  Column helpers: ratios, rounding, calendar, statistics
``operators``  the analytics themselves: DataFrames in, DataFrame out
``plans``      operators wired into whole reports
"""
