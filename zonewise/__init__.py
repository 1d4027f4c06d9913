"""Small-area panel, graph, forecast-evaluation and site-planning operators on Spark DataFrames."""
