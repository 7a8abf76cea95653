"""Analytics of activity bursts and the text around them, on PySpark."""
