"""Training-data operators: filtering, near-duplicate detection, packing and counting.

Nothing else in the library imports this subpackage; it stands on Spark and
on the Python libraries of the workers alone.
"""
