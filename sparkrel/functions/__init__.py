"""Scalar and aggregate functions over expressions."""

from .aggregate import avg, count, count_distinct, max_, min_, sum_
from .geo import st_distance
from .registry import call, register_fn
from .scalar import abs_, add, ceil, div, floor, left, length, lower, mod, mul, now, position, power, right, round_, sub, trim, trunc, upper, uuidv4, uuidv7
from .vector import cosine_distance, hamming_distance, inner_product, jaccard_distance, l1_distance, l2_distance

__all__ = [
    "abs_", "add", "avg", "call", "ceil", "cosine_distance", "count", "count_distinct", "div", "floor", "hamming_distance", "inner_product", "jaccard_distance", "l1_distance", "l2_distance", "left", "length", "lower", "max_", "min_", "mod", "mul",
    "now", "position", "power", "register_fn", "right", "round_", "st_distance", "sub", "sum_", "trim", "trunc", "upper", "uuidv4", "uuidv7",
]
