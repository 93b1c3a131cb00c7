from rowdeck.functions.hashing import coin, draw, uniform, uniform_int
from rowdeck.functions.scalars import (
    argmax,
    digit,
    digit_count,
    idiv,
    reversed_digits,
    readable_size,
    round_significant,
    strip,
)

__all__ = [
    "argmax",
    "coin",
    "digit",
    "digit_count",
    "draw",
    "idiv",
    "readable_size",
    "reversed_digits",
    "round_significant",
    "strip",
    "uniform",
    "uniform_int",
]
