from eventide.functions.arrays import head_nonpad, left_pad, to_text
from eventide.functions.hashing import uniform
from eventide.functions.tokens import family, suffix_int

__all__ = ["head_nonpad", "left_pad", "to_text", "uniform",
           "family", "suffix_int"]
