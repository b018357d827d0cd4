from . import hashing, numeric  # noqa: F401
