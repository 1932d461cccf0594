from shopsignal.functions import constants, scalar  # noqa: F401
