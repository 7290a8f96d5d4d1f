"""Scalar Column functions (F1-F27). All are built-in Spark expressions, so
they stay inside whole-stage codegen."""

from payguard.functions.core import *  # noqa: F401,F403
from payguard.functions.core import __all__  # noqa: F401
