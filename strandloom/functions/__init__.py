"""Column functions: everything here is a Catalyst expression, without Python on the executors."""

from .hgvs import *  # noqa: F403
from .quality import *  # noqa: F403
from .sequence import *  # noqa: F403
