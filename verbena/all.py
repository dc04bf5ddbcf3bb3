"""Everything: verbs, functions and constants."""

# ruff: noqa: F401, F403
from verbena._exports import CONFLICTS as _CONFLICTS
from verbena._exports import conflict_access as _conflict_access
from verbena._exports import exported as _exported
from verbena.base import *
from verbena.dplyr import *
from verbena.expr import c, f
from verbena.forcats import *
from verbena.misc import *
from verbena.options import add_option, get_option, options, options_context
from verbena.tibble import *
from verbena.tidyr import *

__all__ = _exported(globals(), _CONFLICTS["all"])
__getattr__ = _conflict_access(globals(), _CONFLICTS["all"])
