from cohortlens.functions.expr import *  # noqa: F401,F403
from cohortlens.functions.stats import *  # noqa: F401,F403
