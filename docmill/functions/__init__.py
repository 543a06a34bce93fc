"""Column -> Column functions (URLs, slugs, text)."""
from .text import *  # noqa: F401,F403
from .urls import *  # noqa: F401,F403
