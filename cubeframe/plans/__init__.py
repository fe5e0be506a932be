"""Part of cubeframe."""

from cubeframe.plans import reports, shapes, tools, training  # noqa: F401  these register their queries
