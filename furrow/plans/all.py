"""Imports every plan module, which registers its queries."""

from furrow.plans import environment, feedback, files, manifests, market, paths, rejects, releases, scoring, settings, versions  # noqa: F401
