"""Registered queries, grouped by SURVEY section."""

from transvoc.queries import corpus, evaluation, plans, report, transfer  # noqa: F401
