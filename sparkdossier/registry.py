"""Names of the engine's queries, what runs them, and the SQL they are held against."""

from __future__ import annotations

import sparkdossier.plans.contact_queries  # noqa: F401  registers its queries
import sparkdossier.plans.folder_queries  # noqa: F401  registers its queries
import sparkdossier.plans.guard_queries  # noqa: F401  registers its queries
import sparkdossier.plans.layout_queries  # noqa: F401  registers its queries
import sparkdossier.plans.more_queries  # noqa: F401  registers its queries
import sparkdossier.plans.profile_queries  # noqa: F401  registers its queries
import sparkdossier.plans.scan_queries  # noqa: F401  registers its queries
import sparkdossier.plans.scoring_queries  # noqa: F401  registers its queries
import sparkdossier.plans.service_queries  # noqa: F401  registers its queries
from sparkdossier.plans.queries import ORACLE, QUERIES

FLAGSHIP = "c4_contradictions"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
