"""Column -> Column building blocks."""

from .rates import cents, pct, ratio2, row_count
from .text import (
    alnum_clean,
    country_key,
    domain_related,
    domain_root,
    dotted_suffixes,
    email_clean,
    email_domain,
    format_status,
    is_blocked,
    is_valid_email,
    local_part,
    non_blank,
    normalize_domain,
    occurrence_bucket,
    role_score,
    six_clause_match,
    status_label,
    website_domain,
)

__all__ = [
    "alnum_clean", "cents", "country_key", "domain_related", "domain_root", "dotted_suffixes", "email_clean",
    "email_domain", "format_status", "is_blocked", "is_valid_email", "local_part", "non_blank", "normalize_domain",
    "occurrence_bucket", "pct", "ratio2", "role_score", "row_count", "six_clause_match", "status_label", "website_domain",
]
