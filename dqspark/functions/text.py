"""Row-level rules for e-mails, domains and labels. Column in, Column out, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns and lists decide the results.
UNWANTED_EMAIL_CHARS = r"[^a-z0-9@._%+\-]"
VALID_EMAIL = r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\z"
BLOCKED_LOCAL_PARTS = ("no-reply", "noreply", "do-not-reply", "donotreply")
ROLE_INBOXES = ("sales", "info", "contact", "enquiries", "support", "hello", "admin")
ROLE_PREFIXES = ("sales", "info", "contact")
DELIVERABLE_STATUSES = ("valid", "deliverable", "verified")
OCCURRENCE_BUCKETS = ("<50", "50-100", "101-250", "251-300", ">300")


def non_blank(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def email_clean(c: Column) -> Column:
    """Lower, trim, and drop every character an address may not hold; NULL becomes ''."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), UNWANTED_EMAIL_CHARS, "")


def is_valid_email(clean: Column) -> Column:
    return clean.rlike(VALID_EMAIL)


def format_status(clean: Column) -> Column:
    return F.when(clean == "", "empty").when(is_valid_email(clean), "valid").otherwise("invalid")


def is_blocked(clean: Column) -> Column:
    blocked = F.lit(False)
    for local in BLOCKED_LOCAL_PARTS:
        blocked = blocked | clean.startswith(local + "@")
    return blocked


def _part(c: Column, n: int) -> Column:
    return F.split_part(c, F.lit("@"), F.lit(n))


def local_part(c: Column, trimmed: bool = True) -> Column:
    part = _part(c, 1)
    return F.lower(F.trim(part) if trimmed else part)


def email_domain(c: Column, trimmed: bool = True) -> Column:
    """Text between the first and second '@'. Untrimmed, a trailing blank stays and stops a match."""
    part = _part(c, 2)
    return F.lower(F.trim(part) if trimmed else part)


def normalize_domain(fqdn: Column) -> Column:
    """Drop scheme, path and leading www., then trim and lower (so ' https://x' keeps its scheme)."""
    no_scheme = F.regexp_replace(F.coalesce(fqdn, F.lit("")), r"(?i)^https?://", "")
    host = F.substring_index(no_scheme, "/", 1)
    return F.lower(F.trim(F.regexp_replace(host, r"(?i)^www\.", "")))


def website_domain(website: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(website, F.lit(""))), r"^www\.", ""))


def domain_root(domain: Column) -> Column:
    return F.split_part(domain, F.lit("."), F.lit(1))


def alnum_clean(c: Column, lower_first: bool = False) -> Column:
    """Keep a-z and 0-9. By default capitals are stripped before lowering: 'Acme Co' -> 'cmeo'."""
    text = F.coalesce(c, F.lit(""))
    if lower_first:
        text = F.lower(text)
    return F.lower(F.regexp_replace(text, r"[^a-z0-9]+", ""))


def _under(a: Column, b: Column) -> Column:
    return a.endswith(F.concat(F.lit("."), b))


def domain_related(a: Column, b: Column) -> Column:
    """Equal, or one is a subdomain of the other. Literal comparison: `_` and `%` are no wildcards."""
    return (a == b) | _under(a, b) | _under(b, a)


def dotted_suffixes(domain: Column, proper: bool = False) -> Column:
    """['a.b.c', 'b.c', 'c'] for 'a.b.c'; without the whole name when `proper`.

    `b` is in dotted_suffixes(a) exactly when a == b or a is a subdomain of b, which turns the
    subdomain test into an equi-join.
    """
    labels = F.split(domain, r"\.", -1)
    first = 2 if proper else 1
    starts = F.when(F.size(labels) >= first, F.sequence(F.lit(first), F.size(labels))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def six_clause_match(
    email_dom: Column, local: Column, local_clean: Column, company_dom: Column, root: Column, name_clean: Column
) -> Column:
    """Related domains, or the company's root or name (4+ characters) shows up in the address."""
    root_seen = (root != "") & (email_dom.contains(root) | local.contains(root))
    name_seen = (F.length(name_clean) >= 4) & local_clean.contains(name_clean)
    return domain_related(email_dom, company_dom) | root_seen | name_seen


def _label(c: Column, missing: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(missing))


def country_key(c: Column) -> Column:
    return _label(c, "UNKNOWN")


def status_label(c: Column) -> Column:
    return _label(c, "NULL")


def occurrence_bucket(n: Column) -> Column:
    low, mid, high, higher, top = OCCURRENCE_BUCKETS
    return (
        F.when(n < 50, low)
        .when(n.between(50, 100), mid)
        .when(n.between(101, 250), high)
        .when(n.between(251, 300), higher)
        .otherwise(top)
    )


def role_score(local: Column) -> Column:
    prefixed = F.lit(False)
    for prefix in ROLE_PREFIXES:
        prefixed = prefixed | local.startswith(prefix)
    return F.when(local.isin(*ROLE_INBOXES), 10).when(prefixed, 7).otherwise(0)
