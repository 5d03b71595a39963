"""The registered queries as DuckDB SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from .fixtures import ctes, later
from .queries import EVENT_THRESHOLDS, MIN_TOTAL, RUN_ID, VENDOR_THRESHOLD

# Fixed values, stated here anew so that a slip in the library shows.
BLOCKED_LOCAL_PARTS = ["no-reply", "noreply", "do-not-reply", "donotreply"]
ROLE_INBOXES = ["sales", "info", "contact", "enquiries", "support", "hello", "admin"]
ROLE_PREFIXES = ["sales", "info", "contact"]
DELIVERABLE_STATUSES = ["valid", "deliverable", "verified"]
DEFAULT_THRESHOLDS = {
    "coverage_without_email_pct": 30,
    "domain_status_not_200_pct": 30,
    "invalid_format_pct": 2,
    "duplicate_email_pct": 5,
    "domain_mismatch_pct": 30,
    "blocked_email_pct": 1,
    "gt5_email_country_pct_max": 2,
}
METRIC_LABELS = {
    "coverage_with_email_pct": "Coverage: % companies with ≥1 email",
    "coverage_without_email_pct": "Coverage: % companies without email",
    "domain_status_not_200_pct": "Domains: % not-200",
    "invalid_format_pct": "Email format: % invalid",
    "duplicate_email_pct": "Duplicate emails: %",
    "domain_mismatch_pct": "Domain mismatch: %",
    "blocked_email_pct": "Blocked emails: %",
    "gt5_email_country_pct_max": "Max country % of companies with >5 emails",
}
ACTION_RULES = {
    "coverage_without_email_pct": "[SLA] Low email coverage — investigate ingestion gaps and ID mapping.",
    "domain_status_not_200_pct": "[SLA] High non-200 domains — improve enrichment/retry and validate vendor domains.",
    "invalid_format_pct": "[DQ] High invalid formats — improve cleaning, block masked/placeholder values, fix upstream.",
    "duplicate_email_pct": "[DQ] High duplicates — enforce dedupe and identify duplicate-producing source.",
    "domain_mismatch_pct": "[DQ] High mismatch — improve parsing/mapping + controlled exceptions (free-mail, group domains).",
    "blocked_email_pct": "[DQ] High blocked emails — expand blocklist and drop no-reply early.",
    "gt5_email_country_pct_max": "[DQ] High >5 emails rate — enforce top-5 policy and prune noisy emails per country.",
}
# Parts of the composite score; True where a higher rate is better.
COMPONENTS = {
    "coverage_with_email_pct": True,
    "invalid_format_pct": False,
    "duplicate_email_pct": False,
    "blocked_email_pct": False,
    "domain_mismatch_pct": False,
    "domain_status_not_200_pct": False,
    "gt5_email_country_pct_max": False,
}


def pct(a: str, b: str) -> str:
    return f"(((20000 * ({a}) + ({b})) // nullif(2 * ({b}), 0)) / 100.0)"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


CLEAN = r"regexp_replace(lower(trim(coalesce(email, ''))), '[^a-z0-9@._%+\-]', '', 'g')"
VALID_PATTERN = r"'^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$'"


def valid(clean: str) -> str:
    return f"regexp_matches({clean}, {VALID_PATTERN})"


def blocked(clean: str) -> str:
    return f"regexp_matches({clean}, '^({'|'.join(BLOCKED_LOCAL_PARTS)})@')"


def filled(column: str) -> str:
    return f"({column} IS NOT NULL AND trim({column}) <> '')"


def host(column: str) -> str:
    no_scheme = f"regexp_replace(coalesce({column}, ''), '^https?://', '', 'i')"
    return rf"lower(trim(regexp_replace(split_part({no_scheme}, '/', 1), '^www\.', '', 'i')))"


def alnum(text: str) -> str:
    return f"lower(regexp_replace({text}, '[^a-z0-9]+', '', 'g'))"


def related(a: str, b: str) -> str:
    return f"({a} = {b} OR ends_with({a}, '.' || {b}) OR ends_with({b}, '.' || {a}))"


def label(column: str, missing: str) -> str:
    return f"coalesce(nullif(trim({column}), ''), '{missing}')"


def role(local: str) -> str:
    prefixed = " OR ".join(f"starts_with({local}, '{p}')" for p in ROLE_PREFIXES)
    return f"(CASE WHEN {local} IN ({quoted(ROLE_INBOXES)}) THEN 10 WHEN {prefixed} THEN 7 ELSE 0 END)"


def statement(views: list[str], body: str, **named: str) -> str:
    """WITH the input views, then the named CTEs, then `body`."""
    parts = [ctes(*views), *[f"{name} AS ({text})" for name, text in named.items()]]
    return "WITH " + ",\n".join(parts) + "\n" + body


HUB_EMAILS, EMAILS, DOMAINS = ["persona_hub", "emails"], ["emails"], ["domains"]
DOMAINS_EMAILS = ["domains", "emails"]

COVERAGE_COLUMNS = ["total_companies", "companies_with_email", "companies_without_email"]


def coverage_columns(total: str = "count(*)", flag: str = "has_email") -> str:
    having, lacking = f"count(*) FILTER (WHERE {flag})", f"count(*) FILTER (WHERE NOT {flag})"
    return f"""{total} AS total_companies, {having} AS companies_with_email, {lacking} AS companies_without_email,
  {pct(having, "count(*)")} AS pct_with_email, {pct(lacking, "count(*)")} AS pct_without_email"""


def company_flags(table: str, key: str, group: str, present: str, where: str = "true") -> str:
    """Per group of `table`: is there a present e-mail for `key`?"""
    return f"""SELECT {group}, bool_or(EXISTS (SELECT 1 FROM emails e WHERE e.{key} = t.{key} AND {present})) AS has_email
FROM {table} t WHERE {where} GROUP BY ALL"""


PER_COMPANY = company_flags("persona_hub", "id", "id", filled("e.email"))
PER_SOURCE = company_flags("persona_hub", "id", "source, id", filled("e.email"))
PER_PUBLISHED = company_flags("persona_hub", "slug", "source, id", "e.email IS NOT NULL", "status = 'PUBLISHED'")
PER_DOMAIN_ID = company_flags("domains", "id", "id", "e.email IS NOT NULL", "id IS NOT NULL")
BY_SOURCE = f"SELECT source, {coverage_columns('count(DISTINCT id)')} FROM flags GROUP BY source"

STATUS_TEXT = """CASE WHEN status_code = 200 THEN 'Status Code 200' WHEN status_code IS NULL THEN 'Missing Status Code'
  ELSE 'Status Code not 200' END"""

CLEANED = f"SELECT email_id, id, country, email, {CLEAN} AS email_clean FROM emails"
FORMAT = f"CASE WHEN email_clean = '' THEN 'empty' WHEN {valid('email_clean')} THEN 'valid' ELSE 'invalid' END"
VALID_ROWS = f"SELECT * FROM cleaned WHERE {valid('email_clean')}"
OCCURRENCES = "SELECT email_clean, count(*) AS occurrences FROM good GROUP BY email_clean"
BUCKET = """CASE WHEN {n} < 50 THEN '<50' WHEN {n} <= 100 THEN '50-100' WHEN {n} <= 250 THEN '101-250'
  WHEN {n} <= 300 THEN '251-300' ELSE '>300' END"""


def company(lower_first: bool = False) -> str:
    name = "lower(coalesce(name, ''))" if lower_first else "coalesce(name, '')"
    return f"""SELECT id, name, {host('fqdn')} AS company_domain, split_part({host('fqdn')}, '.', 1) AS company_root,
  {alnum(name)} AS name_clean FROM persona_hub WHERE {filled('fqdn')} AND contains(fqdn, '.')"""


def address(lower_first: bool = False) -> str:
    local = "lower(split_part(email, '@', 1))" if lower_first else "split_part(email, '@', 1)"
    return f"""SELECT email_id, id, country, lower(trim(email)) AS email, lower(trim(split_part(email, '@', 1))) AS local_part,
  lower(trim(split_part(email, '@', 2))) AS email_domain, {alnum(local)} AS local_clean
FROM emails WHERE {filled('email')} AND contains(email, '@')"""


SIX_CLAUSES = f"""({related('email_domain', 'company_domain')}
  OR (company_root <> '' AND (contains(email_domain, company_root) OR contains(local_part, company_root)))
  OR (length(name_clean) >= 4 AND contains(local_clean, name_clean)))"""
EVALUATED = f"SELECT c.id, c.name, c.company_domain, a.country, a.email, {SIX_CLAUSES} AS fits FROM company c JOIN address a ON a.id = c.id"
STATUS = "SELECT id, country, bool_or(fits) AS has_match FROM evaluated GROUP BY id, country"
MATCHING = f"""count(*) AS total_companies, count(*) FILTER (WHERE has_match) AS companies_valid,
  {pct('count(*) FILTER (WHERE has_match)', 'count(*)')} AS pct_companies_valid,
  count(*) FILTER (WHERE NOT has_match) AS companies_invalid,
  {pct('count(*) FILTER (WHERE NOT has_match)', 'count(*)')} AS pct_companies_invalid"""
BY_COUNTRY = f"SELECT country, {MATCHING} FROM status GROUP BY country"


def matching(lower_first: bool = False) -> dict[str, str]:
    return dict(company=company(lower_first), address=address(lower_first), evaluated=EVALUATED, status=STATUS)


MISMATCH = f"""SELECT n, ((200 * (10000 * n - weighted) + 100 * n) // (200 * n)) / 100.0 AS mismatch_pct,
  {pct('bad', 'n')} AS mismatch_pct_exact FROM (
  SELECT cast(sum(total_companies) AS bigint) AS n, cast(sum(companies_invalid) AS bigint) AS bad,
    cast(sum(cast(round(pct_companies_valid * 100) AS bigint) * total_companies) AS bigint) AS weighted FROM by_country)"""

LARGEST = """SELECT id, name, company_domain, total_emails FROM (SELECT DISTINCT id, name, company_domain FROM evaluated) e
JOIN (SELECT id, count(*) AS total_emails FROM evaluated GROUP BY id) t USING (id)
ORDER BY total_emails DESC, id, name NULLS LAST, company_domain LIMIT 20"""

ROOTS = """SELECT id, country, status_code, fqdn, email, split_part(fqdn, '.', 1) AS company_root,
  split_part(split_part(email, '@', 2), '.', 1) AS email_root FROM (
  SELECT d.id, d.country, d.status_code, lower(trim(d.fqdn)) AS fqdn, lower(trim(e.email)) AS email
  FROM domains d JOIN emails e ON e.id = d.id)
WHERE fqdn <> '' AND email <> '' AND contains(email, '@') AND contains(fqdn, '.')"""

PAIRS = f"""SELECT id, {label('country', 'UNKNOWN')} AS country, count(*) FILTER (WHERE {filled('email')}) AS email_count
FROM emails GROUP BY ALL"""
VOLUME = f"""SELECT country, count(*) AS total_company_country,
  count(*) FILTER (WHERE email_count <= 5) AS companies_le5_emails,
  {pct('count(*) FILTER (WHERE email_count <= 5)', 'count(*)')} AS pct_companies_le5_emails,
  count(*) FILTER (WHERE email_count > 5) AS companies_gt5_emails,
  {pct('count(*) FILTER (WHERE email_count > 5)', 'count(*)')} AS pct_companies_gt5_emails
FROM pairs GROUP BY country"""


def ranking(limit: int | None, dedupe: bool = False) -> str:
    website = f"SELECT id, {host('fqdn')} AS company_domain FROM domains WHERE {filled('fqdn')} AND contains(fqdn, '.')"
    base = f"""SELECT email_id, id, {label('country', 'UNKNOWN')} AS country, lower(trim(email)) AS email, {CLEAN} AS email_clean,
  lower(split_part(email, '@', 1)) AS local_part, lower(split_part(email, '@', 2)) AS email_domain,
  {label('verification_status', 'NULL')} AS verification_status FROM emails WHERE {filled('email')}"""
    flagged = f"""SELECT *, cast({valid('email_clean')} AS int) AS is_valid_format, cast({blocked('email_clean')} AS int) AS is_blocked,
  cast(count(*) OVER (PARTITION BY id, country, email_clean) > 1 AS int) AS is_duplicate_within_company FROM base"""
    match = related("f.email_domain", "w.company_domain")
    joined = f"""SELECT f.*, CASE WHEN w.company_domain IS NOT NULL AND {match} THEN 1 ELSE 0 END AS domain_match
FROM flagged f LEFT JOIN website w ON w.id = f.id"""
    if dedupe:
        joined = f"""SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM website w WHERE w.id = f.id AND {match}) THEN 1 ELSE 0 END
AS domain_match FROM flagged f"""
    scored = f"""SELECT *, 50 * is_valid_format + 15 * (1 - is_duplicate_within_company) + 15 * (1 - is_blocked)
  + 10 * domain_match + {role('local_part')}
  + (CASE WHEN verification_status IN ({quoted(DELIVERABLE_STATUSES)}) THEN 5 ELSE 0 END) AS priority_score FROM joined"""
    ranked = """SELECT *, count(*) OVER (PARTITION BY id, country) AS total_emails_for_company_country,
  row_number() OVER (PARTITION BY id, country ORDER BY priority_score DESC, email_clean, email, verification_status,
    domain_match DESC) AS email_rank FROM scored"""
    body = f"""SELECT id, country, total_emails_for_company_country, email_rank, priority_score, email, is_valid_format,
  is_duplicate_within_company, is_blocked, domain_match, verification_status FROM ranked
WHERE total_emails_for_company_country >= {MIN_TOTAL} AND email_rank <= 5
ORDER BY total_emails_for_company_country DESC, id, country, email_rank {f'LIMIT {limit}' if limit else ''}"""
    return statement(
        DOMAINS_EMAILS, body, website=website, base=base, flagged=flagged, joined=joined, scored=scored, ranked=ranked
    )


def metrics_sql() -> str:
    t = DEFAULT_THRESHOLDS

    def row(key: str, value: str, details: str) -> str:
        grade = "'ok'" if key not in t else (
            f"CASE WHEN {value} IS NULL THEN 'unknown' WHEN {value} >= {t[key]} THEN 'breach' ELSE 'ok' END"
        )
        return f"SELECT '{RUN_ID}' AS run_id, '{key}' AS metric_key, '{METRIC_LABELS[key]}' AS metric_label, {value} AS value_pct, {grade} AS severity, {details} AS details_json FROM rates"

    def limit(key: str, more: str = "'}'") -> str:
        return f"""'{{"threshold":"{t[key]}"' || {more}"""

    more = """',"unique_duplicate_emails":"' || cast(unique_dups AS string) || '"}'"""
    rows = [
        row("coverage_with_email_pct", "with_pct", """'{"pct_without_email":"' || cast(without_pct AS string) || '"}'"""),
        row("coverage_without_email_pct", "without_pct", limit("coverage_without_email_pct")),
        row("domain_status_not_200_pct", "not_200", limit("domain_status_not_200_pct")),
        row("invalid_format_pct", "bad_format", limit("invalid_format_pct")),
        row("duplicate_email_pct", "dup", limit("duplicate_email_pct", more)),
        row("domain_mismatch_pct", "mismatch", limit("domain_mismatch_pct")),
        row("blocked_email_pct", "blocked", limit("blocked_email_pct")),
        row("gt5_email_country_pct_max", "gt5", limit("gt5_email_country_pct_max")),
    ]
    per_key = "SELECT count(*) AS n FROM good GROUP BY id, country, email_clean"
    rates = f"""SELECT (SELECT {pct('count(*) FILTER (WHERE has_email)', 'count(*)')} FROM flags) AS with_pct,
  (SELECT {pct('count(*) FILTER (WHERE NOT has_email)', 'count(*)')} FROM flags) AS without_pct,
  (SELECT {pct('count(*) FILTER (WHERE status_code <> 200)', 'count(*)')} FROM domains) AS not_200,
  (SELECT {pct("nullif(count(*) FILTER (WHERE format_status = 'invalid'), 0)", 'count(*)')} FROM formats) AS bad_format,
  (SELECT {pct('count(*) FILTER (WHERE n > 1)', 'count(*)')} FROM per_key) AS dup,
  (SELECT count(*) FROM occurrences WHERE occurrences > 1) AS unique_dups,
  (SELECT mismatch_pct FROM mismatched) AS mismatch,
  (SELECT {pct(f"count(*) FILTER (WHERE {blocked('email_clean')})", 'count(*)')} FROM good) AS blocked,
  (SELECT max(pct_companies_gt5_emails) FROM volume) AS gt5"""
    return statement(
        ["persona_hub", "emails", "domains"],
        " UNION ALL ".join(rows),
        flags=PER_COMPANY,
        cleaned=CLEANED,
        formats=f"SELECT {FORMAT} AS format_status FROM cleaned",
        good=VALID_ROWS,
        per_key=per_key,
        occurrences=OCCURRENCES,
        **matching(),
        by_country=BY_COUNTRY,
        mismatched=MISMATCH,
        pairs=PAIRS,
        volume=VOLUME,
        rates=rates,
    )


EVENT_LIMIT = "CASE metric_key " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_THRESHOLDS.items()) + " END"
GRADED = f"""SELECT run_id, metric_key, value_pct, CASE WHEN {EVENT_LIMIT} IS NULL THEN 'ok' WHEN value_pct IS NULL THEN 'unknown'
  WHEN value_pct >= {EVENT_LIMIT} THEN 'breach' ELSE 'ok' END AS severity FROM dq_metrics"""
BREACHED = """SELECT run_id, metric_key, 'Label of ' || metric_key AS metric_label, value_pct, severity FROM graded
WHERE severity = 'breach'"""


def action_text(rules: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {quoted([v])}" for k, v in rules.items())
    return f"CASE metric_key {cases} ELSE '[DQ] Review breach: ' || metric_label END"


POINTS = f"""SELECT run_id, cast(CASE WHEN metric_key IN ({quoted(k for k, up in COMPONENTS.items() if up)}) THEN value_pct
  ELSE 100 - value_pct END AS bigint) AS points FROM dq_metrics WHERE metric_key IN ({quoted(COMPONENTS)})"""
COMPOSITE = """SELECT run_id, sign(total) * (cast(200 * abs(total) + n AS bigint) // nullif(2 * n, 0)) / 100.0 AS composite_score FROM (
  SELECT run_id, cast(sum(points) AS bigint) AS total, count(points) AS n FROM points GROUP BY run_id)"""

ALL_OTHER_RULES = {k: v for k, v in ACTION_RULES.items() if k != "blocked_email_pct"}

OPERATORS: dict[str, str] = {
    "coverage_overall": statement(HUB_EMAILS, f"SELECT {coverage_columns()} FROM flags", flags=PER_COMPANY),
    "coverage_by_source": statement(HUB_EMAILS, BY_SOURCE, flags=PER_SOURCE),
    "coverage_by_source_blank_counts": statement(
        HUB_EMAILS, BY_SOURCE, flags=company_flags("persona_hub", "id", "source, id", "e.email IS NOT NULL")
    ),
    "coverage_published_by_source": statement(
        HUB_EMAILS, f"SELECT source, {coverage_columns()} FROM flags GROUP BY source", flags=PER_PUBLISHED
    ),
    "coverage_published_total": statement(
        HUB_EMAILS, f"SELECT {coverage_columns('count(DISTINCT id)')} FROM flags", flags=PER_PUBLISHED
    ),
    "coverage_domain_universe": statement(
        DOMAINS_EMAILS, f"SELECT {coverage_columns()} FROM flags", flags=PER_DOMAIN_ID
    ),
    "coverage_delta": statement(
        ["persona_hub", "emails", "domains"],
        """SELECT b.companies_with_email - s.companies_with_email AS delta_with, b.total_companies - s.total_companies AS delta_total,
  (b.cents - s.cents) / 100.0 AS delta_pct_with, abs((b.cents - s.cents) / 100.0) < 0.5 AS ok FROM src s, brz b""",
        published=PER_PUBLISHED,
        listed=PER_DOMAIN_ID,
        src=f"SELECT *, cast(round(coalesce(pct_with_email, 0) * 100) AS bigint) AS cents FROM (SELECT {coverage_columns('count(DISTINCT id)')} FROM published)",
        brz=f"SELECT *, cast(round(coalesce(pct_with_email, 0) * 100) AS bigint) AS cents FROM (SELECT {coverage_columns()} FROM listed)",
    ),
    "coverage_reconcile": statement(
        HUB_EMAILS,
        "SELECT "
        + ", ".join(f"o.{c} AS overall_{c}, r.{c} AS rollup_{c}" for c in COVERAGE_COLUMNS)
        + ", "
        + " AND ".join(f"o.{c} = r.{c}" for c in COVERAGE_COLUMNS)
        + " AS matches FROM overall o, rolled r",
        per_company=PER_COMPANY,
        flags=PER_SOURCE,
        overall=f"SELECT {coverage_columns()} FROM per_company",
        rolled="SELECT "
        + ", ".join(f"cast(sum({c}) AS bigint) AS {c}" for c in COVERAGE_COLUMNS)
        + f" FROM ({BY_SOURCE})",
    ),
    "coverage_reconcile_reasons": statement(
        HUB_EMAILS,
        """SELECT count(*) FILTER (WHERE id IS NOT NULL AND vendors > 1) AS ids_with_several_vendors,
  cast(coalesce(sum(vendors - 1) FILTER (WHERE id IS NOT NULL), 0) AS bigint) AS further_vendors,
  count(*) FILTER (WHERE id IS NULL) AS companies_without_id,
  count(*) FILTER (WHERE id IS NOT NULL AND nameless) AS ids_without_vendor,
  cast((SELECT coalesce(sum(n - 1), 0) FROM hub_pairs) AS bigint) AS repeated_hub_rows,
  cast((SELECT sum(total_companies) FROM by_source) - (SELECT count(*) FROM per_company) AS bigint) AS total_difference
FROM per_id""",
        per_company=PER_COMPANY,
        flags=PER_SOURCE,
        by_source=BY_SOURCE,
        hub_pairs="SELECT id, source, count(*) AS n FROM persona_hub GROUP BY id, source",
        per_id=f"SELECT id, count(*) AS vendors, bool_or(NOT {filled('source')}) AS nameless FROM hub_pairs GROUP BY id",
    ),
    "coverage_reconcile_email_reasons": statement(
        HUB_EMAILS,
        """SELECT CASE WHEN mailed THEN 'with e-mail' ELSE 'without e-mail' END AS companies,
  count(*) FILTER (WHERE id IS NOT NULL AND vendors > 1) AS ids_with_several_vendors,
  cast(coalesce(sum(vendors - 1) FILTER (WHERE id IS NOT NULL), 0) AS bigint) AS further_vendors,
  cast(coalesce(sum(vendors - 1) FILTER (WHERE id IS NULL), 0) AS bigint) AS further_vendors_without_id,
  cast((SELECT sum(CASE WHEN k.mailed THEN companies_with_email ELSE companies_without_email END) FROM by_source) - count(id)
    - count(DISTINCT coalesce(cast(id AS varchar), 'none')) FILTER (WHERE id IS NULL) AS bigint) AS difference
FROM (VALUES (true), (false)) k(mailed) LEFT JOIN per_id USING (mailed) GROUP BY mailed""",
        flags=PER_SOURCE,
        by_source=BY_SOURCE,
        per_id=f"""SELECT id, count(DISTINCT coalesce(source, '~none')) AS vendors,
  coalesce(id IN (SELECT id FROM emails WHERE id IS NOT NULL AND {filled('email')}), false) AS mailed FROM persona_hub GROUP BY id""",
    ),
    "vendor_reachout": statement(
        HUB_EMAILS,
        """SELECT *, pct_without_email >= 11 AS reach_out_flag, CASE WHEN pct_without_email >= 11 THEN 'Reach out' ELSE 'OK' END
  AS reach_out_label FROM by_source""",
        flags=PER_SOURCE,
        by_source=BY_SOURCE,
    ),
    "domain_status_distribution": statement(
        DOMAINS,
        f"""SELECT s.status, count(d.status) AS domain_count, {pct('count(d.status)', '(SELECT count(*) FROM domains)')} AS pct
FROM (VALUES ('Status Code 200'), ('Status Code not 200'), ('Missing Status Code')) s(status)
LEFT JOIN (SELECT {STATUS_TEXT} AS status FROM domains) d ON d.status = s.status GROUP BY s.status""",
    ),
    "domain_status_summary": statement(
        DOMAINS,
        f"""SELECT count(*) AS total_domains, count(*) FILTER (WHERE status_code = 200) AS status_200,
  {pct('count(*) FILTER (WHERE status_code = 200)', 'count(*)')} AS pct_200,
  count(*) FILTER (WHERE status_code <> 200 OR status_code IS NULL) AS non_200,
  {pct('count(*) FILTER (WHERE status_code <> 200 OR status_code IS NULL)', 'count(*)')} AS pct_non_200 FROM domains""",
    ),
    "email_format_distribution": statement(
        EMAILS,
        f"""SELECT format_status, count(*) AS email_rows, {pct('count(*)', '(SELECT count(*) FROM emails)')} AS pct
FROM (SELECT {FORMAT} AS format_status FROM cleaned) GROUP BY format_status""",
        cleaned=CLEANED,
    ),
    "invalid_email_examples": statement(
        EMAILS,
        f"""SELECT id, country, email, email_clean FROM cleaned WHERE {filled('email')} AND NOT {valid('email_clean')}
ORDER BY email_clean, id NULLS LAST, country NULLS LAST, email LIMIT 20""",
        cleaned=CLEANED,
    ),
    "company_valid_format": statement(
        EMAILS,
        f"""SELECT count(*) AS companies_with_any_email, count(*) FILTER (WHERE good) AS companies_with_valid_email,
  {pct('count(*) FILTER (WHERE good)', 'count(*)')} AS pct_companies_with_valid_email
FROM (SELECT id, bool_or({valid('email_clean')}) AS good FROM cleaned WHERE {filled('email')} GROUP BY id)""",
        cleaned=CLEANED,
    ),
    "duplicate_summary": statement(
        EMAILS,
        f"""SELECT count(*) AS total_email, count(*) FILTER (WHERE n = 1) AS unique_email, count(*) FILTER (WHERE n > 1) AS duplicate_email,
  {pct('count(*) FILTER (WHERE n > 1)', 'count(*)')} AS duplicate_percentage
FROM (SELECT count(*) AS n FROM good GROUP BY id, country, email_clean)""",
        cleaned=CLEANED,
        good=VALID_ROWS,
    ),
    "unique_duplicate_count": statement(
        EMAILS,
        "SELECT count(*) AS unique_duplicate_emails FROM occurrences WHERE occurrences > 1",
        cleaned=CLEANED,
        good=VALID_ROWS,
        occurrences=OCCURRENCES,
    ),
    "duplicate_top": statement(
        EMAILS,
        "SELECT * FROM occurrences WHERE occurrences > 1 ORDER BY occurrences DESC, email_clean LIMIT 20",
        cleaned=CLEANED,
        good=VALID_ROWS,
        occurrences=OCCURRENCES,
    ),
    "duplicate_buckets": statement(
        EMAILS,
        f"""SELECT occ_bucket, count(DISTINCT email_clean) AS duplicate_email_count, count(DISTINCT id) AS companies_in_bucket,
  {pct('count(DISTINCT id)', '(SELECT count(DISTINCT id) FROM good)')} AS pct_of_companies
FROM (SELECT id, email_clean, {BUCKET.format(n='occurrences')} AS occ_bucket FROM good JOIN occurrences USING (email_clean)
  WHERE occurrences > 1) GROUP BY occ_bucket""",
        cleaned=CLEANED,
        good=VALID_ROWS,
        occurrences=OCCURRENCES,
    ),
    "domain_match_by_country": statement(HUB_EMAILS, BY_COUNTRY, **matching()),
    "domain_match_by_country_lower_first": statement(HUB_EMAILS, BY_COUNTRY, **matching(lower_first=True)),
    "domain_match_rollup": statement(
        HUB_EMAILS, f"SELECT 'ALL' AS country, {MATCHING} FROM status UNION ALL {BY_COUNTRY}", **matching()
    ),
    "domain_match_company_review": statement(
        HUB_EMAILS,
        """SELECT l.id, l.name, l.company_domain, l.total_emails, c.good AS valid_emails, c.bad AS invalid_emails,
  (SELECT string_agg(e.email, ', ' ORDER BY e.email) FROM evaluated e WHERE e.fits AND e.id = l.id
    AND e.name IS NOT DISTINCT FROM l.name AND e.company_domain = l.company_domain) AS valid_emails_list,
  (SELECT string_agg(e.email, ', ' ORDER BY e.email) FROM evaluated e WHERE NOT e.fits AND e.id = l.id
    AND e.name IS NOT DISTINCT FROM l.name AND e.company_domain = l.company_domain) AS invalid_emails_list,
  CASE WHEN c.good > 0 THEN 'VALID' ELSE 'INVALID' END AS company_email_status, cast(0 AS bigint) AS list_part
FROM largest l JOIN (SELECT id, count(*) FILTER (WHERE fits) AS good, count(*) FILTER (WHERE NOT fits) AS bad
  FROM evaluated GROUP BY id) c USING (id)""",
        company=company(),
        address=address(),
        evaluated=EVALUATED,
        largest=LARGEST,
    ),
    "domain_match_review_addresses": statement(
        HUB_EMAILS,
        """SELECT e.id, e.name, e.company_domain, e.email, e.fits AS is_valid_email, count(*) AS copies
FROM evaluated e JOIN largest l ON l.id = e.id AND l.name IS NOT DISTINCT FROM e.name AND l.company_domain = e.company_domain
GROUP BY ALL""",
        company=company(),
        address=address(),
        evaluated=EVALUATED,
        largest=LARGEST,
    ),
    "domain_match_emails": statement(
        DOMAINS_EMAILS,
        f"""SELECT count(*) AS total_valid_emails, count(*) FILTER (WHERE {related('email_domain', 'company_domain')}) AS domain_match_emails,
  {pct(f"count(*) FILTER (WHERE {related('email_domain', 'company_domain')})", 'count(*)')} AS pct_domain_match
FROM (SELECT split_part(g.email_clean, '@', 2) AS email_domain, w.company_domain FROM good g
  JOIN (SELECT id, lower(regexp_replace(trim(coalesce(website, '')), '^www\\.', '')) AS company_domain FROM domains) w ON w.id = g.id
  WHERE trim(w.company_domain) <> '')""",
        cleaned=CLEANED,
        good=VALID_ROWS,
    ),
    "domain_root_match": statement(
        DOMAINS_EMAILS,
        f"""SELECT {pct("count(*) FILTER (WHERE company_root <> '' AND company_root = email_root)", 'count(*)')} AS match_pct FROM roots""",
        roots=ROOTS,
    ),
    "domain_root_mismatch_pct": statement(
        DOMAINS_EMAILS,
        f"""SELECT round(100 - {pct("count(*) FILTER (WHERE company_root <> '' AND company_root = email_root)", 'count(*)')}, 2) AS mismatch_pct FROM roots""",
        roots=ROOTS,
    ),
    "domain_mismatch_examples": statement(
        DOMAINS_EMAILS,
        """SELECT id, country, status_code, fqdn, email, company_root, email_root FROM roots
WHERE company_root <> '' AND email_root <> '' AND company_root <> email_root
ORDER BY id, fqdn, country NULLS LAST, status_code NULLS LAST, email LIMIT 20""",
        roots=ROOTS,
    ),
    "domain_mismatch_pct": statement(
        HUB_EMAILS,
        "SELECT mismatch_pct, mismatch_pct_exact FROM mismatched",
        **matching(),
        by_country=BY_COUNTRY,
        mismatched=MISMATCH,
    ),
    "blocked_summary": statement(
        EMAILS,
        f"""SELECT count(*) AS total_valid_emails, count(*) FILTER (WHERE {blocked('email_clean')}) AS blocked_emails,
  {pct(f"count(*) FILTER (WHERE {blocked('email_clean')})", 'count(*)')} AS pct_blocked FROM good""",
        cleaned=CLEANED,
        good=VALID_ROWS,
    ),
    "blocked_examples": statement(
        EMAILS,
        f"""SELECT id, country, email, email_clean FROM good WHERE {blocked('email_clean')}
ORDER BY email_clean, id NULLS LAST, country NULLS LAST, email LIMIT 20""",
        cleaned=CLEANED,
        good=VALID_ROWS,
    ),
    "deliverability_distribution": statement(
        EMAILS,
        f"""SELECT {label('verification_status', 'NULL')} AS verification_status, count(*) AS row_count,
  {pct('count(*)', '(SELECT count(*) FROM emails)')} AS pct FROM emails GROUP BY 1""",
    ),
    "deliverability_distribution_blank_kept": statement(
        EMAILS,
        f"""SELECT coalesce(verification_status, 'NULL') AS verification_status, count(*) AS row_count,
  {pct('count(*)', '(SELECT count(*) FROM emails)')} AS pct FROM emails GROUP BY 1""",
    ),
    "email_volume_by_country": statement(EMAILS, VOLUME, pairs=PAIRS),
    "email_volume_worst_country": statement(
        EMAILS, "SELECT * FROM volume ORDER BY pct_companies_gt5_emails DESC, country LIMIT 1", pairs=PAIRS, volume=VOLUME
    ),
    "email_volume_worst_country_by_count": statement(
        EMAILS,
        "SELECT * FROM volume ORDER BY companies_gt5_emails DESC, pct_companies_gt5_emails DESC, country LIMIT 1",
        pairs=PAIRS,
        volume=VOLUME,
    ),
    "email_volume_examples": statement(
        EMAILS,
        """SELECT id, country, email_count FROM pairs WHERE email_count > 5
  AND country = (SELECT country FROM volume ORDER BY pct_companies_gt5_emails DESC, country LIMIT 1)
ORDER BY email_count DESC, id LIMIT 20""",
        pairs=PAIRS,
        volume=VOLUME,
    ),
    "priority_top_emails": ranking(50),
    "priority_top_emails_all": ranking(None),
    "priority_top_emails_deduped": ranking(50, dedupe=True),
    "metric_frame": metrics_sql(),
    "release_metrics": metrics_sql(),
    "release_volumes": statement(
        ["persona_hub", "emails", "domains"],
        f"""SELECT 'release-1' AS run_id, metric_key, metric_label, cast(n AS double) AS value_num, cast(NULL AS double) AS value_pct, 'info' AS severity
FROM (SELECT 'companies_num' AS metric_key, 'Volume: companies' AS metric_label, (SELECT count(DISTINCT id) FROM persona_hub) AS n
  UNION ALL SELECT 'emails_num', 'Volume: emails', (SELECT count(*) FROM emails WHERE {filled('email')})
  UNION ALL SELECT 'valid_emails_num', 'Volume: emails of valid format', (SELECT count(*) FROM emails WHERE {valid(CLEAN)})
  UNION ALL SELECT 'domains_num', 'Volume: domain rows', (SELECT count(*) FROM domains))""",
    ),
    "with_severity": statement(["dq_metrics"], GRADED),
    "breaches": statement(["dq_metrics"], BREACHED, graded=GRADED),
    "action_items": statement(
        ["dq_metrics"],
        f"SELECT run_id, metric_key, metric_label, value_pct, {action_text(ALL_OTHER_RULES)} AS action_item FROM breached",
        graded=GRADED,
        breached=BREACHED,
    ),
    "action_items_metric": statement(
        ["dq_metrics"],
        f"""SELECT run_id, 'action_items' AS metric_key, 'Auto-generated action items' AS metric_label, cast(NULL AS double) AS value_pct,
  'info' AS severity, '{{"items":[' || string_agg('"' || {action_text(ACTION_RULES)} || '"', ',' ORDER BY metric_key) || ']}}' AS details_json
FROM breached GROUP BY run_id""",
        graded=GRADED,
        breached=BREACHED,
    ),
    "composite_score": statement(["dq_metrics"], COMPOSITE, points=POINTS),
    "upsert_metrics": statement(
        ["dq_metrics"],
        """SELECT run_id, metric_key, CASE WHEN metric_key = 'invalid_format_pct' THEN value_pct / 2 ELSE value_pct END AS value_pct
FROM dq_metrics UNION ALL SELECT run_id, 'composite_score', composite_score FROM composite WHERE composite_score IS NOT NULL""",
        points=POINTS,
        composite=COMPOSITE,
    ),
    "release_trend": statement(
        ["dq_runs", "dq_metrics"],
        """SELECT r.run_id AS run_ts, coalesce(r.release_label, strftime(r.run_id, '%Y-%m-%d')) AS release_label, c.composite_score
FROM dq_runs r JOIN composite c USING (run_id) WHERE c.composite_score IS NOT NULL""",
        points=POINTS,
        composite=COMPOSITE,
    ),
    "release_volume_change": statement(
        ["dq_runs", "dq_metrics"],
        """SELECT metric_key, run_id AS run_ts, value_pct AS value_num, lag(value_pct) OVER w AS prev_num,
  value_pct - lag(value_pct) OVER w AS change, round(100 * (value_pct - lag(value_pct) OVER w) / nullif(lag(value_pct) OVER w, 0), 6) AS change_pct
FROM dq_runs JOIN dq_metrics USING (run_id) WHERE value_pct IS NOT NULL WINDOW w AS (PARTITION BY metric_key ORDER BY run_id)""",
    ),
    "release_change": statement(
        ["dq_runs", "dq_metrics"],
        """SELECT metric_key, run_id AS run_ts, value_pct, lag(value_pct) OVER w AS prev_pct,
  round(value_pct - lag(value_pct) OVER w, 6) AS change
FROM dq_runs JOIN dq_metrics USING (run_id) WINDOW w AS (PARTITION BY metric_key ORDER BY run_id)""",
    ),
}


def _row_function(view: str, keys: str, **columns: str) -> str:
    listed = ", ".join(f"{text} AS {name}" for name, text in columns.items())
    return statement([view], f"SELECT {keys}, {listed} FROM {view}")


ROW_FUNCTIONS: dict[str, str] = {
    "non_blank": _row_function("emails", "email_id", present=f"coalesce({filled('email')}, false)"),
    "email_clean": _row_function("emails", "email_id", email_clean=CLEAN),
    "is_valid_email": _row_function("emails", "email_id", valid=valid(CLEAN)),
    "format_status": statement(EMAILS, f"SELECT email_id, {FORMAT} AS format_status FROM cleaned", cleaned=CLEANED),
    "is_blocked": _row_function("emails", "email_id", blocked=blocked(CLEAN)),
    "local_part_and_domain": _row_function(
        "emails",
        "email_id",
        local_part="lower(trim(split_part(email, '@', 1)))",
        email_domain="lower(trim(split_part(email, '@', 2)))",
        raw_email_domain="lower(split_part(email, '@', 2))",
    ),
    "normalize_domain": _row_function("persona_hub", "id", company_domain=host("fqdn")),
    "website_domain": _row_function(
        "domains", "id, fqdn", website_domain=r"lower(regexp_replace(trim(coalesce(website, '')), '^www\.', ''))"
    ),
    "domain_root": _row_function("persona_hub", "id", company_root=f"split_part({host('fqdn')}, '.', 1)"),
    "alnum_clean": _row_function(
        "persona_hub",
        "id",
        name_clean=alnum("coalesce(name, '')"),
        name_clean_lower_first=alnum("lower(coalesce(name, ''))"),
    ),
    "domain_related": _row_function(
        "domains",
        "id, fqdn",
        related=related(host("fqdn"), r"lower(regexp_replace(trim(coalesce(website, '')), '^www\.', ''))"),
    ),
    "six_clause_match": statement(
        HUB_EMAILS,
        f"SELECT email_id, {SIX_CLAUSES} AS matched FROM address a JOIN company c ON c.id = a.id",
        company=company().split(" WHERE ")[0],
        address=address().replace(" AND contains(email, '@')", "").replace(f"WHERE {filled('email')}", "WHERE TRUE"),
    ),
    "country_key": _row_function("emails", "email_id", country=label("country", "UNKNOWN")),
    "status_label": _row_function("emails", "email_id", status=label("verification_status", "NULL")),
    "occurrence_bucket": statement(
        EMAILS, f"SELECT email, {BUCKET.format(n='count(*)')} AS occ_bucket FROM emails GROUP BY email"
    ),
    "role_score": _row_function("emails", "email_id", role_score=role("lower(split_part(email, '@', 1))")),
    "pct": statement(
        EMAILS, f"SELECT id, {pct('count(*) FILTER (WHERE email IS NULL)', 'count(*)')} AS pct_null FROM emails GROUP BY id"
    ),
}

ORACLE: dict[str, str] = {**OPERATORS, **ROW_FUNCTIONS}

# The checks that follow from carried counts: a recount of all rows of the later release.
CARRIED = [
    "email_format_distribution", "invalid_email_examples", "company_valid_format", "duplicate_summary", "unique_duplicate_count",
    "duplicate_top", "duplicate_buckets", "blocked_summary", "deliverability_distribution", "email_volume_by_country",
    "coverage_overall", "coverage_by_source", "coverage_published_by_source", "coverage_published_total", "coverage_domain_universe",
]
ORACLE |= {f"carried_{check}": later(ORACLE[check]) for check in CARRIED}

_VENDOR = f"""SELECT '{RUN_ID}' AS run_id, 'vendor_without_email_pct:' || vendor AS metric_key,
  'Coverage: % companies without email, vendor ' || vendor AS metric_label, cast(companies AS double) AS value_num, {pct('lacking', 'mailed + lacking')} AS value_pct,
  CASE WHEN {pct('lacking', 'mailed + lacking')} >= {VENDOR_THRESHOLD} THEN 'breach' ELSE 'ok' END AS severity, cast(NULL AS string) AS details_json
FROM (SELECT coalesce(nullif(trim(source), ''), '(none)') AS vendor, cast(sum(total_companies) AS bigint) AS companies,
    cast(sum(companies_with_email) AS bigint) AS mailed, cast(sum(companies_without_email) AS bigint) AS lacking
  FROM ({ORACLE['coverage_by_source']}) v GROUP BY 1) w"""
ORACLE["release_report"] = f"""SELECT run_id, metric_key, metric_label, cast(NULL AS double) AS value_num, value_pct, severity, details_json
FROM ({ORACLE['release_metrics']}) m
UNION ALL SELECT run_id, metric_key, metric_label, value_num, value_pct, severity, cast(NULL AS string) FROM ({ORACLE['release_volumes']}) n
UNION ALL {_VENDOR}"""

ORACLE["latest_release_change"] = f"""SELECT * FROM ({ORACLE['release_change']}) c WHERE run_ts = (SELECT max(cast(ts AS date)) FROM events)"""
