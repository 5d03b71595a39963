"""Small tables with hot keys and awkward values: a third of the rows share one company or one address."""

from __future__ import annotations

import random


HOT = 1

ADDRESSES = [
    None, "", "  ", "\t", "***", "masked***", "a@@b.com", "x@y.z", "A.B@X.COM", " john doe@x.com ", "***@x.com", "a@b",
    "no-reply@x.com", "noreply.team@x.com", "DoNotReply@mail.brand.com", "do-not-reply@brand.com", "sales@brand.com",
    "Sales@Brand.com ", "sa*les@brand.com", "info.au@mail.brand.com", "contact@brand.com.au", "jane@other.org",
    "brand@gmail.com", "acmecorp@gmail.com", "a@b@brand.com", "@brand.com", "jane@", "no at sign", "x@a_b.com",
    "tab\there@x.com", "line\n@x.com", "back\\slash@x.com", "é@brand.com", "support@sub.mail.brand.com", "hello@com",
    "admin@co2.com", "enquiries@co3.org", "co3@outlook.com", "info@CO2.com", "sales1@co2.com", "salesforce@co3.org",
]
NAMES = [None, "", "anz", "acmecorp", "Acme Corp", "brand", "A_b", "co2", "x%y", "acme"]
FQDNS = [
    None, "", " ", "localhost", "brand.com", "https://www.brand.com/about", "HTTPS://WWW.Brand.com/p", " https://x.com",
    "www.co2.com", "co3.org/path/more", "http://mail.brand.com", "a_b.com", "axb.com", "com.", ".com", "x", "brand.com.au",
    "www.", "https://www./", "co2.com ", "x..com", "back\\slash.com",
]
WEBSITES = [None, "", " ", "www.brand.com", "WWW.brand.com", "brand.com ", "mail.brand.com", "com", "www.", "co2.com", "x..com"]
COUNTRIES = [None, "", " ", "AU", "NZ", " AU ", "UNKNOWN"]
STATUSES = [None, "", " ", "valid", "verified", "deliverable", "invalid", " valid ", "NULL"]
CODES = [None, 200, 200, 404, 301, 500]
SOURCES = [None, "", "vendor a", "vendor b"]


def tables(seed: int = 7, rows: int = 900) -> dict[str, list[tuple]]:
    rng = random.Random(seed)

    def company() -> int | None:
        return rng.choices([HOT, rng.randint(2, 30), None], [33, 60, 7])[0]

    def email() -> str | None:
        kind = rng.random()
        if kind < 0.33:
            return "shared@hot.example.com"
        if kind < 0.6:
            return f"user{rng.randint(1, 60)}@{rng.choice(['brand.com', 'gmail.com', 'co2.com', 'mail.brand.com'])}"
        return rng.choice(ADDRESSES)

    emails = [
        (i, company(), f"slug-{rng.randint(1, 20)}" if rng.random() > 0.1 else None, rng.choice(COUNTRIES), email(), rng.choice(STATUSES))
        for i in range(rows)
    ]
    hub = [
        (
            rng.choices([HOT, rng.randint(2, 40), None], [20, 75, 5])[0],
            rng.choice(NAMES),
            rng.choice(SOURCES),
            rng.choice(FQDNS),
            rng.choice([None, "", *[f"slug-{k}" for k in range(1, 25)]]) if rng.random() > 0.3 else "slug-3",
            rng.choice(["PUBLISHED", "PUBLISHED", "DRAFT", None]),
        )
        for _ in range(rows // 6)
    ]
    domains = [
        (rng.choices([HOT, rng.randint(2, 40), None], [33, 60, 7])[0], rng.choice(COUNTRIES), rng.choice(FQDNS), rng.choice(WEBSITES), rng.choice(CODES))
        for _ in range(rows // 6)
    ]
    return {"emails": emails, "persona_hub": hub, "domains": domains}


DDL = {
    "emails": "email_id bigint, id bigint, slug string, country string, email string, verification_status string",
    "persona_hub": "id bigint, name string, source string, fqdn string, slug string, status string",
    "domains": "id bigint, country string, fqdn string, website string, status_code int",
}

