"""Does a company's e-mail domain fit its own domain?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (
    alnum_clean,
    cents,
    domain_root,
    dotted_suffixes,
    email_domain,
    local_part,
    non_blank,
    normalize_domain,
    pct,
    ratio2,
    row_count,
    six_clause_match,
    website_domain,
)
from ..plans import hot_keys_of, salted_join
from ..schemas import require
from .formats import CLEAN, valid_emails


# --- six-clause rule: hub domain, root and name against the whole address ---------------------------


def usable_companies(hub: DataFrame, lower_first: bool, *extra: str) -> DataFrame:
    """The hub rows with a usable domain; equal rows are folded into one with `copies`."""
    require(hub, ["id", "name", "fqdn"], "hub")
    usable = hub.where(F.col("id").isNotNull() & non_blank(F.col("fqdn")) & F.col("fqdn").contains("."))
    return (
        usable.select(
            "id",
            *extra,
            normalize_domain(F.col("fqdn")).alias("company_domain"),
            alnum_clean(F.col("name"), lower_first).alias("name_clean"),
        )
        .groupBy("id", *extra, "company_domain", "name_clean")
        .agg(row_count().alias("copies"))
    )


def usable_addresses(emails: DataFrame, lower_first: bool, *extra: str) -> DataFrame:
    require(emails, ["id", "email", *extra], "emails")
    email = F.col("email")
    usable = emails.where(F.col("id").isNotNull() & non_blank(email) & email.contains("@"))
    return usable.select(
        "id",
        *extra,
        F.lower(F.trim(email)).alias("email"),
        local_part(email).alias("local_part"),
        email_domain(email).alias("email_domain"),
        alnum_clean(F.split_part(email, F.lit("@"), F.lit(1)), lower_first).alias("local_clean"),
    )


def fits() -> Column:
    return six_clause_match(
        F.col("email_domain"),
        F.col("local_part"),
        F.col("local_clean"),
        F.col("company_domain"),
        domain_root(F.col("company_domain")),
        F.col("name_clean"),
    )


def _pieces(text: str, lengths: str) -> str:
    """SQL for all pieces of the column `text` that have one of the `lengths`."""
    piece = f"transform(sequence(1, length({text}) - n + 1), i -> substring({text}, i, n))"
    return f"flatten(transform(filter({lengths}, n -> n <= length({text})), n -> {piece}))"


# A company has two 64-bit words for each spelling, in filters of at most so many words.
_WORDS = 4096
# The word of a token among its company's, and the three bits that it sets there, from the token's hash h.
_PLACE = "({h} & (words - 1))"
_MARK = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({{h}}, {n}) & 63 AS int))" for n in (46, 52, 58))


def _tagged(**kinds: str) -> list[str]:
    """SQL for arrays of (kind, token, hash) structs, one for each array of text."""
    return [f"transform({texts}, t -> struct('{kind}' AS kind, t AS token, xxhash64('{kind}', t) AS h))" for kind, texts in kinds.items()]


def _wanted(companies: DataFrame) -> DataFrame:
    """Spellings, with all their columns, once per (kind, token, h) of which an address needs one to fit.

    Each clause becomes equality of a token: a dotted suffix for related domains, a piece of the address as
    long as some root or name of the company for the others.
    """
    spelled = companies.select(
        "*",
        F.nullif(domain_root(F.col("company_domain")), F.lit("")).alias("root"),
        F.when(F.length("name_clean") >= 4, F.col("name_clean")).alias("long_name"),
        dotted_suffixes(F.col("company_domain"), proper=True).alias("parents"),
    )
    tokens = _tagged(
        name="array(company_domain)",
        below="parents",
        root="array_compact(array(root))",
        local="array_compact(array(long_name))",
    )
    return spelled.select(*companies.columns, F.expr(f"inline(array_distinct(concat({', '.join(tokens)})))"))


def _sought(spelled: DataFrame) -> DataFrame:
    """What the addresses of a company need to find their tokens: a Bloom filter of the tokens of its spellings, sized by
    their number, and the lengths of roots and names. (id, words, part, bits, root_lengths, name_lengths)

    A token sets three bits of one word, and a word serves half a spelling, so about one piece in three hundred passes
    by chance however many spellings there are. A filter of more than 4,096 words is cut into parts, each a row that
    knows the lengths of its own tokens only, so that no row grows with the company.
    """
    sized = spelled.groupBy("id").agg(F.expr("shiftleft(2L, cast(ceil(log2(count(1))) AS int))").alias("words"))
    tokens = _wanted(spelled.select("id", "company_domain", "name_clean").join(sized, "id"))

    def length(kind: str) -> Column:
        return F.when(F.col("kind") == kind, F.length("token"))

    marks = tokens.select(
        "id", "words", F.expr(_PLACE.format(h="h")).alias("place"), F.expr(_MARK.format(h="h")).alias("mark"),
        length("root").alias("root_length"), length("local").alias("name_length"),
    )
    # Every word has a row, so that the sorted words of a part are in their places.
    none = F.lit(None).cast("int")
    parts = sized.select("id", "words", F.explode(F.sequence(F.lit(0), F.expr(f"(words - 1) div {_WORDS}"))).alias("part"))
    first = F.col("part") * _WORDS
    places = F.sequence(first, first + F.least("words", F.lit(_WORDS)) - 1)
    empty = parts.select("id", "words", F.explode(places), F.lit(0).cast("bigint"), none, none)
    words = marks.union(empty).groupBy("id", "words", "place").agg(
        F.bit_or("mark").alias("word"), F.collect_set("root_length").alias("roots"), F.collect_set("name_length").alias("names")
    )
    return words.groupBy("id", "words", F.expr(f"place div {_WORDS}").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("place", "word")))["word"].alias("bits"),
        F.array_distinct(F.flatten(F.collect_list("roots"))).alias("root_lengths"),
        F.array_distinct(F.flatten(F.collect_list("names"))).alias("name_lengths"),
    )


def _offered(with_sought: DataFrame, *columns: str) -> DataFrame:
    """The columns once per (kind, token) of an address that its company may want; with NULL where there is none.

    Tokens are thinned before they are made distinct, as the latter compares each with each.
    """
    pieces = f"concat({_pieces('email_domain', 'root_lengths')}, {_pieces('local_part', 'root_lengths')})"
    tokens = _tagged(
        name="suffixes", below="array(email_domain)", root=pieces, local=_pieces("local_clean", "name_lengths")
    )
    place, mark = _PLACE.format(h="t.h"), _MARK.format(h="t.h")
    passes = f"{place} div {_WORDS} = part AND (bits[cast({place} % {_WORDS} AS int)] & ({mark})) = ({mark})"
    thinned = ", ".join(f"filter({texts}, t -> {passes})" for texts in tokens)
    suffixed = with_sought.withColumn("suffixes", dotted_suffixes(F.col("email_domain")))
    return suffixed.select(*columns, F.expr(f"inline_outer(array_distinct(concat({thinned})))")).drop("h")


def _numbered(spelled: DataFrame, bits: int) -> DataFrame:
    """Spellings with a place in bitmaps: (plane, chunk, bit), once for each binary digit of `copies` that is set.

    Within a company and plane the spellings are dealt to chunks by hash and numbered there, so no task orders all
    spellings of a company; a chunk that runs over goes on in another.
    """
    chunks = spelled.groupBy("id").agg(F.ceil(row_count() * 2 / bits).alias("chunks"))
    planes = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda p: F.getbit("copies", p) == 1)
    each = spelled.join(chunks, "id").withColumn("plane", F.explode(planes))
    dealt = each.withColumn("chunk", F.pmod(F.xxhash64("company_domain", "name_clean"), F.col("chunks")))
    place = F.row_number().over(Window.partitionBy("id", "plane", "chunk").orderBy("company_domain", "name_clean")) - 1
    placed = dealt.withColumn("place", place)
    over = F.call_function("div", F.col("place"), F.lit(bits)) * F.col("chunks")
    return placed.withColumn("chunk", F.col("chunk") + over).withColumn("bit", (F.col("place") % bits).cast("bigint"))


def fitting_pairs(companies: DataFrame, addresses: DataFrame, bits: int = 32768) -> DataFrame:
    """(id, fitting): how many pairs of a hub row and an e-mail row of these companies fit.

    Both sides are folded, with `copies` and `written`. No pair is built: each token has a bitmap of the spellings that
    want it, an address joins the bitmaps of its tokens into one, and the set bits are its fitting spellings. Bitmaps
    are kept by binary digit of `copies`, so that a bit in plane p counts for 2^p hub rows; they have at most `bits`
    (up to 32,768, as Spark's bitmaps hold) and go on in further chunks. Addresses of hot companies meet the bitmaps in
    splits.
    """
    spelling, address = ["company_domain", "name_clean"], ["local_part", "email_domain", "local_clean"]
    spelled = companies.groupBy("id", *spelling).agg(F.sum("copies").alias("copies"))
    listed = addresses.groupBy("id", *address).agg(F.sum("written").alias("written"))
    wanted = _wanted(_numbered(spelled, bits))
    bitmaps = wanted.groupBy("id", "kind", "token", "plane", "chunk").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    hot = hot_keys_of(listed, "id")
    joined = salted_join(listed, _sought(spelled), "id", hot, [F.col(c) for c in address])
    offered = _offered(joined, *listed.columns)
    hits = salted_join(offered.where("token IS NOT NULL"), bitmaps, "id", hot, [F.col(c) for c in address], also=["kind", "token"])
    met = hits.groupBy("id", *address, "written", "plane", "chunk").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("fit"))
    worth = F.expr("shiftleft(1L, plane)") * F.col("fit") * F.col("written")
    return met.groupBy("id").agg(F.sum(worth).alias("fitting"))


def _status_per_company_country(hub: DataFrame, emails: DataFrame, lower_first: bool) -> DataFrame:
    """(id, country, has_match): does any address of the company in that country fit?

    All companies are matched alike, by equal tokens of their spellings and their distinct addresses. So the work
    follows the number of spellings plus the number of addresses, never their product. Addresses of hot companies
    meet their company in splits; after that, no key has more rows than there are countries.
    """
    address = ["id", "country", "local_part", "email_domain", "local_clean"]
    listed = usable_addresses(emails, lower_first, "country").select(*address).distinct()
    spelled = usable_companies(hub, lower_first)
    wanted = _wanted(spelled).select("id", "kind", "token").distinct()
    hot = hot_keys_of(emails, "id")
    joined = salted_join(listed, _sought(spelled), "id", hot, [F.col(c) for c in address[1:]])
    offered = _offered(joined, "id", "country").distinct()
    met = offered.join(wanted.withColumn("met", F.lit(True)), ["id", "kind", "token"], "left")
    return met.groupBy("id", "country").agg(F.bool_or(F.coalesce("met", F.lit(False))).alias("has_match"))


def _match_columns(total: Column, fitting: Column) -> list[Column]:
    return [
        total.alias("total_companies"),
        fitting.alias("companies_valid"),
        pct(fitting, total).alias("pct_companies_valid"),
        (total - fitting).alias("companies_invalid"),
        pct(total - fitting, total).alias("pct_companies_invalid"),
    ]


def domain_match_by_country(hub: DataFrame, emails: DataFrame, lower_first: bool = False) -> DataFrame:
    """Companies per country with at least one address that passes the six-clause rule."""
    status = _status_per_company_country(hub, emails, lower_first)
    by_country = status.groupBy("country").agg(*_match_columns(row_count(), F.count_if("has_match")))
    return by_country.orderBy(F.desc("total_companies"), F.asc_nulls_last("country"))


def domain_match_rollup(hub: DataFrame, emails: DataFrame, lower_first: bool = False) -> DataFrame:
    """`domain_match_by_country` with a grand total row ALL first."""
    status = _status_per_company_country(hub, emails, lower_first)
    by_country = status.groupBy("country").agg(row_count().alias("n"), F.count_if("has_match").alias("fit"))
    whole = F.grouping("country").cast("int").alias("whole")
    rolled = by_country.rollup("country").agg(whole, F.sum("n").alias("n"), F.sum("fit").alias("fit"))
    # The grand total of an empty input is a row of zeros.
    zero = F.lit(0).cast("bigint")
    empty = hub.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("country"), F.lit(1).alias("whole"), zero.alias("n"), zero.alias("fit")
    )
    rows = rolled.unionByName(empty).groupBy("whole", "country").agg(F.sum("n").alias("n"), F.sum("fit").alias("fit"))
    order = [F.desc("whole"), F.desc("total_companies"), F.asc_nulls_last("country")]
    named = F.when(F.col("whole") == 1, "ALL").otherwise(F.col("country")).alias("country")
    return rows.select("whole", named, *_match_columns(F.col("n"), F.col("fit"))).orderBy(*order).drop("whole")


def domain_mismatch_pct(by_country: DataFrame) -> DataFrame:
    """100 minus the company-weighted mean of the rounded rates, and the same from exact counts."""
    require(by_country, ["total_companies", "companies_invalid", "pct_companies_valid"], "match by country")
    n = F.col("total_companies")
    sums = by_country.agg(
        F.sum(n).alias("n"),
        F.sum(cents(F.col("pct_companies_valid")) * n).alias("weighted"),
        F.sum("companies_invalid").alias("invalid"),
    )
    return sums.select(
        ratio2(10000 * F.col("n") - F.col("weighted"), 100 * F.col("n")).alias("mismatch_pct"),
        pct(F.col("invalid"), F.col("n")).alias("mismatch_pct_exact"),
    )


# --- address level: website domain, exact or subdomain ----------------------------------------------


def domain_match_emails(domains: DataFrame, emails: DataFrame) -> DataFrame:
    """Valid addresses times the website domains of their company, and how many of those pairs are related.

    Pairs are counted, not built: per (company, name) the address and domain counts multiply. A subdomain
    shares a dotted suffix with its parent, so both directions are equality on a suffix.
    """
    require(domains, ["id", "website"], "domains")
    company = (
        domains.where(F.col("id").isNotNull() & non_blank(F.col("website")))
        .select("id", website_domain(F.col("website")).alias("name"))
        .where(F.trim("name") != "")
    )
    address = valid_emails(emails, "id").where(F.col("id").isNotNull()).select(
        "id", F.split_part(CLEAN, F.lit("@"), F.lit(2)).alias("name")
    )
    company_side = _suffix_counts(company, "c")
    address_side = _suffix_counts(address, "a")
    per_name = company_side.unionByName(address_side, allowMissingColumns=True).groupBy("id", "name").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("c_own", "c_under", "a_own", "a_under")]
    )
    # `own` counts the name itself, `under` its proper subdomains.
    related = _pairs(F.col("a_own") + F.col("a_under"), F.col("c_own")) + _pairs(F.col("a_own"), F.col("c_under"))
    per_id = per_name.groupBy("id").agg(
        _pairs(F.sum("a_own"), F.sum("c_own")).alias("pairs"), F.sum(related).alias("related")
    )
    total, match = F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("related"), F.lit(0))
    return per_id.agg(
        total.cast("bigint").alias("total_valid_emails"),
        match.cast("bigint").alias("domain_match_emails"),
        pct(match, total).alias("pct_domain_match"),
    )


def _pairs(a: Column, b: Column) -> Column:
    """A product of counts, which a bigint may not hold."""
    return a.cast("decimal(19,0)") * b.cast("decimal(18,0)")


def _suffix_counts(names: DataFrame, side: str) -> DataFrame:
    """(id, name, <side>_own, <side>_under): rows of exactly this name, and of names below it."""
    counted = names.groupBy("id", "name").agg(row_count().alias("rows"))
    expanded = counted.select("id", "rows", F.posexplode(dotted_suffixes(F.col("name"))).alias("depth", "name"))
    own = F.col("depth") == 0
    return expanded.select(
        "id",
        "name",
        F.when(own, F.col("rows")).otherwise(0).alias(f"{side}_own"),
        F.when(own, 0).otherwise(F.col("rows")).alias(f"{side}_under"),
    )


# --- first label of the fqdn against the first label of the e-mail domain ---------------------------


def _roots(domains: DataFrame, emails: DataFrame) -> tuple[DataFrame, DataFrame]:
    require(domains, ["id", "fqdn"], "domains")
    require(emails, ["id", "email"], "emails")
    company = domains.where(F.col("id").isNotNull()).withColumn("fqdn", F.lower(F.trim("fqdn")))
    company = company.where((F.col("fqdn") != "") & F.col("fqdn").contains("."))
    address = emails.where(F.col("id").isNotNull()).select("id", F.lower(F.trim("email")).alias("email"))
    address = address.where((F.col("email") != "") & F.col("email").contains("@"))
    return (
        company.withColumn("company_root", domain_root(F.col("fqdn"))),
        address.withColumn("email_root", domain_root(F.split_part("email", F.lit("@"), F.lit(2)))),
    )


def domain_root_match(domains: DataFrame, emails: DataFrame) -> DataFrame:
    """Share of (domain, address) pairs of a company whose first labels agree; pairs are counted, not built."""
    company, address = _roots(domains, emails)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sides = company.select("id", F.col("company_root").alias("root"), one.alias("c"), zero.alias("a")).unionByName(
        address.select("id", F.col("email_root").alias("root"), zero.alias("c"), one.alias("a"))
    )
    per_root = sides.groupBy("id", "root").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))
    per_id = per_root.groupBy("id").agg(
        _pairs(F.sum("c"), F.sum("a")).alias("pairs"),
        F.sum(F.when(F.col("root") != "", _pairs(F.col("c"), F.col("a"))).otherwise(0)).alias("same"),
    )
    return per_id.agg(pct(F.sum("same"), F.sum("pairs")).alias("match_pct"))


def domain_root_mismatch_pct(domains: DataFrame, emails: DataFrame) -> DataFrame:
    """100 minus `domain_root_match`, the mismatch by the rule of first labels; NULL where there is no pair."""
    return domain_root_match(domains, emails).select(((10000 - cents(F.col("match_pct"))) / 100).alias("mismatch_pct"))


def _first_beside_any_root(rows: DataFrame, root: str, order: str, n: int) -> DataFrame:
    """At most 2n rows per id, among them the first n that do not have some one root, whichever it is.

    A root has at most n of the rows kept by the first cut, so 2n of them hold n of other roots.
    """
    in_root = Window.partitionBy("id", root).orderBy(F.asc_nulls_last(order))
    in_id = Window.partitionBy("id").orderBy(F.asc_nulls_last(order), root)
    few = rows.withColumn("nth", F.row_number().over(in_root)).where(F.col("nth") <= n)
    return few.withColumn("nth", F.row_number().over(in_id)).where(F.col("nth") <= 2 * n).drop("nth")


def _by_company() -> list[Column]:
    return [F.col("id"), *[F.asc_nulls_last(c) for c in ("fqdn", "country", "status_code")]]


def mismatch_pairs(domains: DataFrame, emails: DataFrame, n: int) -> DataFrame:
    """At most 2n^2 pairs of a company's domain and address with different, non-empty first labels, among them the
    first n of all.

    The extreme roots of each side tell which companies have such a pair and which domains have a partner. Every
    domain that has one starts at least one pair, so the first n of them suffice; each needs its first n addresses
    of another root.
    """
    require(domains, ["country", "status_code"], "domains")
    company, address = _roots(domains, emails)
    company = company.where(F.col("company_root") != "").select("id", "country", "status_code", "fqdn", "company_root")
    address = address.where(F.col("email_root") != "")

    none = F.lit(None).cast("string")
    sides = company.select("id", F.col("company_root").alias("c"), none.alias("a")).unionByName(
        address.select("id", none.alias("c"), F.col("email_root").alias("a"))
    )
    extremes = sides.groupBy("id").agg(
        *[F.min(c).alias(f"min{c}") for c in ("c", "a")], *[F.max(c).alias(f"max{c}") for c in ("c", "a")]
    )
    both = F.col("minc").isNotNull() & F.col("mina").isNotNull()
    differ = F.least("minc", "mina") != F.greatest("maxc", "maxa")
    ids = F.broadcast(extremes.where(both & differ).select("id", "mina", "maxa").orderBy("id").limit(n))

    has_partner = (F.col("mina") != F.col("company_root")) | (F.col("maxa") != F.col("company_root"))
    partnered = company.join(ids, "id").where(has_partner).drop("mina", "maxa")
    few_domains = partnered.orderBy(*_by_company()).limit(n)
    few_emails = _first_beside_any_root(address.join(ids, "id", "left_semi"), "email_root", "email", n)
    return few_emails.join(F.broadcast(few_domains), "id").where(F.col("company_root") != F.col("email_root"))


def domain_mismatch_examples(domains: DataFrame, emails: DataFrame, n: int = 20) -> DataFrame:
    """The first n `mismatch_pairs` in id order, then by domain, country, status and address."""
    return (
        mismatch_pairs(domains, emails, n)
        .orderBy(*_by_company(), F.asc_nulls_last("email"))
        .limit(n)
        .select("id", "country", "status_code", "fqdn", "email", "company_root", "email_root")
    )
