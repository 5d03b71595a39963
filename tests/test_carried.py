"""Counts that carry from release to release give what a recount of all rows gives."""

import random

import pytest
from pyspark.sql import functions as F

from dqspark import operators as op
from dqspark.operators import carried
from dqspark.sources import carry_counts, read_counts, write_counts

from .adversarial import DDL, tables

RECOUNT = {
    "email_format_distribution": lambda f: op.email_format_distribution(f["emails"]),
    "invalid_email_examples": lambda f: op.invalid_email_examples(f["emails"]),
    "company_valid_format": lambda f: op.company_valid_format(f["emails"]),
    "duplicate_summary": lambda f: op.duplicate_summary(f["emails"]),
    "unique_duplicate_count": lambda f: op.unique_duplicate_count(f["emails"]),
    "duplicate_top": lambda f: op.duplicate_top(f["emails"]),
    "duplicate_buckets": lambda f: op.duplicate_buckets(f["emails"]),
    "blocked_summary": lambda f: op.blocked_summary(f["emails"]),
    "deliverability_distribution": lambda f: op.deliverability_distribution(f["emails"]),
    "email_volume_by_country": lambda f: op.email_volume_by_country(f["emails"]),
    "coverage_overall": lambda f: op.coverage_overall(f["persona_hub"], f["emails"]),
    "coverage_by_source": lambda f: op.coverage_by_source(f["persona_hub"], f["emails"]),
    "coverage_published_by_source": lambda f: op.coverage_published_by_source(f["persona_hub"], f["emails"]),
    "coverage_published_total": lambda f: op.coverage_published_total(f["persona_hub"], f["emails"]),
    "coverage_domain_universe": lambda f: op.coverage_domain_universe(f["domains"], f["emails"]),
}
COUNT = {"emails": carried.email_counts, "persona_hub": carried.hub_counts, "domains": carried.domain_counts}


def frame(spark, name, rows):
    return spark.createDataFrame(rows, DDL[name])


def counts_of(spark, data):
    return {k: v for name, rows in data.items() for k, v in COUNT[name](frame(spark, name, rows)).items()}


def changes(spark, before, after):
    """Signed counts of the rows that only one of two releases has; a changed row is among both."""
    out = {}
    for name in before:
        added, removed = list(after[name]), []
        for row in before[name]:
            if row in added:
                added.remove(row)
            else:
                removed.append(row)
        out |= COUNT[name](carried.signed(frame(spark, name, added), frame(spark, name, removed)))
    return out


def next_release(data, seed):
    """Some rows go, some change, some come; one company loses its last e-mails and one vendor all its companies."""
    chance = random.Random(seed)
    fresh = tables(seed=seed, rows=200)
    out = {}
    for name, rows in data.items():
        kept = [r for r in rows if chance.random() > 0.25]
        if name == "emails":
            kept = [r for r in kept if r[1] != seed % 30 + 1]
            kept = [(*r[:5], chance.choice(["valid", None, "unknown"])) if chance.random() < 0.2 else r for r in kept]
        if name == "persona_hub":
            kept = [(*r[:2], "vendor b", *r[3:]) if r[2] == "vendor a" and seed % 2 else r for r in kept]
        out[name] = kept + fresh[name]
    return out


def same(a, b):
    """Equal results as multisets; ordered ones also in order."""
    left, right = [tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]
    assert a.columns == b.columns and sorted(map(repr, left)) == sorted(map(repr, right))


def test_state_and_change_equal_recount_over_three_releases(spark, tmp_path):
    root, data = str(tmp_path), tables(seed=21, rows=500)
    write_counts(counts_of(spark, data), root, "r0")
    for number in (1, 2, 3):
        later = next_release(data, 30 + number)
        counts = carry_counts(changes(spark, data, later), root, f"r{number - 1}", f"r{number}")
        data = later
        frames = {name: frame(spark, name, rows) for name, rows in data.items()}
        for name in carried.CHECKS if number == 3 else ("company_valid_format", "duplicate_buckets", "coverage_by_source", "coverage_published_total"):
            same(carried.carried_check(name, counts), RECOUNT[name](frames))
        recount = counts_of(spark, data)
        for name in carried.TABLES:
            same(counts[name].select(recount[name].columns), recount[name])
        assert carried.impossible_counts(counts).count() == 0


def test_every_check_has_its_recount():
    assert set(carried.CHECKS) == set(RECOUNT)


def test_a_company_loses_its_last_address(spark):
    emails = [(1, 1, "s", "AU", "a@b.com", None), (2, 1, "s", "AU", "bad", None), (3, 2, "t", "AU", " ", None)]
    hub = [(1, "n", "v", "b.com", "s", "PUBLISHED"), (2, "n", "v", "b.com", "t", "PUBLISHED")]
    counts = counts_of(spark, {"emails": emails, "persona_hub": hub})
    gone = carried.email_counts(carried.signed(removed=frame(spark, "emails", emails[:2])))
    after = carried.merge_counts(counts, gone)
    row = carried.carried_check("coverage_overall", after).first()
    assert (row["total_companies"], row["companies_with_email"]) == (2, 0)
    published = carried.carried_check("coverage_published_total", after).first()
    assert (published["companies_with_email"], published["companies_without_email"]) == (1, 1)  # a blank one counts there
    assert after["company_addresses"].count() == after["invalid_addresses"].count() == 0


def test_the_order_of_merging_does_not_matter(spark):
    parts = [counts_of(spark, tables(seed=s, rows=120)) for s in (1, 2, 3)]
    one = carried.merge_counts(*parts)
    other = carried.merge_counts(parts[2], carried.merge_counts(parts[1], parts[0]))
    for name in one:
        same(one[name], other[name])


def test_removing_what_was_never_there_is_reported(spark):
    emails = [(1, 7, "s", "AU", "a@b.com", "valid")]
    below = carried.impossible_counts(carried.email_counts(carried.signed(removed=frame(spark, "emails", emails)))).collect()
    assert {(r["table"], r["value"]) for r in below} >= {("companies", -1), ("formats", -1), ("company_addresses", -1)}


def test_empty_tables(spark):
    empty = counts_of(spark, {name: [] for name in DDL})
    frames = {name: frame(spark, name, []) for name in DDL}
    for name in carried.CHECKS:
        same(carried.carried_check(name, empty), RECOUNT[name](frames))


def test_a_release_that_is_not_whole_is_not_read(spark, tmp_path):
    with pytest.raises(ValueError, match="no whole release"):
        read_counts(spark, str(tmp_path), "r1")
    counts = counts_of(spark, {"domains": [(1, None, None, None, 200)]})
    write_counts(counts, str(tmp_path), "r1")
    assert set(read_counts(spark, str(tmp_path), "r1")) == {"domain_ids"}
    with pytest.raises(ValueError, match="stored already"):
        write_counts(counts, str(tmp_path), "r1")
    with pytest.raises(ValueError, match="follow itself"):
        carry_counts(counts, str(tmp_path), "r1", "r1")


def test_many_equal_rows_are_folded_before_they_are_cleaned(spark):
    emails = spark.range(50_000).select(
        F.lit(1).cast("bigint").alias("id"), F.lit("s").alias("slug"), F.lit("AU").alias("country"), F.concat(F.lit("a"), F.col("id") % 1, F.lit("@b.com")).alias("email"), F.lit(None).cast("string").alias("verification_status")
    )
    counts = carried.email_counts(emails)
    assert [tuple(r) for r in counts["company_addresses"].collect()] == [(1, "AU", "a0@b.com", 50_000)]
    df = counts["formats"]
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    fold = plan[plan.rindex("partial_sum(") :]  # the plan reads from the top down
    assert "email_clean" in plan and "email_clean" not in fold and "Exchange" not in fold
