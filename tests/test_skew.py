"""The join helper, and results that are divided because they are too large for one task or cell."""

import pytest
from pyspark.sql import functions as F

from dqspark import operators as op
from dqspark.operators import matching, review
from dqspark.plans import hot_keys, hot_keys_of, key_counts, null_safe_join, salted_join

from .adversarial import DDL, HOT, tables


@pytest.fixture(scope="module")
def frames(spark):
    return {name: spark.createDataFrame(rows, DDL[name]) for name, rows in tables().items()}


def test_hot_keys_are_few_and_sized_by_share(spark):
    rows = [(1, 600), (2, 300), (3, 60), (None, 1000), *[(k, 1) for k in range(10, 50)]]
    hot = hot_keys(spark.createDataFrame(rows, "id bigint, rows bigint"), "id")
    # 2,000 rows over 8 partitions are 250 per partition.
    assert {r["id"]: r["_splits"] for r in hot.collect()} == {1: 3, 2: 2}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, frames, how):
    emails, hub = frames["emails"], frames["persona_hub"].select("id", "name", "fqdn")
    hot = hot_keys(key_counts(emails, "id"), "id")
    assert [r["id"] for r in hot.collect()] == [HOT]
    salted = salted_join(emails, hub, "id", hot, [F.col("email")], how)
    plain = emails.join(hub, "id", how)
    columns = plain.columns
    assert sorted(map(str, salted.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))


def test_salted_join_spreads_equal_copies(spark):
    copies = spark.range(8000, numPartitions=16).select(F.lit(HOT).alias("id"), F.lit("same").alias("email"))
    hot = hot_keys(key_counts(copies, "id"), "id")
    assert hot.first()["_splits"] == 8
    salt = F.pmod(F.xxhash64("email", F.spark_partition_id()), F.lit(8))
    assert copies.select(salt.alias("s")).distinct().count() >= 4


def test_null_safe_join_keeps_null_keys(spark):
    left = spark.createDataFrame([(None, "a", 1), (1, None, 2), (2, "b", 3)], "id int, c string, v int")
    right = spark.createDataFrame([(None, "a", 10), (1, None, 20)], "id int, c string, w int")
    rows = null_safe_join(left, right, ["id", "c"]).collect()
    assert sorted((r["v"], r["w"]) for r in rows) == [(1, 10), (2, 20)]


def test_long_lists_are_divided_and_complete(frames):
    hub, emails = frames["persona_hub"], frames["emails"]
    whole = op.domain_match_company_review(hub, emails).collect()
    divided = op.domain_match_company_review(hub, emails, list_chars=200, block=3).collect()
    key = ("id", "name", "company_domain")
    assert len(divided) > len(whole)
    for row in whole:
        parts = sorted((p for p in divided if all(p[c] == row[c] for c in key)), key=lambda p: p["list_part"])
        for name in ("valid_emails_list", "invalid_emails_list"):
            texts = [p[name] for p in parts if p[name] is not None]
            assert (", ".join(texts) if texts else None) == row[name]
            # A piece may exceed the limit by one block of copies.
            assert all(len(t) <= 200 + 3 * 40 for t in texts)
        assert {p["total_emails"] for p in parts} == {row["total_emails"]}


def test_parts_of_lists_do_not_follow_the_partitioning(spark, frames):
    hub, emails = frames["persona_hub"], frames["emails"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for partitions in (2, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append(op.domain_match_company_review(hub, emails, list_chars=200, block=3).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    assert max(r["list_part"] for r in found[0]) > 0


def test_long_form_of_all_companies(frames):
    hub, emails = frames["persona_hub"], frames["emails"]
    everything = {tuple(r) for r in op.domain_match_review_addresses(hub, emails, n=None).collect()}
    some = {tuple(r) for r in op.domain_match_review_addresses(hub, emails, n=3).collect()}
    assert some < everything
    assert everything == {tuple(r) for r in op.domain_match_review_addresses(hub, emails, n=100_000).collect()}


def test_review_counts_agree_with_long_form(frames):
    hub, emails = frames["persona_hub"], frames["emails"]
    review = {(r["id"], r["name"], r["company_domain"]): r for r in op.domain_match_company_review(hub, emails).collect()}
    listed: dict = {}
    for r in op.domain_match_review_addresses(hub, emails).collect():
        key = (r["id"], r["name"], r["company_domain"])
        listed.setdefault(key, {True: 0, False: 0})[r["is_valid_email"]] += r["copies"]
    assert listed.keys() == review.keys()
    for key, row in review.items():
        for fits, name in ((True, "valid_emails_list"), (False, "invalid_emails_list")):
            assert (len(row[name].split(", ")) if row[name] else 0) == listed[key][fits]


def test_row_order_and_partitioning_do_not_matter(frames):
    emails, domains = frames["emails"], frames["domains"]
    one = op.priority_top_emails(emails.coalesce(1), domains.coalesce(1), min_total=8).collect()
    many = op.priority_top_emails(
        emails.orderBy(F.rand(3)).repartition(7), domains.orderBy(F.rand(4)).repartition(5), min_total=8
    ).collect()
    assert one == many


def test_ranks_have_no_gaps(frames):
    rows = op.priority_top_emails(frames["emails"], frames["domains"], min_total=8, n=None).collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault((r["id"], r["country"]), []).append(r)
    assert groups
    for members in groups.values():
        assert [m["email_rank"] for m in members] == list(range(1, min(5, members[0]["total_emails_for_company_country"]) + 1))
        scores = [m["priority_score"] for m in members]
        assert scores == sorted(scores, reverse=True)


@pytest.mark.parametrize("partitions", [2, 8, 64])
def test_hot_keys_of_rows_equal_those_of_counts(spark, frames, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        for emails in (frames["emails"], frames["emails"].limit(0)):
            of_rows = sorted(map(tuple, hot_keys_of(emails, "id").collect()))
            assert of_rows == sorted(map(tuple, hot_keys(key_counts(emails, "id"), "id").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_company_of_many_spellings_and_addresses(spark):
    many = 10_000
    hub = spark.range(many).select(
        F.lit(1).cast("bigint").alias("id"),
        F.concat(F.lit("firm"), "id").alias("name"),
        F.concat(F.lit("host"), "id", F.lit(".com")).alias("fqdn"),
    )
    address = F.concat(F.lit("p"), "id", F.lit("@mail"), "id", F.lit(".org"))
    fitting = F.concat(F.lit("p@sub.host"), "id", F.lit(".com"))
    emails = spark.range(many).select(
        F.lit(1).cast("bigint").alias("id"),
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("country"),
        F.when(F.col("id") % 1000 == 1, fitting).otherwise(address).alias("email"),
    )
    rows = {r["country"]: r["companies_valid"] for r in op.domain_match_by_country(hub, emails).collect()}
    assert rows == {"A": 0, "B": 1}


@pytest.mark.parametrize("many", [1, 3, 300, 10_000])
def test_filters_of_tokens_offer_few_pieces_by_chance_however_many_spellings(spark, many):
    """Also over several parts: 10,000 spellings have 32,768 words, in eight parts."""
    one = F.lit(1).cast("bigint").alias("id")
    hub = spark.range(many).select(one, F.concat(F.lit("firm"), "id").alias("name"), F.concat(F.lit("host"), "id", F.lit(".com")).alias("fqdn"))
    written = F.concat(F.lit("pat.lee"), "id", F.when(F.col("id") % 10 == 0, "@sub.host").otherwise("@mail"), "id", F.lit(".com"))
    emails = spark.range(2000).select(one, written.alias("email"))
    spelled, addresses = matching.usable_companies(hub, False), matching.usable_addresses(emails, False)
    sought = matching._sought(spelled)
    sizes = sought.select(F.size("bits").alias("n"), "part").collect()
    assert sum(r["n"] for r in sizes) == 2 * 2 ** (many - 1).bit_length() and max(r["n"] for r in sizes) <= 4096
    assert sorted(r["part"] for r in sizes) == list(range(len(sizes)))
    offered = matching._offered(addresses.join(sought, "id"), "id", "email").where("token IS NOT NULL").distinct().cache()
    wanted = matching._wanted(spelled).select("id", "kind", "token").distinct()
    hits = offered.join(wanted, ["id", "kind", "token"], "left_semi").count()
    assert offered.count() <= 2 * hits + 2000
    # Nothing that a spelling wants is ruled out: all clauses, told by comparing every piece.
    pieces = addresses.join(wanted.where("kind = 'root'"), "id").where(F.expr("contains(email_domain, token) OR contains(local_part, token)"))
    roots = offered.join(wanted, ["id", "kind", "token"], "left_semi").where("kind = 'root'").select("email", "token")
    assert roots.exceptAll(pieces.select("email", "token").distinct()).isEmpty() and pieces.select("email", "token").distinct().exceptAll(roots).isEmpty()
    offered.unpersist()


def test_match_reads_the_emails_twice(spark, frames, tmp_path):
    frames["emails"].write.parquet(str(tmp_path / "emails"))
    emails = spark.read.parquet(str(tmp_path / "emails"))
    for operator in (op.domain_match_by_country, op.domain_match_rollup):
        df = operator(frames["persona_hub"], emails)
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        final = text.split("== Initial Plan ==")[0]
        assert final.count("FileScan parquet") <= 2


@pytest.fixture
def without_adaptive_execution(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def hot_group(spark, many=30_000):
    """One company in one country with so many addresses at as many domains, each twice, and some small ones."""
    emails = spark.range(2 * many + 2000).select(
        F.when(F.col("id") < 2 * many, F.lit(HOT)).otherwise(F.col("id") % 100 + 2).cast("bigint").alias("id"),
        F.lit("AU").alias("country"),
        F.concat(F.lit("p"), F.col("id") % many, F.lit("@h"), F.col("id") % many, F.lit(".com")).alias("email"),
        F.when(F.col("id") % many == 777, "valid").otherwise("unknown").alias("verification_status"),
    )
    domains = spark.createDataFrame([(HOT, "h5.com"), (HOT, "x.h7.com"), (HOT, "com."), (3, "other.org")], "id bigint, fqdn string")
    return emails, domains


def test_ranking_of_a_hot_group_without_adaptive_execution(spark, without_adaptive_execution):
    emails, domains = hot_group(spark)
    rows = {(r["id"], r["email_rank"]): r for r in op.priority_top_emails(emails, domains, n=None).collect()}
    # 60,000 rows, three domain rows; the copies of p777 are verified, those of p5 and p7 match one domain row.
    best = [(rows[HOT, k]["email"], rows[HOT, k]["priority_score"], rows[HOT, k]["domain_match"]) for k in range(1, 6)]
    assert best == [("p5@h5.com", 75, 1)] * 2 + [("p7@h7.com", 75, 1)] * 2 + [("p777@h777.com", 70, 0)]
    assert {rows[HOT, k]["total_emails_for_company_country"] for k in range(1, 6)} == {180_000}
    assert len(rows) == 5


def test_names_of_a_hot_company_are_met_in_splits(spark, without_adaptive_execution):
    from dqspark.operators import ranking

    emails, domains = hot_group(spark)
    folded = ranking._folded(ranking._emails(emails))
    few = ranking._few_per_domain(folded, 5)
    met = ranking._with_company(few, domains, hot_keys_of(folded, "id"))
    tasks = met.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("rows")).collect()
    assert sum(r["rows"] for r in tasks) == few.count() and max(r["rows"] for r in tasks) < 2 * sum(r["rows"] for r in tasks) / 8


# --- the review: fitting pairs and places in lists ----------------------------------------------------


def fitting(hub, emails, **options):
    companies, addresses = matching.usable_companies(hub, False, "name"), review._addresses(emails)
    return {r["id"]: r["fitting"] for r in matching.fitting_pairs(companies, addresses, **options).collect()}


@pytest.mark.parametrize("bits", [32768, 8, 3])
def test_fitting_pairs_are_those_of_the_long_form(frames, bits):
    """Also where the spellings of a company fill many bitmaps, and where rows are repeated."""
    hub, emails = frames["persona_hub"], frames["emails"]
    hub = hub.unionByName(hub.where("id % 3 = 1")).unionByName(hub.where("id = 1"))
    want: dict = {}
    for r in op.domain_match_review_addresses(hub, emails, n=None).collect():
        if r["is_valid_email"]:
            want[r["id"]] = want.get(r["id"], 0) + r["copies"]
    assert fitting(hub, emails, bits=bits) == want


def test_many_spellings_and_addresses_that_all_fit_make_no_pairs(spark):
    many = 10_000
    hub = spark.range(many).select(
        F.lit(1).cast("bigint").alias("id"), F.concat(F.lit("firm"), "id").alias("name"), F.concat(F.lit("root.c"), "id").alias("fqdn")
    )
    emails = spark.range(many).select(
        F.lit(1).cast("bigint").alias("id"), F.concat(F.lit("p"), "id", F.lit("@root.mail")).alias("email")
    )
    companies, addresses = matching.usable_companies(hub, False, "name"), review._addresses(emails)
    df = matching.fitting_pairs(companies, addresses)
    assert [tuple(r) for r in df.collect()] == [(1, many * many)]
    assert largest_row_count(df) <= 2 * many * 24  # pieces of an address


def largest_row_count(df) -> int:
    """The most rows that any operator of the plan that ran has put out."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return most


@pytest.mark.parametrize("partitions", [2, 8, 64])
def test_lists_whose_addresses_begin_alike_are_placed_by_many_tasks(spark, partitions, without_adaptive_execution):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows = spark.range(20_000).select(
            F.lit(1).alias("id"), F.lit(None).cast("string").alias("name"), F.lit("d").alias("company_domain"), F.lit(True).alias("fits"),
            F.concat(F.lit("the-same-long-beginning-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("email"), (F.col("id") % 3 + 1).alias("rows"),
        )
        texts = {r["list_part"]: r["text"] for r in review._parts(rows, 100_000, 2).collect()}
        want = [f"the-same-long-beginning-{k:06}" for k in range(20_000) for _ in range(k % 3 + 1)]
        assert ", ".join(texts[k] for k in sorted(texts)).split(", ") == want and len(texts) == 13
        assert all(len(texts[k]) <= 100_000 + 64 for k in texts)
        marks = 64 * partitions
        with_marks = rows.join(review._range_marks(rows, marks).select("marks"))
        ranged = with_marks.withColumn("range", review._range_number(marks)).drop("marks")
        tasks = [r["n"] for r in ranged.repartition(partitions, "id", "range").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert max(tasks) < 2 * 20_000 / partitions
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("roots", [1, 2, 40])
def test_mismatch_examples_pair_few_rows_and_equal_all_pairs(spark, roots):
    """Every company's addresses begin with many of one root, which some of its domains have too."""
    n = 6
    domains = [(i, "DE", 0, f"r{d % 9}.com") for i in range(4) for d in range(60)] + [(9, "DE", 0, "r0.com")] * 30
    emails = [(i, f"a{e:03}@r{0 if e < 90 else e % roots}.com") for i in range(4) for e in range(150)]
    emails += [(9, f"b{e}@r0.org") for e in range(50)] + [(3, "a000@r0.com")] * 8
    d = spark.createDataFrame(domains, "id bigint, country string, status_code int, fqdn string")
    e = spark.createDataFrame(emails, "id bigint, email string").repartition(8)
    assert matching.mismatch_pairs(d, e, n).count() <= 2 * n * n
    found = [(r["id"], r["fqdn"], r["email"]) for r in op.domain_mismatch_examples(d, e, n).collect()]
    root = lambda name: name.split(".")[0]
    pairs = [(i, f, a) for i, _, _, f in domains for j, a in emails if i == j and root(f) != root(a.split("@")[1])]
    assert found == sorted(pairs)[:n]
