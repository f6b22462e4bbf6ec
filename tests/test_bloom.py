"""Bloom filters: no key is missed, few others pass, filters merge, results stay equal."""

import hashlib
import re

from pyspark.sql import functions as F

from contactlake.operators import bloom, suppression


def test_no_key_is_missed_and_few_others_pass(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) as k").unionByName(spark.createDataFrame([(None,)], "k string"))
    blocks = bloom.blocks_for(20_000)
    words = bloom.bloom_words(keys, "k", blocks)
    probe = spark.range(40_000).selectExpr("id", "concat('k', id) as t").unionByName(spark.createDataFrame([(-1, None)], "id long, t string"))
    got = bloom.may_contain(probe, words, F.col("t"), blocks, "may")
    assert got.columns == ["id", "t", "may"] and got.count() == 40_001
    assert got.where("id between 0 and 19999 and not may").isEmpty()
    assert got.where("id >= 20000 and may").count() < 400
    assert not got.where("id = -1").first().may
    halves = [bloom.bloom_words(keys.where(F.xxhash64("k") % 2 == i), "k", blocks) for i in (0, 1, -1)]
    merged = bloom.merge_words(halves[0].unionByName(halves[1]).unionByName(halves[2]))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, words.collect()))
    empty = bloom.may_contain(probe, words.limit(0), F.col("t"), blocks, "may")
    assert empty.where("may").isEmpty() and empty.count() == 40_001


def test_suppression_is_the_same_without_a_filter(spark, monkeypatch):
    people = spark.range(600).selectExpr("id", "concat(' User', id, '@d', id % 50, '.com') as email", "'own' as `__may0`")
    people = people.unionByName(spark.createDataFrame([(-1, None, "own"), (-2, "", "own"), (-3, "no at", "own")], people.schema))
    rows = [("email", f"USER{i}@d{i % 50}.com") for i in range(0, 600, 60)] + [("domain", "@D7.com"), ("email", None), ("md5", "x"), (None, "y")]
    entries = spark.createDataFrame([(str(i), t, v, "BOUNCE") for i, (t, v) in enumerate(rows)], "id string, type string, value string, reason string")
    hashed = people.where("id in (11, 12)").select(F.col("id").cast("string").alias("id"), F.lit("sha256").alias("type"), F.sha2(F.lower(F.trim("email")), 256).alias("value"), F.lit("LEGAL").alias("reason"))
    entries = entries.unionByName(hashed)

    def flagged(prefilter=True):
        found = suppression.check_suppression(people, entries, prefilter=prefilter).collect()
        return sorted((r.id, r.is_suppressed, r.matched_type) for r in found)

    with_filter = flagged()
    assert flagged(False) == with_filter
    assert sum(r[1] for r in with_filter) == 10 + 12 + 2
    left = suppression.filter_suppressed(people, entries, prefilter=True).count()
    monkeypatch.setattr(bloom, "MAX_BYTES", 0)
    assert flagged() == with_filter and suppression.filter_suppressed(people, entries, prefilter=True).count() == left == 603 - 24
    monkeypatch.undo()
    assert suppression.filter_suppressed(people, entries.limit(0), prefilter=True).count() == 603


def test_a_list_of_all_kinds_is_met_in_one_join(spark):
    people = spark.range(40).selectExpr("id", "concat('user', id, '@d', id % 4, '.com') as email")
    rows = [("email", "USER0@d0.com"), ("domain", "@D1.com"), ("md5", hashlib.md5(b"user2@d2.com").hexdigest()), ("sha256", hashlib.sha256(b"user3@d3.com").hexdigest()), ("email", "user0@d0.com"), ("x", "user6@d2.com")]
    entries = spark.createDataFrame([(str(i), t, v, "BOUNCE") for i, (t, v) in enumerate(rows)], "id string, type string, value string, reason string")
    for prefilter in (False, True):
        left = suppression.filter_suppressed(people, entries, prefilter=prefilter)
        assert sorted(r.id for r in left.collect()) == [i for i in range(40) if i not in (0, 2, 3) and i % 4 != 1]
        plan = left._jdf.queryExecution().sparkPlan().toString()
        # The list, the matches and the filter: a task of a join per kind held the sorts of all kinds.
        assert len(re.findall(r"\w*Join ", plan)) == 2 + prefilter and "SortAggregate" not in plan
    kinds = {r.id: r.matched_type for r in suppression.check_suppression(people, entries).collect() if r.is_suppressed}
    assert (kinds[0], kinds[1], kinds[2], kinds[3]) == ("email", "domain", "md5", "sha256") and len(kinds) == 13
