"""Joins: label by membership, fan-out left join, lookup enrichment.

No broadcast is hinted on a guess: Spark broadcasts a side whose size in bytes it knows or
measures (adaptive execution) to be under its threshold.  The one hint is for lookups of
a stated number of rows.

Where the list may be long, the join is by shuffle.  Fact rows with a null key match
nothing; they are spread over salts instead of meeting in one task.  Hot keys are found
from a key-only sample and salted too (``hot_keys``): the adaptive skew split cannot help
when the small side is an aggregate placed directly under the join.  On a stream there is
no sample to take; there only null keys are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provguard.session import ensure_checkpoint_dir, plan_bytes


def surely_broadcast(df: DataFrame) -> bool:
    """True when Spark will broadcast a frame by its size estimate in bytes."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return plan_bytes(df) <= limit


# Hot-key handling for shuffle joins (see ``hot_keys``).
DEFAULT_SALT_BUCKETS = 32
DEFAULT_HOT_SHARE = 0.01
DEFAULT_SAMPLE_FRACTION = 0.01
FIXED_LOOKUP_ROWS = 10_000


def hot_keys(df: DataFrame, key: str, share: float = DEFAULT_HOT_SHARE,
             fraction: float = DEFAULT_SAMPLE_FRACTION, seed: int = 17) -> list:
    """Keys holding at least ``share`` of the rows, estimated from a sample.

    Only the key column is read (column pruning), the sample is counted per
    key with partial aggregation, and at most ``1 / share`` keys can pass the
    threshold, so the list that reaches the driver is bounded.
    """
    sample = df.select(F.col(key).alias("_k")).where(F.col("_k").isNotNull())
    sample = sample.sample(False, fraction, seed)
    counts = sample.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    total = sample.agg(F.count(F.lit(1))).scalar()
    hot = (counts.where(F.col("_n") >= total * F.lit(share))
                 .orderBy(F.col("_n").desc()).limit(int(1 / share) + 1))
    return [r["_k"] for r in hot.collect()]


def _salted_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                      hot: list, buckets: int) -> DataFrame:
    """Left join where rows of hot and null keys are spread over ``buckets`` salts.

    A left row of such a key gets a salt from a hash of the row; every right
    row of a hot key is repeated once per salt, other keys use salt 0.  Each
    left row therefore meets exactly the right rows of its key, as in the
    plain join, but a hot key's rows are spread over ``buckets`` tasks.
    """
    lk, rk = F.col(left_key), F.col(right_key)
    hashed = [F.col(f.name) for f in left.schema.fields if not isinstance(f.dataType, T.MapType)]
    row_hash = F.pmod(F.xxhash64(*hashed), F.lit(buckets)).cast("int")
    l2 = left.withColumn("_salt", F.when(lk.isNull() | lk.isin(hot), row_hash).otherwise(F.lit(0)))
    salts = F.when(rk.isin(hot), F.sequence(F.lit(0), F.lit(buckets - 1))) \
             .otherwise(F.array(F.lit(0)))
    r2 = right.withColumn("_rsalt", F.explode(salts) if hot else F.lit(0))
    cond = (l2[left_key] == r2[right_key]) & (l2["_salt"] == r2["_rsalt"])
    return l2.join(r2, cond, "left").drop("_salt", "_rsalt")


def spread_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                     salt_buckets: int = DEFAULT_SALT_BUCKETS,
                     hot_share: float = DEFAULT_HOT_SHARE) -> DataFrame:
    """Left join that stands null and hot left keys, by broadcast if the right side is small."""
    if surely_broadcast(right):
        return left.join(right, left[left_key] == right[right_key], "left")
    hot = [] if left.isStreaming else hot_keys(left, left_key, hot_share)
    return _salted_left_join(left, right, left_key, right_key, hot, salt_buckets)


def label_by_membership(facts: DataFrame, members: DataFrame, fact_key: str,
                        member_key: str | None = None, label: str = "fraud",
                        yes: object = "yes", no: object = "no",
                        salt_buckets: int = DEFAULT_SALT_BUCKETS,
                        hot_share: float = DEFAULT_HOT_SHARE) -> DataFrame:
    """Add ``label``: ``yes`` when the fact's key is on the list, else ``no``.

    The list is reduced to distinct keys first, so a key listed twice never
    multiplies fact rows, and the fact row count is unchanged.
    """
    keys = (members.select(F.col(member_key or fact_key).alias("_member_key"))
            .where(F.col("_member_key").isNotNull()).distinct().withColumn("_member_hit", F.lit(True)))
    joined = spread_left_join(facts, keys, fact_key, "_member_key", salt_buckets, hot_share)
    return (joined
            .withColumn(label, F.when(F.col("_member_hit").isNotNull(), F.lit(yes))
                        .otherwise(F.lit(no)))
            .drop("_member_key", "_member_hit"))


# --- Bloom prefilter -----------------------------------------------------------

BLOOM_BITS_PER_KEY = 16  # with 4 bits set: about 1 of 300 other keys passes
BLOOM_MAX_BYTES = 8 << 20


def _bloom_place(key: Column, words: int) -> tuple[Column, Column]:
    """The word (64 bits) of a key and its four bits there."""
    h = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for n in range(4):
        at = F.shiftrightunsigned(h, 6 * n).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return F.pmod(F.xxhash64(key), F.lit(words)), mask


def bloom_words(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(word, bits): the filter of a key column.  Filters of one size merge by ``merge_bloom``."""
    word, mask = _bloom_place(F.col(key), words)
    return keys.where(F.col(key).isNotNull()).groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))


def merge_bloom(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of both key sets."""
    return a.unionByName(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def might_hold(bloom: DataFrame, key: Column, words: int) -> Column:
    """False only for keys that the filter surely lacks; null for a null key.

    The filter comes to the tasks as one array of ``words`` numbers (a scalar subquery)."""
    every = bloom.sparkSession.range(words).join(bloom, F.col("id") == F.col("word"), "left")
    array = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("a"))
    array = array.select(F.transform("a", lambda x: x["bits"])).scalar()
    word, mask = _bloom_place(key, words)
    held = F.element_at(array, (word + 1).cast("int"))
    return F.when(key.isNotNull(), held.bitwiseAND(mask) == mask)


def label_by_bloom(facts: DataFrame, members: DataFrame, fact_key: str, member_key: str | None = None, label: str = "fraud",
                   yes: object = "yes", no: object = "no", max_bytes: int = BLOOM_MAX_BYTES) -> DataFrame:
    """``label_by_membership`` where only rows that pass a Bloom filter of the list are shuffled.

    The filter is built in Spark and its size is checked: a list too long for ``max_bytes`` is
    joined without it.  Rows that miss take ``no`` straight from the scan, so the fact table is scanned
    twice, and the join's shuffle holds the list's rows and few others."""
    if facts.isStreaming:
        return label_by_membership(facts, members, fact_key, member_key, label, yes, no)
    ensure_checkpoint_dir(facts.sparkSession)
    keys = members.select(F.col(member_key or fact_key).alias("_listed")).where(F.col("_listed").isNotNull()).distinct().checkpoint()
    words = max(1, -(-keys.count() * BLOOM_BITS_PER_KEY // 64))
    if 8 * words > max_bytes:
        return label_by_membership(facts, keys, fact_key, "_listed", label, yes, no)
    kind = facts.schema[fact_key].dataType
    keys = keys.withColumn("_listed", F.col("_listed").cast(kind))
    hit = F.coalesce(might_hold(bloom_words(keys, "_listed", words).checkpoint(), F.col(fact_key), words), F.lit(False))
    some = label_by_membership(facts.where(hit), keys, fact_key, "_listed", label, yes, no)
    return some.unionByName(facts.where(~hit).withColumn(label, F.lit(no)))


def left_join_fanout(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                     right_cols: list[str] | None = None, null_safe: bool = False,
                     salt_buckets: int = DEFAULT_SALT_BUCKETS,
                     hot_share: float = DEFAULT_HOT_SHARE) -> DataFrame:
    """Left outer join on differently named keys; repeated right keys fan out.

    Only ``right_cols`` (plus the key) are carried from the right side.
    """
    cols = [right_key] + [c for c in (right_cols or []) if c != right_key]
    r = right.select(F.col(right_key).alias("_right_key"), *cols[1:])
    if null_safe:
        out = left.join(r, left[left_key].eqNullSafe(r["_right_key"]), "left")
    else:
        out = spread_left_join(left, r, left_key, "_right_key", salt_buckets, hot_share)
    if right_key == left_key:
        return out.withColumnRenamed("_right_key", right_key)
    return out.drop("_right_key")


def enrich(left: DataFrame, lookup: DataFrame, on: str, null_safe: bool = False,
           known_rows: int | None = None) -> DataFrame:
    """Left join a lookup on a shared key name; unmatched left rows are kept.

    ``known_rows`` states a fixed lookup size (e.g. a constant table), which
    proves a bound for a broadcast; other lookups are left to Spark's sizes.
    """
    lk = F.broadcast(lookup) if known_rows is not None and known_rows <= FIXED_LOOKUP_ROWS else lookup
    if not null_safe:
        return left.join(lk, on, "left")
    renamed = lk.withColumnRenamed(on, "_lk_key")
    return (left.join(renamed, left[on].eqNullSafe(renamed["_lk_key"]), "left")
            .drop("_lk_key"))
