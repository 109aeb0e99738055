"""Problem 6: references to records that are missing, arrived later, or are deleted.

The keys of all parent tables form a register-blocked Bloom filter: one 64-bit word per block, all bits of a key in one
word, built by a map-side combined ``bit_or`` and held as a table of words whose number follows that of the keys.  Up to
MAX_WORDS it is broadcast; a larger one stays spread over the cluster and references are routed to the range of words
they need.  A reference whose bits are not all set is a definite orphan.  Only filter-positive references are verified
by an exact join.  Parents and references are each computed once and written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.ids import clean_id, is_entity_id
from annalist.operators.skew import join_unique
from annalist.session import cut, cut_counted

#: Upper bound of filter words (64 bits each) that are broadcast: 2^20 words, enough for about 4 million keys, take about
#: 50 MB in an executor.
MAX_WORDS = 1 << 20
BITS_PER_KEY = 16
PROBES = 5


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(words))


def _bits(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(23))
    mask = F.lit(0).cast("bigint")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def bloom(keys: DataFrame, key: str, words: int) -> DataFrame:
    """The filter as a table (``b_word``, ``b_bits``) of at most ``words`` rows."""
    return keys.groupBy(_word(F.col(key), words).alias("b_word")).agg(F.bit_or(_bits(F.col(key))).alias("b_bits"))


def probe(rows: DataFrame, key: str, filter_: DataFrame, words: int) -> DataFrame:
    """Adds ``maybe``: false proves that ``key`` is not among the filter's keys.  ``filter_`` has at most ``words`` rows."""
    d = rows.withColumn("b_word", _word(F.col(key), words))
    d = d.join(F.broadcast(filter_), "b_word", "left") if words <= MAX_WORDS else join_unique(d, filter_, "b_word", "left")
    hit = F.col("b_bits").bitwiseAND(_bits(F.col(key))) == _bits(F.col(key))
    return d.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("b_word", "b_bits")


def filter_words(keys: int) -> int:
    """Words for that many keys, a power of two."""
    words = 1024
    while words * 64 < keys * BITS_PER_KEY:
        words *= 2
    return words


def parents(entities: DataFrame, map_entities: DataFrame, events: DataFrame, documents: DataFrame, commits: DataFrame) -> DataFrame:
    """One row per parent key: ``key`` (name space and id), earliest ``born``, and ``gone`` (null while present).

    Of an id with several rows the earliest arrival counts, and it is deleted when every row is removed.
    """
    keyed = lambda space, c: F.concat(F.lit(f"{space}:"), clean_id(c))
    never = F.lit(None).cast("timestamp_ntz")
    parts = [
        entities.select(keyed("entity", F.col("id")).alias("key"), "seen_at", "removed_at"),
        map_entities.select(keyed("entity", F.col("id")).alias("key"), "seen_at", "removed_at"),
        events.select(keyed("event", F.col("id")).alias("key"), "seen_at", never.alias("removed_at")),
        documents.select(keyed("doc", F.col("path")).alias("key"), "seen_at", never.alias("removed_at")),
        commits.select(keyed("commit", F.col("sha")).alias("key"), "seen_at", never.alias("removed_at")),
        commits.where(F.length(clean_id(F.col("sha"))) > 12).select(F.concat(F.lit("commit:"), F.substring(clean_id(F.col("sha")), 1, 12)).alias("key"), "seen_at", never.alias("removed_at")),
    ]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    lasts = F.max(F.coalesce("removed_at", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")))
    d = d.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("seen_at").alias("born"), lasts.alias("gone"))
    return d.withColumn("gone", F.when(F.col("gone") < F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"), F.col("gone")))


def references(relations: DataFrame, events: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct references: ``tbl``, ``row_id``, ``field``, ``missing_id``, ``key`` (its parent key), ``seen_at``."""

    def end(field: str) -> DataFrame:
        c = clean_id(F.col(field))
        key = F.when(is_entity_id(c), F.concat(F.lit("entity:"), c)).when(c.startswith("evt-"), F.concat(F.lit("event:"), c))
        return relations.select(F.lit("relations").alias("tbl"), "row_id", F.lit(field).alias("field"), c.alias("missing_id"), key.alias("key"), "seen_at")

    refs = events.select(F.lit("event_log").alias("tbl"), "row_id", F.lit("refs").alias("field"), "seen_at", F.explode("refs").alias("ref"))
    kind, rid = clean_id(F.col("ref.kind")), clean_id(F.col("ref.id"))
    space = F.when(kind.isin("entity", "adr"), "entity:").when(kind == "event", "event:").when(kind == "doc", "doc:").when(kind == "commit", "commit:")
    refs = refs.select("tbl", "row_id", "field", rid.alias("missing_id"), F.concat(space, rid).alias("key"), "seen_at")
    listed = entities.select(F.lit("entities").alias("tbl"), "row_id", F.lit("source_events").alias("field"), "seen_at", F.explode("source_events").alias("ref"))
    sid = clean_id(F.col("ref"))
    listed = listed.select("tbl", "row_id", "field", sid.alias("missing_id"), F.concat(F.lit("event:"), sid).alias("key"), "seen_at")
    d = end("source").unionByName(end("target")).unionByName(refs).unionByName(listed)
    return d.where("key IS NOT NULL AND row_id IS NOT NULL")


def orphans(relations: DataFrame, events: DataFrame, entities: DataFrame, map_entities: DataFrame, documents: DataFrame, commits: DataFrame) -> DataFrame:
    """p6_found: one row per row and bad reference, with reason and period.

    Null and empty references point nowhere and are not bad.  A reference with a null ``seen_at`` can only be missing
    and has the period ''.  Repeated references of a row count once.
    """
    p, n_keys = cut_counted(parents(entities, map_entities, events, documents, commits), "parents")
    words = filter_words(n_keys)
    d = cut(probe(references(relations, events, entities), "key", bloom(p, "key", words), words), "probed")
    definite = d.where("NOT maybe").withColumn("reason", F.lit("missing"))
    checked = join_unique(d.where("maybe"), p.withColumn("present", F.lit(True)), "key", "left")
    reason = (
        F.when(F.col("present").isNull(), "missing")
        .when(F.col("field") == "source_events", None)
        .when(F.col("born") > F.col("seen_at"), "late")
        .when(F.col("gone") <= F.col("seen_at"), "deleted")
    )
    checked = checked.withColumn("reason", reason).where(F.col("reason").isNotNull())
    cols = ["tbl", "row_id", "field", "missing_id", "reason", "seen_at"]
    out = definite.select(*cols).unionByName(checked.select(*cols))
    period = F.coalesce(F.date_format("seen_at", "yyyy-MM"), F.lit(""))
    return out.select("tbl", F.col("row_id").cast("bigint").alias("row_id"), "field", "missing_id", "reason", period.alias("period")).distinct()


def report(found: DataFrame) -> DataFrame:
    """Bad references per table, field, reason and month."""
    return found.groupBy("tbl", "field", "reason", "period").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("row_id").alias("n_rows"), F.countDistinct("missing_id").alias("n_ids"))
