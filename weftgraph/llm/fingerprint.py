"""Homomorphic multiset fingerprints of texts, in DataFrame functions only.

A text is the multiset of its paragraphs (lines).  A paragraph hashes to a wide vector: LANES numbers
modulo 2^32 from its digest, and SKETCH sign counts from the hashes of its word pairs.  A text's
fingerprint is the sum of its paragraphs' vectors, lane by lane and modulo 2^32.  So it does not
depend on their order, adding or removing a paragraph adds or subtracts one vector, and equal texts
have equal fingerprints.  The digest lanes tell different multisets apart; the sign counts estimate
how much two texts share, as twice the inner product over the sum of squared norms.

Defined results: a null text counts as empty; an empty text is one empty paragraph; rows that repeat
follow each other, so a copy's next document is its twin; null ids come after all ids, ordered by
text hash; a single document is its own next; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

LANES = 16
SKETCH = 64
MASK = 0xFFFFFFFF
#: Two counters of 32 bits each in a long: bits k and k + 32 of a pair's hash.
PAIRED = 0x0000000100000001


def _digest_lanes() -> list[Column]:
    """One paragraph's digest lanes, two from each 64-bit hash."""
    out = []
    for i in range(LANES // 2):
        h = F.xxhash64("p1", "p2", F.lit(i))
        out += [h.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(h, 32)]
    return out


def paragraph_vectors(texts: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """One row per paragraph of each ``key``: d0.. (digest lanes), n and s0.. (pair counts).

    ``key`` must tell rows of ``texts`` apart.  If ``texts`` is dealt out by part of the key, no row
    moves here.
    """
    lines = texts.select(*key, F.posexplode(F.split(column, "\n", -1)).alias("line", "p")).select(
        *key, "line", F.xxhash64("p").alias("p1"), F.xxhash64(F.lit("2"), "p").alias("p2"),
        F.split(F.trim("p"), r"\s+", -1).alias("w"))
    # A pair counts once a paragraph, so that repetition does not outweigh the rest.
    hashes = F.array_distinct(F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))),
                                         lambda a, b: F.xxhash64(a, b)))
    pairs = lines.select(*key, "line", "p1", "p2", F.explode(hashes).alias("h"))
    h = F.col("h")
    counts = [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(PAIRED))).alias(f"s{k}")
              for k in range(SKETCH // 2)]
    return (pairs.groupBy(*key, "line", "p1", "p2").agg(F.count("*").alias("n"), *counts)
            .select(*key, *(c.alias(f"d{i}") for i, c in enumerate(_digest_lanes())), "n",
                    *(f"s{k}" for k in range(SKETCH // 2))))


def combine(vectors: DataFrame, key: list[str], signs: Column | None = None) -> DataFrame:
    """Sums vectors lane by lane; ``signs`` (1 or -1 per row) subtracts removed paragraphs.

    ``d``: digest lanes; ``n``: pairs; ``s``: sign counts of each lane; all modulo 2^32, as ints.
    """
    sign = F.lit(1) if signs is None else signs
    low = lambda c: F.sum(sign * F.col(c).bitwiseAND(F.lit(MASK)))
    high = lambda c: F.sum(sign * F.shiftrightunsigned(c, 32))
    half = F.lit(1 << 31)
    whole = lambda c: (F.pmod(c + half, F.lit(MASK + 1)) - half).cast("int")
    return vectors.groupBy(*key).agg(
        F.array(*(whole(F.sum(sign * F.col(f"d{i}"))) for i in range(LANES))).alias("d"),
        whole(F.sum(sign * F.col("n"))).alias("n"),
        F.array(*(whole(f(f"s{k}")) for k in range(SKETCH // 2) for f in (low, high))).alias("s"))


def fingerprints(texts: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """key, d, n, s of every row of ``texts``."""
    return combine(paragraph_vectors(texts, key, column), key)


def written(d: str = "d", n: str = "n", s: str = "s") -> Column:
    """The fingerprint as text: lanes in hexadecimal."""
    hexed = lambda x: F.lpad(F.lower(F.hex(
        x.cast("long").bitwiseAND(F.lit(MASK)))), 8, "0")
    return F.concat_ws("-", F.array_join(F.transform(d, hexed), ""), hexed(F.col(n)),
                       F.array_join(F.transform(s, hexed), ""))


def likeness(a: tuple[str, str, str], b: tuple[str, str, str]) -> Column:
    """0 to 1 from two fingerprints (names of d, n, s): 1 for equal ones."""
    (da, na, sa), (db, nb, sb) = a, b
    signs = lambda s, n: F.transform(s, lambda x: 2.0 * x - F.col(n))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0),
                                   lambda t, v: t + v)
    x, y = signs(sa, na), signs(sb, nb)
    norms = dot(x, x) + dot(y, y)
    share = F.when(norms > 0, 2.0 * dot(x, y) / norms).otherwise(F.lit(0.0))
    return F.when(F.col(da) == F.col(db), F.lit(1.0)).otherwise(
        F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


KEY = ["id", "n_chars", "hash", "copy"]
SAME = KEY[:3]


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Rows with a key without nulls; equal rows are counted off by ``copy`` from 1.

    The last bit of ``hash`` says that the id is null (``id`` is 0 then).
    """
    none = F.col("doc_id").isNull()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text")).select(
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.char_length("text").cast("long").alias("n_chars"),
        (F.shiftleft(F.xxhash64("text"), 1) + none.cast("long")).alias("hash"), *more)
    upto = Window.partitionBy(*SAME).orderBy("hash").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("copy", F.count("*").over(upto))


def _null_id() -> Column:
    return F.col("hash").bitwiseAND(F.lit(1)) == 1


def next_keys(docs: DataFrame) -> DataFrame:
    """KEY of every row and, prefixed ``next_``, of the next document in ascending order.

    Only ids, lengths and hashes are sorted: by range into cells, in each cell in parallel; the first
    row of each cell (one row a cell) closes the gaps between cells.
    """
    spark = docs.sparkSession
    rows = _keyed(docs).select(_null_id().alias("none"), *KEY)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "none", *KEY).select(
        "*", F.spark_partition_id().alias("cell"))
    ranged = stage(ranged, "fingerprint-order")  # cells are fixed from here on
    after = F.lead(F.struct(*KEY)).over(Window.partitionBy("cell").orderBy("none", *KEY))
    firsts = ranged.groupBy("cell").agg(F.min(F.struct("none", *KEY)).alias("first"))
    over = Window.orderBy("cell")  # one row per cell
    firsts = firsts.select(
        "cell", F.coalesce(F.lead("first").over(over), F.first("first").over(over.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("first"))
    found = ranged.withColumn("after", after).join(F.broadcast(firsts), "cell")
    pick = lambda c: F.coalesce(F.col(f"after.{c}"), F.col(f"first.{c}"))
    return found.select(*KEY, *(pick(c).alias(f"next_{c}") for c in KEY))


def with_edited(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """KEY, the key of the next document, text and ``edited``: the text with its last quarter
    replaced by the next one's start.

    Both joins read the texts dealt out by SAME, so whole texts move once; starts move once more.
    """
    rows = _keyed(docs, "text")
    # Copies are told apart after the join; as an equality this would deal the texts out anew.
    twin = (F.col("copy") <= F.col("which")) & (F.col("copy") >= F.col("which"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    wanted = pairs.select(*(F.col(c).alias(f"for_{c}") for c in KEY), quarter.alias("take"),
                          *(F.col(f"next_{c}").alias(c) for c in SAME),
                          F.col("next_copy").alias("which"))
    heads = rows.join(wanted, SAME).where(twin).select(
        *(F.col(f"for_{c}").alias(c) for c in SAME), F.col("for_copy").alias("which"),
        *(F.col(c).alias(f"next_{c}") for c in KEY),
        F.substr("text", F.lit(1), F.col("take")).alias("head"))
    return rows.join(heads, SAME).where(twin).select(
        *KEY, *(f"next_{c}" for c in KEY), "text", F.concat(
            F.substr("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")),
            "head").alias("edited"))


def edits(docs: DataFrame) -> DataFrame:
    """Both fingerprints and both likenesses of every row."""
    rows = with_edited(docs, next_keys(docs))
    following = [f"next_{c}" for c in KEY]
    both = rows.select(*KEY, *following, F.inline(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("t"),
                 F.lit(None).cast("string").alias("sha")),
        F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"),
                 F.sha2(F.encode("edited", "UTF-8"), 256).alias("sha")))))
    found = fingerprints(both, [*KEY, *following, "kind", "sha"], "t")
    # The two rows of a document stand in one task already.
    of = lambda kind, *c: F.max(F.when(F.col("kind") == kind, F.struct(*c)))
    found = found.groupBy(*KEY, *following).agg(
        of(0, "d", "n", "s").alias("own"), of(1, "d", "n", "s", "sha").alias("new"))
    found = stage(found.select(
        *KEY, *following, "own.*", F.col("new.d").alias("ed"), F.col("new.n").alias("en"),
        F.col("new.s").alias("es"), F.col("new.sha").alias("edited_sha256")), "fingerprints")
    after = found.select(*(F.col(c).alias(f"next_{c}") for c in KEY), F.col("d").alias("nd"),
                         F.col("n").alias("nn"), F.col("s").alias("ns"))
    return found.join(after, following).select(
        F.when(~_null_id(), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        written().alias("fingerprint"), written("ed", "en", "es").alias("edited_fingerprint"),
        likeness(("d", "n", "s"), ("ed", "en", "es")).alias("near_edited"),
        likeness(("d", "n", "s"), ("nd", "nn", "ns")).alias("near_next"))
