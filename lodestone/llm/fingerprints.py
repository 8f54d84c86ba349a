"""Document fingerprints by one-permutation MinHash, in SQL functions only.

Each shingle is hashed once; the high bits of the hash name one of BINS bins, and each bin keeps its smallest hash. Empty bins are filled by
optimal densification: an empty bin looks at other bins in a pseudo-random order of its own until it meets a full one,
and takes its value. Only the low BITS bits of each value are stored. Two stored values agree by chance
with probability c = 2**-BITS, so the share p of equal bins is corrected to (p - c) / (1 - c).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD_GAP, ascii_lower

BINS, BITS = 128, 8
SHINGLE = 5
#: Bins that an empty one looks at in turn; after these it takes the full bin of least rank, so none stays empty.
PROBES = 8
#: Ranges of doc_id that the table is dealt into to find each document's successor, for each shuffle partition.
RANGES = 4

_LOW = 64 - BINS.bit_length() + 1  # bits of a hash below the bin number


def _order(seed: int = 7) -> list[int]:
    """For each bin the PROBES bins that it looks at when it is empty."""
    chance = random.Random(seed)
    return [j for i in range(BINS) for j in chance.sample([k for k in range(BINS) if k != i], PROBES)]


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased. Null gives no words."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def shingle_hashes(found: Column) -> Column:
    """Hashes of the runs of SHINGLE words in an array of word hashes; of a shorter array, of all its words together."""
    n = F.size(found)
    many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(found, i + k) for k in range(SHINGLE))))
    return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(found))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the fingerprint of ``text`` as BINS * BITS / 4 hexadecimal digits; texts without words get the empty string.

    Steps are columns of their own (dropped again), so each is worked out once.
    """
    mask = (1 << _LOW) - 1
    slots = F.array(*(F.lit(((i << _LOW) | mask) - (1 << 64 if i >= BINS // 2 else 0)) for i in range(BINS)))  # sorts last in its bin
    first = lambda x, i: (i == 0) | (F.shiftright(x, _LOW) != F.shiftright(F.get(F.col("_sorted"), i - 1), _LOW))
    full = lambda x: x.bitwiseAND(F.lit(mask)) != mask
    order = F.array(*(F.lit(j) for j in _order()))
    df = df.withColumn("_words", F.transform(words(text), lambda w: F.xxhash64(w)))
    df = df.withColumn("_sorted", F.sort_array(F.concat(shingle_hashes(F.col("_words")), slots)))
    # one value per bin: its least hash, or its slot if it is empty
    df = df.withColumn("_bins", F.filter("_sorted", first))
    df = df.withColumn("_bins", F.transform("_bins", lambda x: F.when(full(x), x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))))
    df = df.withColumn("_full", F.filter(F.transform("_bins", lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull()))
    rank = lambda i, j: F.xxhash64(i, j).bitwiseAND(F.lit(~127))
    rest = lambda i: F.get(F.col("_bins"), F.array_min(F.transform("_full", lambda j: rank(i, j).bitwiseOR(j.cast("long")))).bitwiseAND(F.lit(127)).cast("int"))
    dense = F.transform("_bins", lambda x, i: F.coalesce(x, *(F.get(F.col("_bins"), F.get(order, i * PROBES + t)) for t in range(PROBES)), rest(i)))
    df = df.withColumn(name, F.when(F.size("_words") > 0, F.array_join(F.transform(dense, lambda v: F.lpad(F.hex(v), BITS // 4, "0")), "")).otherwise(""))
    return df.drop("_words", "_sorted", "_bins", "_full")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints' shingles, 0 to 1. Two empty ones are alike; an empty one is unlike any other."""
    digits, chance = BITS // 4, 2.0**-BITS
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * digits + 1, F.lit(digits)) == F.substring(b, i * digits + 1, F.lit(digits))))
    return F.when((a == "") | (b == ""), F.when(a == b, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), (same / F.lit(BINS) - chance) / (1 - chance)))


def with_next(docs: DataFrame, columns: list[str], *, ranges: int) -> DataFrame:
    """Adds next_<column> of the document that follows in descending doc_id; the last one's successor is the first.

    The table is dealt into ranges of doc_id by approximate percentiles (``ranges`` numbers on the driver), and each range's first row also goes to
    the range before it, so that a window within the range finds every successor. Nulls come last; rows
    with equal doc_id follow each other in the order of their columns.
    """
    share = [k / ranges for k in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx("doc_id", share, ranges * 50).alias("q")).first()["q"] if share else []
    cuts = sorted(set(cuts or []))
    bounds = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<bigint>")
    # range 0 holds the largest ids; nulls go to the last
    place = F.coalesce(F.lit(len(cuts)) - F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))), F.lit(len(cuts)))
    rows = docs.withColumn("_range", place)
    order = [F.col("doc_id").desc_nulls_last(), *(F.col(c) for c in columns)]
    firsts = rows.groupBy("_range").agg(F.max("doc_id").alias("_top")).orderBy("_range").collect()  # one row for each range
    if not firsts:
        return rows.drop("_range").withColumns({f"next_{c}": F.lit(None).cast(docs.schema[c].dataType) for c in columns})
    used = [r["_range"] for r in firsts]
    tops = [r["_top"] for r in firsts]
    # the range before each first row's own; that of the first range closes the circle
    target = F.create_map(*(F.lit(x) for k, t in enumerate(tops) if t is not None for x in (t, used[k - 1]))) if any(t is not None for t in tops) else None
    heads = docs.where(F.col("doc_id").isin([t for t in tops if t is not None]) | (F.col("doc_id").isNull() if None in tops else F.lit(False)))
    to = F.lit(used[tops.index(None) - 1]) if None in tops else F.lit(None).cast("int")
    heads = heads.withColumn("_range", F.coalesce(F.element_at(target, F.col("doc_id")), to) if target is not None else to)
    # of rows that share a range's top doc_id only the first in order is its head
    pick = F.struct(*(F.col(c) for c in columns))
    ghosts = heads.groupBy("_range").agg(F.min(pick).alias("_pick")).select("_range", *(F.col(f"_pick.{c}").alias(c) for c in columns))
    both = rows.withColumn("_ghost", F.lit(0)).unionByName(ghosts.withColumn("_ghost", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("_range").orderBy("_ghost", *order)
    return both.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("_ghost = 0").drop("_range", "_ghost")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses to the edited text and to the next document.

    The edited text is the text with its last floor(n / 3) code points replaced by as many of the next document's (all of them if it has fewer). Null texts
    are empty. Repeated rows stay rows of their own and follow each other. One document alone is its own successor. Columns other than doc_id and text are dropped.
    """
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = fingerprint(base, F.col("text"), "fingerprint")
    rows = with_next(base, ["text", "fingerprint"], ranges=ranges)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    rows = fingerprint(rows, F.col("_edited"), "edited_fingerprint")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
