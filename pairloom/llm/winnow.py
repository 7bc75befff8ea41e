"""Operator 2: document fingerprints by winnowing, in SQL functions only.

Words are maximal runs of anything but ASCII white space.  Every ``GRAM``
consecutive words have a rolling hash, the cyclic polynomial: the 64-bit hashes
of the words, each turned by its place, combined by exclusive or, so that the
next gram's is this one's turned once, less the word that leaves, with the word
that comes.  Of every ``SPAN`` consecutive hashes the smallest is chosen, the
rightmost of equal ones, and its place is kept.  Two texts that share a run of
``GRAM + SPAN - 1`` words therefore share a chosen hash.

A text of fewer words than a gram is one gram of all its words (a text of white
space alone: of itself); an empty text has no fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm._shared import free_name, id_text, partitions, prepare

GRAM = 5
SPAN = 8


def _turned(x: Column, by: int) -> Column:
    """The 64 bits of ``x`` turned left."""
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def _with_chosen(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the chosen (hash, place) of column ``text``, in text order."""
    words, hashes, grams, least = (free_name(df, f"{out}_{x}") for x in ("words", "hashes", "grams", "least"))
    df = df.withColumn(words, F.array_remove(F.split(F.col(text), r"[ \t-\r]+"), ""))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    h, n = F.col(hashes), F.size(hashes)

    def gram(i: Column) -> Column:
        value = _turned(F.get(h, i), GRAM - 1)
        for k in range(1, GRAM):
            value = value.bitwiseXOR(_turned(F.get(h, i + k), GRAM - 1 - k))
        return value

    each = F.transform(F.sequence(F.lit(0), n - GRAM), gram)
    whole = F.array(F.when(n > 0, F.xxhash64(h)).otherwise(F.xxhash64(F.col(text))))
    df = df.withColumn(grams, F.when(n >= GRAM, each).when(F.length(text) > 0, whole).otherwise(F.array().cast("array<bigint>")))
    g, m = F.col(grams), F.size(grams)
    df = df.withColumn(least, F.transform(F.sequence(F.lit(0), F.greatest(m - SPAN, F.lit(0))), lambda i: F.least(*(F.get(g, i + k) for k in range(SPAN)))))

    def rightmost(x: Column, i: Column) -> Column:
        place = F.when(F.get(g, i + SPAN - 1) == x, i + SPAN - 1)
        for k in range(SPAN - 2, -1, -1):
            place = place.when(F.get(g, i + k) == x, i + k)
        return place

    places = F.array_distinct(F.transform(least, rightmost))
    chosen = F.transform(places, lambda i: F.struct(F.get(g, i).alias("hash"), i.alias("place")))
    return df.withColumn(out, F.when(m > 0, chosen).otherwise(F.array().cast("array<struct<hash:bigint,place:int>>"))).drop(words, hashes, grams, least)


def _hashes(chosen: str) -> Column:
    return F.array_distinct(F.col(chosen)["hash"])


def _shown(chosen: str) -> Column:
    """hash@place of each chosen gram, in text order."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit("@"), x["place"].cast("string"))), " ")


def _likeness(a: Column, b: Column) -> Column:
    """Shared of all hashes; two texts without any are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with fingerprint, hashes (array<long>) and places (array<int>) of column ``text``.

    A null text counts as empty; columns of these three names are replaced.
    """
    own, chosen = free_name(docs, "winnow_text"), free_name(docs, "winnow_chosen")
    df = _with_chosen(docs.withColumn(own, F.coalesce(F.col(text).cast("string"), F.lit(""))), own, chosen)
    return df.withColumn("fingerprint", _shown(chosen)).withColumn("hashes", _hashes(chosen)).withColumn("places", F.col(chosen)["place"]).drop(own, chosen)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    Documents follow each other by descending id (rows of one id by descending
    text, null ids last), the first after the last; a lone document follows
    itself.  The edited text has its last third replaced by the beginning of the
    next text.  A null text counts as empty, rows that repeat stay, an empty
    table gives no rows, other columns are not read.

    The ordering is cut into ranges of ids.  Within a range the next row is the
    window's; the first row of each range is copied to the end of the range
    before it, so that no task orders more than a range.  Texts are shuffled
    once, and fingerprints are made after that shuffle.
    """
    spark = prepare(docs.sparkSession)
    texts = id_text(docs)
    many = 4 * partitions(spark)
    # two values for each range, whatever the number of documents
    cuts = texts.agg(F.percentile_approx("doc_id", [k / many for k in range(1, many)], 20 * many)).first()[0]
    cuts = sorted(set(cuts or []))
    ranged = texts.withColumn("_range", _range_of(F.col("doc_id"), cuts))
    heads = {r[0]: r[1] for r in ranged.select("_range", "doc_id").groupBy("_range").agg(F.max("doc_id")).collect()}
    order = sorted(heads, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    first_of = {after[r]: r for r in order}  # whose last row the head of a range follows
    edges = _edges(ranged, heads, first_of)
    rows = ranged.withColumn("_edge", F.lit(False)).unionByName(edges).repartition(partitions(spark), "_range")
    rows = _with_chosen(rows, "text", "_own").withColumn("_own_hashes", _hashes("_own"))
    line = Window.partitionBy("_range").orderBy("_edge", F.desc_nulls_last("doc_id"), F.desc("text"))
    rows = rows.withColumn("_next_text", F.lead("text").over(line)).withColumn("_next_hashes", F.lead("_own_hashes").over(line))
    rows = rows.where(~F.col("_edge"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("_next_text", F.lit(1), third))
    rows = _with_chosen(rows.withColumn("_edited", edited), "_edited", "_new").withColumn("_new_hashes", _hashes("_new"))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        _shown("_own").alias("fingerprint"),
        _shown("_new").alias("edited_fingerprint"),
        _likeness(F.col("_own_hashes"), F.col("_new_hashes")).alias("near_edited"),
        _likeness(F.col("_own_hashes"), F.col("_next_hashes")).alias("near_next"),
    )


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """Number of the range of an id, by binary search; null ids are range -1."""
    at, steps = F.array(*(F.lit(c).cast("long") for c in cuts)), [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    found = F.reduce(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.get(at, low + step - 1) < doc_id, low + step).otherwise(low)) if cuts else F.lit(0)
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(found)


def _edges(ranged: DataFrame, heads: dict[int, int | None], first_of: dict[int, int]) -> DataFrame:
    """The first row of each range, moved to the range whose last row it follows."""
    spark = ranged.sparkSession
    known = [(h, first_of[r]) for r, h in heads.items() if h is not None]
    parts = []
    if known:
        # a row for each range; the ids reach the scan as a filter
        at = spark.createDataFrame(known, "_head long, _to int")
        first = ranged.where(F.col("doc_id").isin([h for h, _ in known])).join(F.broadcast(at), F.col("doc_id") == F.col("_head"))
        parts.append(first.groupBy("_to").agg(F.max("doc_id").alias("doc_id"), F.max("text").alias("text")))
    if -1 in heads:
        null = ranged.where(F.col("doc_id").isNull()).agg(F.max("text").alias("text"))
        parts.append(null.select(F.lit(first_of[-1]).alias("_to"), F.lit(None).cast("long").alias("doc_id"), "text"))
    if not parts:
        parts.append(ranged.limit(0).select(F.col("_range").alias("_to"), "doc_id", "text"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("doc_id", "text", F.col("_to").cast("int").alias("_range"), F.lit(True).alias("_edge"))
