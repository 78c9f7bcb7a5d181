"""Document fingerprints by SpotSigs, in DataFrame operations only.

Common words anchor signatures. Anchors are the ``ANCHORS`` words that are most frequent in the corpus at
hand, counted over all its texts; the signature of an anchor's place is the anchor with the chain of
the next two content words, that is words that are no anchors. The fingerprint of a text is the sorted set of the
32-bit checksums of its signatures. Sets are compared by Jaccard; ``similar_pairs`` partitions them by
length and prunes candidates by the rarest signatures, which a similar set must share.

Words are runs of letters and digits, in lower case. A text is cut at its content words: all anchors
between two of them have the second and the one after it as their chain, so a text costs time in
proportion to its words, however many anchors follow each other.

Edge cases: a null text is empty; a text without words has an empty fingerprint; a text with words
but without a complete chain has a signature for each pair of adjacent words, or one of all of it
if there is one word (so it is with all texts where all words are anchors); ties in frequency go by code point; two empty fingerprints are alike to
1, an empty and another one to 0; equal texts have equal fingerprints; rows with one id are ordered
by a hash of their text; null ids come last, by that hash; an empty table gives an empty result;
columns other than id and text are not read by ``with_next``, and ``fingerprints`` replaces columns
named signatures and fingerprint.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.session import materialize

#: How many of the most frequent words anchor signatures.
ANCHORS = 64
WORD, GAP = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]++"
#: For texts without any chain: every word is an anchor, its chain the next word.
PAIR = rf"(?<!{WORD})(?=({WORD}++{GAP}{WORD}++))"


def common_words(docs: DataFrame, text_col: str = "text", most: int = ANCHORS) -> list[str]:
    """The most frequent words of all texts. Counts combine before the shuffle; only the words asked for come to the driver, by a job that runs here."""
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"{WORD}++"), F.lit(0)))
    counted = docs.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def checksum(said: Column) -> Column:
    """32 bits of a digest."""
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long")


def content_word(anchors: list[str]) -> str:
    """Pattern of a whole word that is no anchor."""
    none_of = rf"(?!(?:{'|'.join(map(re.escape, anchors))})(?!{WORD}))" if anchors else ""
    return rf"(?<!{WORD}){none_of}{WORD}++"


def signatures(text: Column, anchors: list[str]) -> Column:
    """Sorted distinct checksums (array of longs) of the signatures of a text without nulls."""
    plain, content = F.lower(text), content_word(anchors)

    def of_anchors(p: Column) -> Column:
        """Checksums of the anchors before each content word that has another one after it."""
        before = F.slice(p["between"], F.lit(1), F.greatest(F.size(p["content"]) - 1, F.lit(0)))
        chain = lambda i: F.concat_ws(":", F.get(p["content"], i), F.get(p["content"], i + 1))
        words = lambda gap: F.regexp_extract_all(gap, F.lit(f"{WORD}++"), F.lit(0))
        return F.flatten(F.transform(before, lambda gap, i: F.transform(words(gap), lambda a: checksum(F.concat_ws(":", a, chain(i))))))

    # An array of one struct, so that its two arrays are computed once a text.
    cut = F.array(F.struct(F.split(plain, content, -1).alias("between"), F.regexp_extract_all(plain, F.lit(content), F.lit(0)).alias("content")))
    chains = F.flatten(F.transform(cut, of_anchors))
    pairs = F.transform(F.regexp_extract_all(plain, F.lit(PAIR), F.lit(1)), lambda m: checksum(F.array_join(F.split(m, GAP), ":")))

    def distinct(sums: Column) -> Column:
        return F.sort_array(F.array_distinct(sums))

    def or_else(first: Column, second: Column) -> Column:
        """``first`` unless it is empty; evaluated once, the second only where needed."""
        return F.get(F.transform(F.array(first), lambda s: F.when(F.size(s) > 0, s).otherwise(second)), F.lit(0))

    whole = F.when(plain.rlike(WORD), F.array(checksum(plain))).otherwise(F.array().cast("array<bigint>"))
    return or_else(distinct(chains), or_else(distinct(pairs), whole))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs.cast("array<string>"), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def length_range(n: Column, threshold: float) -> Column:
    """The partition of a set of ``n`` signatures: sets whose lengths differ by no more than the threshold allows are in one or in neighbouring partitions."""
    return F.floor(F.log(n.cast("double")) / -F.log(F.lit(threshold))).cast("int")


def alike(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """Whether two sorted sets reach the threshold: decided by their partitions and lengths, then by the prefixes that similar sets must share, and by Jaccard only if neither says no."""
    n, m = F.size(a), F.size(b)
    far = (F.abs(length_range(n, threshold) - length_range(m, threshold)) > 1) | (F.least(n, m) < threshold * F.greatest(n, m))
    prefix = lambda x, k: F.slice(x, F.lit(1), (k - F.ceil(F.lit(threshold) * k) + 1).cast("int"))
    out = F.when(far, False).when(~F.arrays_overlap(prefix(a, n), prefix(b, m)), False).otherwise(likeness(a, b) >= threshold)
    return F.when((n == 0) | (m == 0), n == m).otherwise(out)


def fingerprints(docs: DataFrame, text_col: str = "text", anchors: list[str] | None = None) -> DataFrame:
    """``docs`` with signatures and fingerprint; anchors are the common words of ``docs`` unless given."""
    anchors = common_words(docs, text_col) if anchors is None else anchors
    return docs.withColumn("signatures", signatures(F.coalesce(F.col(text_col), F.lit("")), anchors)).withColumn("fingerprint", fingerprint(F.col("signatures")))


def similar_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", anchors: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep) of classes of equal fingerprints, and pairs (rep_a, rep_b, likeness) of similar classes.

    Sets of n signatures can only be similar to sets of threshold * n to n / threshold signatures, and
    share one of their rarest n - ceil(threshold * n) + 1. Both sides are joined by such a
    signature and a range of set lengths, so frequent signatures of unlike lengths never meet.
    """
    anchors = common_words(docs, text_col) if anchors is None else anchors
    marked = docs.select(F.col(id_col).alias("id"), signatures(F.coalesce(F.col(text_col), F.lit("")), anchors).alias("sigs"))
    marked = materialize(marked)
    classes = materialize(marked.groupBy("sigs").agg(F.min("id").alias("rep")))
    rows = classes.select("rep", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("often"))
    ranked = rows.join(often, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy("often", "sig")))
    rare = ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).withColumn("range", length_range(F.col("n"), threshold))
    left = rare.select("sig", "range", F.col("rep").alias("rep_a"), F.col("n").alias("n_a"))
    right = rare.select("sig", F.explode(F.sequence(F.col("range") - 1, F.col("range") + 1)).alias("range"), F.col("rep").alias("rep_b"), F.col("n").alias("n_b"))
    alike = (F.col("rep_a") < F.col("rep_b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    met = left.join(right, ["sig", "range"]).filter(alike).select("rep_a", "rep_b").distinct()
    sets = classes.select("rep", "sigs")
    pairs = met.join(sets.toDF("rep_a", "sigs_a"), "rep_a").join(sets.toDF("rep_b", "sigs_b"), "rep_b")
    pairs = pairs.select("rep_a", "rep_b", likeness(F.col("sigs_a"), F.col("sigs_b")).alias("likeness")).filter(F.col("likeness") >= threshold)
    return marked.join(classes, "sigs").select("id", "rep"), pairs


def _bucket(ids: DataFrame, print_: Column, rows_each: int = 100, coarse: int = 32) -> Column:
    """A bucket number that rises with doc_id: ``coarse`` quantiles, each cut evenly; rows without an id by their print, below all others.

    Only the quantiles and a count come to the driver. Buckets even out the work; any cut is correct.
    """
    known = ids.filter("doc_id IS NOT NULL")
    bounds = sorted({int(x) for x in known.agg(F.percentile_approx("doc_id", [i / coarse for i in range(coarse + 1)], 10_000).alias("q"), F.lit(0)).first()["q"] or []})
    rows = known.count()
    fine = max(1, min(10_000, -(-rows // (rows_each * coarse))))
    place = F.lit(0).cast("long")
    x = F.col("doc_id")
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        inside = F.least(F.floor((x.cast("double") - float(lo)) / float(max(1, hi - lo)) * fine), F.lit(fine - 1)).cast("long")
        place = F.when(x >= lo, inside + k * fine).otherwise(place)
    return F.when(x.isNull(), F.lit(-1).cast("long") - (F.shiftright(print_, 52) + 2048)).otherwise(place)


def with_next(docs: DataFrame, anchors: list[str]) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): each document with the one of the next smaller id, the smallest with the largest.

    Ids are cut into buckets; the first row of each bucket is also dealt to the bucket before it,
    so one shuffle of the texts is enough and no bucket grows with the table.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
    placed = rows.withColumn("bucket", _bucket(docs.select("doc_id"), F.col("print")))
    # The first row of a bucket: the largest id, and of the rows that have it the smallest print.
    order_of = F.struct(F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)).alias("minus_id"), F.col("print"))
    heads = placed.groupBy("bucket").agg(F.min(order_of).alias("head"))
    down = Window.orderBy(F.desc("bucket"))  # one row a bucket, of which there are at most 32 * 10,000 and 4,096
    last = F.min("bucket").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.withColumn("before", F.coalesce(F.lag("bucket").over(down), last)).select("head", "before", F.col("bucket").alias("of_bucket"))
    tied = placed.join(F.broadcast(heads), (F.col("bucket") == F.col("of_bucket")) & (order_of == F.col("head")), "left")
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))
    there = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ghost"))
    dealt = tied.withColumn("place", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    dealt = dealt.select("doc_id", "text", "print", "place.bucket", "place.ghost").repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "print")
    led = dealt.withColumn("sigs", signatures(F.col("text"), anchors))
    led = led.withColumns({"next_text": F.lead("text").over(order), "next_sigs": F.lead("sigs").over(order)})
    return led.filter("NOT ghost").drop("bucket", "ghost", "print")


def op9_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next_text").substr(F.lit(1), half))
    anchors = common_words(docs)
    rows = with_next(docs, anchors).withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited"), anchors))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        alike(F.col("sigs"), F.col("edited_sigs")).alias("alike_edited"),
        alike(F.col("sigs"), F.col("next_sigs")).alias("alike_next"),
    )


#: A text's words are unnested with the number of content words before each; an anchor's chain is read off the list of content words.
OP9_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
following AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM docs),
edited AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM following),
texts AS (SELECT doc_id, 'own' AS kind, lower(text) AS plain FROM docs UNION ALL SELECT doc_id, 'edited', lower(edited) FROM edited UNION ALL SELECT doc_id, 'next', lower(next_text) FROM edited),
lists AS (SELECT *, regexp_extract_all(plain, '[\\p{L}\\p{N}]+') AS w FROM texts),
anchors AS (SELECT word FROM (SELECT unnest(w) AS word FROM lists WHERE kind = 'own') GROUP BY word ORDER BY count(*) DESC, word LIMIT 64),
words AS (SELECT doc_id, kind, i, word, word IN (SELECT word FROM anchors) AS anchor FROM (SELECT doc_id, kind, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM lists)),
ranked AS (SELECT *, sum(CASE WHEN anchor THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, kind ORDER BY i) AS before FROM words),
content AS (SELECT doc_id, kind, before AS r, word, lead(word) OVER (PARTITION BY doc_id, kind ORDER BY i) AS after FROM ranked WHERE NOT anchor),
chains AS (SELECT a.doc_id, a.kind, a.word || ':' || c.word || ':' || c.after AS said FROM ranked a JOIN content c ON c.doc_id = a.doc_id AND c.kind = a.kind AND c.r = a.before + 1
  WHERE a.anchor AND c.after IS NOT NULL),
without AS (SELECT doc_id, kind, plain, w FROM lists WHERE (doc_id, kind) NOT IN (SELECT DISTINCT (doc_id, kind) FROM chains)),
said AS (
  SELECT doc_id, kind, said FROM chains
  UNION ALL SELECT doc_id, kind, w[i] || ':' || w[i + 1] FROM (SELECT doc_id, kind, w, unnest(range(1, len(w))) AS i FROM without WHERE len(w) > 1)
  UNION ALL SELECT doc_id, kind, plain FROM without WHERE len(w) = 1),
sigs AS (SELECT DISTINCT doc_id, kind, ('0x' || substr(md5(said), 1, 8))::BIGINT AS sig FROM said),
prints AS (SELECT doc_id, string_agg(sig::VARCHAR, ' ' ORDER BY sig) FILTER (kind = 'own') AS fingerprint, string_agg(sig::VARCHAR, ' ' ORDER BY sig) FILTER (kind = 'edited') AS edited_fingerprint,
    count(*) FILTER (kind = 'own') AS n, count(*) FILTER (kind = 'edited') AS n_edited, count(*) FILTER (kind = 'next') AS n_next FROM sigs GROUP BY doc_id),
common AS (SELECT o.doc_id, count(*) FILTER (x.kind = 'edited') AS c_edited, count(*) FILTER (x.kind = 'next') AS c_next
  FROM sigs o JOIN sigs x ON x.doc_id = o.doc_id AND x.sig = o.sig AND x.kind <> 'own' WHERE o.kind = 'own' GROUP BY o.doc_id),
counted AS (SELECT doc_id, text, edited, coalesce(fingerprint, '') AS fingerprint, coalesce(edited_fingerprint, '') AS edited_fingerprint, coalesce(n, 0) AS n,
    coalesce(n_edited, 0) AS n_edited, coalesce(n_next, 0) AS n_next, coalesce(c_edited, 0) AS c_edited, coalesce(c_next, 0) AS c_next
  FROM edited LEFT JOIN prints USING (doc_id) LEFT JOIN common USING (doc_id)),
near AS (SELECT *, CASE WHEN n + n_edited = 0 THEN 1.0::DOUBLE ELSE c_edited::DOUBLE / (n + n_edited - c_edited) END AS near_edited,
    CASE WHEN n + n_next = 0 THEN 1.0::DOUBLE ELSE c_next::DOUBLE / (n + n_next - c_next) END AS near_next FROM counted)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
  near_edited >= 0.8 AS alike_edited, near_next >= 0.8 AS alike_next
FROM near
"""

QUERIES = {"op9_spotsigs": op9_query}
SQL = {"op9_spotsigs": OP9_SQL}
