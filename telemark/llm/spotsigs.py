"""SpotSigs: chains of content words that follow common words are a text's signatures.

A text is lower-cased and read as words of letters and digits. Every anchor (a common word of the
lists below, or one of the other words that a hash picks) that has a content word after it gives one signature: the anchor and the next ``chain`` content words, common
words between them left out. A text without any anchor takes each of its words as one. The fingerprint is the
sorted set of the signatures' 32-bit hashes in hexadecimal. Two fingerprints are compared by Jaccard, pruned by
length: sets whose sizes alone rule the threshold out are not intersected. Built-in column functions only.

Defined results: a null text is an empty one; a text without words has the empty fingerprint; two empty fingerprints are alike
with 1.0, an empty one and another with 0.0; each row is fingerprinted on its own; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemark.llm.rows import only
from telemark.session import settle

CHAIN = 2
#: Of other words, one in so many is an anchor by its hash, so that tables and lists have signatures too.
ONE_IN = 8
#: Ids of one block of neighbours.
BLOCK = 4096
#: Common words by language.
COMMON = frozenset(
    # English
    "a an and are as at be been but by can do for from had has have he her his i if in into is it its may more no not of on one or our said she so than that the their them then there these they this to was "
    "we were what when which who will with would you your "
    # German
    "aber als am auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im ist kann man mit nach nicht noch nur oder sein sich sie sind über um und "
    "uns von vor war was wenn wie wir wird zu zum zur "
    # French
    "au aux avec ce ces cette dans de du elle en est et être il ils je la le les leur lui mais même ne nous ou où par pas plus pour qu que qui sa se ses son sont sur un une vous "
    # Spanish
    "al como con del desde e el ella ellos era es esta este esto fue ha hay la las lo los más mi muy ni nos o para pero por porque que se ser si sin sobre su sus también te tiene un una y ya".split()
)
_MARK = "\x01"


def _marked(text: Column) -> Column:
    """The text's words with single spaces, a mark before each anchor. A word that is an anchor by its
    hash is a content word too; without any anchor every word is both."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    common = sorted(COMMON)
    both = lambda w: F.concat(F.lit(_MARK), w, F.lit(" "), w)
    hashed = lambda w: F.crc32(w.cast("binary")) % ONE_IN == 0
    spotted = F.array_join(F.transform(words, lambda w: F.when(w.isin(common), F.concat(F.lit(_MARK), w)).when(hashed(w), both(w)).otherwise(w)), " ")
    plain = F.array_join(F.transform(words, both), " ")
    # an anchor said again at once has the signature of its repetition
    return F.regexp_replace(F.when(spotted.contains(_MARK), spotted).otherwise(plain), f"({_MARK}[^ ]+)(?: \\1(?![^ ]))++", "$1")


def fingerprint(text: Column, chain: int = CHAIN) -> Column:
    """The sorted distinct 32-bit hashes of the signatures, in hexadecimal."""
    skip = f"(?: {_MARK}[^ ]+)*+"
    # an anchor, then up to ``chain`` content words with any anchors between them; the look-ahead lets chains overlap
    ahead = f"{skip} [^ {_MARK}][^ ]*+" + f"(?:{skip} [^ {_MARK}][^ ]*+)?" * (chain - 1)
    spots = F.regexp_extract_all(_marked(text), F.lit(f"{_MARK}(?=([^ ]++{ahead}))"), F.lit(1))
    chains = F.split(F.regexp_replace(F.array_join(spots, "\n"), f" {_MARK}[^ \n]++", ""), "\n")
    hashes = F.transform(F.filter(chains, lambda s: s != ""), lambda s: F.lpad(F.lower(F.hex(F.xxhash64(s).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.array_join(F.array_sort(F.array_distinct(hashes)), " ")


def members(print_: Column) -> Column:
    return F.filter(F.split(print_, " "), lambda s: s != "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two fingerprints; 0.0 without intersecting where the sizes alone keep it below ``least``."""
    n, m = size(a), size(b)
    both = F.size(F.array_intersect(members(a), members(b)))
    return (
        F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0)
        .when(F.least(n, m) < F.greatest(n, m) * least, 0.0)
        .otherwise(both / (n + m - both)).cast("double")
    )


def size(print_: Column) -> Column:
    return F.when(print_ == "", 0).otherwise((F.length(print_) + 1) / 9).cast("long")


def length_partition(n: Column, least: float) -> Column:
    """Sets alike at ``least`` lie in one partition or in neighbouring ones."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / F.lit(-math.log(least)))).cast("long")


def near_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) between the smallest ids of different fingerprints at least so much alike.

    Sets are partitioned by length. A pair must share one of the first n - ceil(least * n) + 1 hashes of each set, so only sets that share
    one of those, in the same partition or the next, are compared, once each, lengths first."""
    classes = docs.where("doc_id is not null").groupBy(fingerprint(F.col("text")).alias("print")).agg(F.min("doc_id").alias("id"))
    classes = classes.where("print <> ''").withColumn("n", size(F.col("print"))).withColumn("part", length_partition(F.col("n"), least))
    classes = settle(classes, "spots")
    first = F.slice(members(F.col("print")), F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))
    entries = classes.select("id", "n", "part", F.explode(first).alias("spot"))
    left = entries.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "spot", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    right = entries.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "spot", "part")
    asked = left.join(right, ["spot", "part"]).where((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least)).select("a", "b").distinct()
    prints = classes.select("id", "print")
    both = asked.join(prints.select(F.col("id").alias("a"), F.col("print").alias("p")), "a").join(prints.select(F.col("id").alias("b"), F.col("print").alias("q")), "b")
    return both.select("a", "b", likeness(F.col("p"), F.col("q"), least).alias("likeness")).where(F.col("likeness") >= least)


def with_next(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row's text and fingerprint with those of the next document by falling id (after the last: the first).

    The next row is found within blocks of ids; only the last row of a block looks outside, at the head of the next block
    that has rows, and these heads are few. Rows with a null id have no next document."""
    rows = docs.where("doc_id is not null").select("doc_id", "text", F.floor(F.col("doc_id") / block).alias("_block"))
    heads = rows.groupBy("_block").agg(F.max("doc_id").alias("_head"))
    # one row for each block of ids, ids only
    falling = Window.partitionBy(F.lit(0)).orderBy(F.desc("_block"))
    ends = falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = settle(heads.select("_block", F.coalesce(F.lead("_head").over(falling), F.first("_head").over(ends)).alias("doc_id")), "heads")
    texts = only(docs.select("doc_id", "text"), after.select("doc_id").distinct()).groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    carry = after.join(texts, "doc_id").select("_block", F.col("text").alias("_first_text"), fingerprint(F.col("text")).alias("_first_print"))
    printed = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "_block", fingerprint(F.col("text")).alias("fingerprint"))
    order = Window.partitionBy("_block").orderBy(F.desc("doc_id"), F.desc("text"))
    led = printed.select(
        "*", F.lead("text").over(order).alias("_next_text"), F.lead("fingerprint").over(order).alias("_next_print")
    ).join(carry, "_block", "left")
    known = led.select(
        "doc_id", "text", "fingerprint", F.coalesce("_next_text", "_first_text").alias("next_text"), F.coalesce("_next_print", "_first_print").alias("next_fingerprint")
    )
    alone = docs.where("doc_id is null").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), fingerprint(F.col("text")).alias("fingerprint"), F.lit("").alias("next_text"), F.lit("").alias("next_fingerprint")
    )
    return known.unionByName(alone)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts and of their edited forms (the last third replaced by the next document's start), and how alike they are."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = with_next(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        size(F.col("fingerprint")).alias("n_signatures"), length_partition(size(F.col("fingerprint")), 0.8).alias("length_partition"),
    )
