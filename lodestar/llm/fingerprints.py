"""Document fingerprints of closed syncmers, in DataFrame functions only.

A text's units are its words; a word of over LONG code points is cut into pieces, where its content says, and
its wide characters stand alone, so that texts without blanks have units too. The units are hashed; of every
run of five units the four hashes of pairs are compared, and the run is an anchor if the smallest stands
first or last. Whether a run is an anchor depends on its own units alone, so an edit elsewhere leaves it in
place. A fingerprint lists ``position:hash`` of the anchors in order. A text without an anchor (under five
units, or rarely more) has one, of all its units, at position 0.

Likeness is positional: an anchor counts as met if the other text has it too, as far behind the anchor before
it; likeness is the Jaccard coefficient of the distinct anchors so placed. Texts of any length are treated
alike. The next document follows in descending doc_id, the first after the last.

Nulls: a null text is empty (its fingerprint has the anchor of no words); null doc_ids come last in the
descending order. Equal doc_ids are ordered by a hash of their texts. A single row is its own next. An
empty table gives no rows. Other columns are ignored. Texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestar.llm import scratch

K, S = 5, 2
#: Code points of a word above which it is cut: wide characters alone, others after a vowel or a low digit, or eight at most.
LONG = 16
_PIECES = "[\\x{0E00}-\\x{0EFF}\\x{2E80}-\\x{10FFFF}]|[^\\x{0E00}-\\x{0EFF}\\x{2E80}-\\x{10FFFF}]{0,7}?[aeiouAEIOU0-4]|[^\\x{0E00}-\\x{0EFF}\\x{2E80}-\\x{10FFFF}]{1,8}"
_SPACES = "[\\x20\\x09-\\x0D]+"
_TRIM = " \t\n\x0b\f\r"
#: Quantiles of doc_id between which buckets are spread evenly.
QUANTILES = 64


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column) -> Column:
    """Struct of anchor positions and 32-bit anchor hashes of a text."""
    words = F.split(F.btrim(text, F.lit(_TRIM)), _SPACES)
    cut = lambda ws: F.flatten(F.transform(ws, lambda w: F.when(F.length(w) > LONG, F.regexp_extract_all(w, F.lit(_PIECES), F.lit(0))).otherwise(F.array(w))))
    units = _let(words, lambda ws: F.when(F.exists(ws, lambda w: F.length(w) > LONG), cut(ws)).otherwise(ws))
    hashes = F.transform(units, lambda w: F.xxhash64(w))
    none = F.struct(F.array(F.lit(0)).alias("at"), F.array(F.shiftrightunsigned(F.xxhash64(hashes), 32)).alias("hash"))

    def chosen(v: Column) -> Column:
        last = K - S

        def edge(i: Column) -> Column:
            a, z = v[i], v[i + last]
            inner = F.least(*(v[i + j] for j in range(1, last)))
            return (F.least(a, z) < inner) | (F.least(a, z) == inner)

        def gather(at: Column) -> Column:
            return F.struct(at.alias("at"), F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*(v[i + j] for j in range(last + 1))), 32)).alias("hash"))

        places = F.filter(F.sequence(F.lit(0), F.size(v) - (last + 1)), edge)
        return _let(places, gather)

    pairs = lambda h: F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b))
    some = _let(hashes, lambda h: F.when(F.size(h) >= K, _let(pairs(h), chosen)))
    return _let(some, lambda s: F.when(F.size(s["at"]) > 0, s).otherwise(none))


def spelled(found: Column) -> Column:
    return F.concat_ws(" ", F.zip_with(found["at"], found["hash"], lambda i, h: F.concat(i.cast("string"), F.lit(":"), F.lower(F.hex(h)))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays of distinct placed anchors."""
    both = F.size(F.array_intersect(a, b))
    return _let(both, lambda n: n / (F.size(a) + F.size(b) - n))


def placed(found: Column) -> Column:
    """Distinct anchors with their distance to the anchor before."""
    at = found["at"]
    before = F.concat(F.slice(at, 1, 1), F.slice(at, 1, F.size(at) - 1))
    gaps = F.zip_with(at, before, lambda x, y: x - y)
    return F.array_distinct(F.zip_with(found["hash"], gaps, lambda h, g: F.xxhash64(h, g)))


def positional_likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two fingerprint strings' anchors at equal places in their texts."""
    x, y = F.split(a, " "), F.split(b, " ")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _bucket(doc: Column, bounds: list[int], inner: int) -> Column:
    """Bucket of an id: a binary search over quantiles, then even steps between two of them."""

    def search(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            width = max(1, bounds[hi] - bounds[lo])
            step = F.floor((doc - F.lit(bounds[lo])).cast("double") / float(width) * inner).cast("long")
            return F.lit(lo * inner) + F.least(F.greatest(step, F.lit(0)), F.lit(inner - 1))
        mid = (lo + hi) // 2
        return F.when(doc < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid, hi))

    return search(0, len(bounds) - 1)


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, found, next_text, next_found``: each document with the next in descending doc_id.

    Rows are dealt by stretches of doc_id; the first row of a stretch is also sent to the stretch above it,
    whose last row it follows. The stretches' largest ids are the only thing broadcast: one row a stretch,
    and stretches are a fixed multiple of the shuffle partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low = F.lit(-(2**63))
    ids = rows.select(F.coalesce("doc_id", low).alias("key"))
    q = ids.agg(F.percentile_approx("key", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("q")).first().q
    if not q:
        q = [0]
    bounds = sorted(set(q)) if len(set(q)) > 1 else [q[0], q[0] + 1]
    inner = max(1, -(-8 * scratch.shuffle_partitions(spark) // (len(bounds) - 1)))
    edges = ids.groupBy(_bucket(F.col("key"), bounds, inner).alias("bucket")).agg(F.max("key").alias("top"))
    order = Window.orderBy("bucket")
    tops = edges.select("bucket", "top", F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order)).alias("target"))
    keyed = rows.withColumn("key", F.coalesce("doc_id", low)).withColumn("bucket", _bucket(F.col("key"), bounds, inner))
    sent = keyed.join(F.broadcast(tops), "bucket").withColumn("to", F.explode(F.when(F.col("key") == F.col("top"), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost")), F.struct(F.col("target").alias("b"), F.lit(1).alias("ghost")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost"))))))
    dealt = sent.select(F.col("to.b").alias("b"), F.col("to.ghost").alias("ghost"), "key", F.xxhash64("text").alias("tie"), "doc_id", "text")
    along = ["ghost", F.col("key").desc(), F.col("tie").desc()]
    placed = dealt.repartition(F.col("b")).sortWithinPartitions("b", *along).withColumn("found", anchors(F.col("text")))
    w = Window.partitionBy("b").orderBy(*along)
    led = placed.withColumn("next_text", F.lead("text").over(w)).withColumn("next_found", F.lead("found").over(w))
    return led.filter("ghost = 0").select("doc_id", "text", "found", "next_text", "next_found")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, with their likeness and that of the next document."""
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    led = with_next(docs).withColumn("n_chars", n)
    edited = led.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    both = edited.select("doc_id", "n_chars", F.sha2(F.col("edited").cast(T.BinaryType()), 256).alias("edited_sha256"), "found", "next_found", anchors(F.col("edited")).alias("edited_found"))
    sets = both.withColumn("a", placed(F.col("found")))
    return sets.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spelled(F.col("found")).alias("fingerprint"),
        spelled(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("a"), placed(F.col("edited_found"))).alias("near_edited"),
        likeness(F.col("a"), placed(F.col("next_found"))).alias("near_next"),
    )
