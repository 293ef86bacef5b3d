"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its pairs of neighbouring words (the first and the last also
pair with the text's edge), weighted by how often they occur. A sample of a
weighted set draws, for each term from hashes of the term alone, r and c from
Gamma(2, 1) and b from a uniform; with t = floor(ln(weight) / r + b), the term
with the least ln(c) - r (t - b + 1) is sampled, together with its t. Two sets
draw the same (term, t) with the probability of their generalised Jaccard
similarity, the sum of the smaller weights over the sum of the larger ones.

Drawing every sample over all terms costs samples times terms. Here the terms
are dealt to ``bins`` by hash and each bin draws one sample of what it holds, so
everything is drawn for once; likeness is the share of bins with equal samples
among the bins that either text fills. So that bins hold like masses, a term of
weight w is dealt out in pieces of weight ``piece``, the last of what remains;
sets of pieces have the same generalised Jaccard similarity as the terms, and a
piece's weight enters its draw. Larger pieces are fewer, but bins then weigh
unlike each other and the mean of the estimate strays from the similarity. With
pieces of 1, the default, all weights are 1, as counts are whole: a draw is then
that of the piece with the least ln(c) - r (1 - b + floor(b)), and t is the same
for all. ``rounds`` repeats this with other hashes. ``bins=1`` with
``piece=None``, which leaves terms whole, is plain sampling: as many samples as
rounds, of weights as they are.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import column

#: Bits of a sample's hash in a fingerprint entry, and of the fraction of the sampled minimum when it is compared.
_SAMPLE_BITS, _FRACTION_BITS = 20, 36
#: Weight of a piece of a term.
PIECE = 1


def _uniform(h: Column, low: bool) -> Column:
    """From half the bits of a hash, a number between 0 and 1, never either."""
    bits = h.bitwiseAND(F.lit(0xFFFFFFFF)) if low else F.shiftrightunsigned(h, 32)
    return (bits.cast("double") + 0.5) / float(1 << 32)


def packed_draw(term: Column, weight: Column, seed: Column) -> Column:
    """The draw of a term as a long: smaller is drawn first; its last bits are a hash of (term, t)."""
    h1, h2, h3 = (F.xxhash64(term, seed, F.lit(k)) for k in (1, 2, 3))
    r = -F.ln(_uniform(h1, True)) - F.ln(_uniform(h1, False))
    ln_c = F.ln(-F.ln(_uniform(h2, True)) - F.ln(_uniform(h2, False)))
    b = _uniform(h3, True)
    t = F.floor(F.ln(weight.cast("double")) / r + b)
    a = ln_c - r * (t.cast("double") - b + 1)
    # r is below 47 and ln(weight) below 44, so the draw lies within -256 and 256.
    place = F.least(F.greatest(a + 256, F.lit(0.0)), F.lit(511.9)) * float(1 << _FRACTION_BITS - 2)
    sample = F.xxhash64(term, t, seed).bitwiseAND(F.lit((1 << _SAMPLE_BITS) - 1))
    return F.shiftleft(place.cast("long"), _SAMPLE_BITS).bitwiseOR(sample)


def words(text: Column) -> Column:
    """What stands between white space, in lower case; white space at an end leaves an empty word there."""
    return F.split(F.lower(text), r"\s+")


def pairs(words: Column) -> Column:
    """Neighbouring words as an array of structs ``a``, ``b``; the edges are null."""
    edge = F.array(F.lit(None).cast("string"))
    return F.arrays_zip(F.concat(edge, words).alias("a"), F.concat(words, edge).alias("b"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries among the bins that either fingerprint has; entries are bin << bits | sample."""
    bins = lambda x: F.transform(x, lambda e: F.shiftright(e, _SAMPLE_BITS))
    both = F.size(F.array_intersect(bins(a), bins(b)))
    return F.size(F.array_intersect(a, b)).cast("double") / (F.size(a) + F.size(b) - both)


def as_text(entries: Column) -> Column:
    """A fingerprint as hexadecimal entries, joined by dots."""
    return F.array_join(F.transform(entries, lambda e: F.lower(F.hex(e))), ".")


def _fingerprints(texts: DataFrame, keys: list[str], variants: list[str], bins: int, rounds: int, piece: int | None) -> DataFrame:
    """``keys`` (one row each, rows of a key in one partition already) and a fingerprint array for each text column."""
    each = F.array(*[F.struct(F.lit(i).alias("v"), F.col(c).alias("t")) for i, c in enumerate(variants)])
    long = texts.select(*keys, F.explode(each).alias("e")).select(*keys, F.col("e.v").alias("v"), words(F.col("e.t")).alias("w"))
    long = long.select(*keys, "v", F.explode(pairs(F.col("w"))).alias("w"))
    counted = long.select(*keys, "v", F.xxhash64("w.a", "w.b").alias("term")).groupBy(*keys, "v", "term").agg(F.count(F.lit(1)).alias("n"))
    if piece:
        pieces = counted.select(*keys, "v", "term", "n", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / piece).cast("int"))).alias("j"))
        pieces = pieces.select(*keys, "v", F.xxhash64("term", "j").alias("piece"), F.least(F.lit(piece).cast("long"), F.col("n") - (F.col("j") - 1) * piece).alias("weight"))
    else:
        pieces = counted.withColumnsRenamed({"term": "piece", "n": "weight"})
    every = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))) if rounds > 1 else F.lit(0)
    pieces = pieces.withColumn("round", every)
    bin_of = F.pmod(F.xxhash64("piece", "round", F.lit("bin")), F.lit(bins)) + F.col("round") * bins
    drawn = pieces.select(*keys, "v", bin_of.alias("bin"), packed_draw(F.col("piece"), F.col("weight"), F.col("round")).alias("draw"))
    least = drawn.groupBy(*keys, "v", "bin").agg(F.min("draw").alias("draw"))
    entry = F.shiftleft(F.col("bin"), _SAMPLE_BITS).bitwiseOR(F.col("draw").bitwiseAND(F.lit((1 << _SAMPLE_BITS) - 1))).cast("int")
    mine = lambda i: F.sort_array(F.collect_list(F.when(F.col("v") == i, entry)))
    return least.groupBy(*keys).agg(*[mine(i).alias(f"f{i}") for i in range(len(variants))])


def fingerprint(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bins: int = 64, rounds: int = 1, piece: int | None = PIECE, partitions: int | None = None) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``entries`` (array of ints) and ``fingerprint`` (text).

    Null and empty texts have one term, the pair of their edges. Rows that are
    repeated and null ids keep their row; no rows give none; other columns are
    left out. Text is shuffled once; counting and drawing follow where the rows
    then are.
    """
    n = partitions or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(column(docs, doc_id).alias("doc_id"), F.coalesce(column(docs, text), F.lit("")).alias("t"))
    dealt = slim.withColumn("row", F.monotonically_increasing_id()).repartition(n, "row")
    prints = _fingerprints(dealt, ["row", "doc_id"], ["t"], bins, rounds, piece)
    return prints.select("doc_id", F.col("f0").alias("entries"), as_text(F.col("f0")).alias("fingerprint"))


def _head(text: Column) -> Column:
    """The first eight bytes of a text as 16 hexadecimal digits, which sort like the texts."""
    return F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 8)), 16, "0")


def _place(key: Column, head: Column) -> Column:
    """Text that sorts like the long, then like the head."""
    return F.concat(F.lpad(F.hex(key.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0"), head)


def _splits(keys: DataFrame, n: int) -> list[str]:
    """Places that part the rows (``k`` and ``t``) in about ``n`` ranges. A key with very many rows is parted by the heads of its texts.

    The driver holds ``n`` of them; texts are read only if a key is parted.
    """
    found = keys.agg(F.min("k"), F.percentile_approx("k", [i / n for i in range(n)], max(10_000, 50 * n))).first()
    if found[0] is None:
        return []
    parts = Counter([found[0], *(x for x in found[1] if x != found[0])]) | Counter(x for x in found[1] if x == found[0])
    out = {(k, "0" * 16) for k in parts}
    if hot := {k: c for k, c in parts.items() if c > 1}:
        most = max(hot.values())
        number = F.conv(_head(F.col("t")), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
        heads = keys.where(F.col("k").isin(*hot)).groupBy("k").agg(F.percentile_approx(number, [i / most for i in range(most)], max(10_000, 50 * most)).alias("h"))
        for r in heads.collect():  # a row for each such key, of which there are less than ``n``
            out |= {(r["k"], f"{r['h'][i * most // hot[r['k']]] + (1 << 63):016X}") for i in range(1, hot[r["k"]])}
    return [f"{k + (1 << 63):016X}{h}" for k, h in sorted(out)]


def _range_of(place: Column, splits: list[str]) -> Column:
    """How many splits after the first are not above ``place``: found among groups of splits, then in one group. A list is one constant."""
    size = max(1, int(len(splits) ** 0.5))
    constant = lambda x: F.split(F.lit(",".join(x)), ",")
    group = F.greatest(F.size(F.filter(constant(splits[::size]), lambda s: s <= place)), F.lit(1))
    own = F.slice(constant(splits), (group - 1) * size + 1, size)
    return (group - 1) * size + F.size(F.filter(own, lambda s: s <= place)) - 1


def edited_and_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bins: int = 64, rounds: int = 1, piece: int | None = PIECE, range_bytes: int = 1 << 20, most_ranges: int = 100_000) -> DataFrame:
    """Each text, its edited text and the next text: fingerprints and likenesses.

    In the edited text, the last floor(n / 4) of n code points are replaced by
    the first as many (or all) of the next document. The next document is the
    next by ascending id; after the last comes the first. Columns: ``doc_id``,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``.

    Documents are dealt to ranges of ids of about ``range_bytes`` of text (more
    if there were more than ``most_ranges``, as the driver holds their bounds). A
    range also gets the first document of the range after it, so that all
    neighbours meet there: text is shuffled once, nothing is sorted in one task.
    Rows of one id that are very many (a null id, for one) are parted by the
    first bytes of their texts.

    A null text is empty; a null id comes before all others; rows of one id go
    by their texts and are each other's neighbours; a document that is alone is
    its own next; no rows give none; other columns are left out.
    """
    spark = docs.sparkSession
    slim = docs.select(column(docs, doc_id).alias("doc_id"), F.coalesce(column(docs, text), F.lit("")).alias("t"))
    slim = slim.withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
    size = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bounds = _splits(slim, min(most_ranges, size // range_bytes) or 1) or [""]
    parted = any(not x.endswith("0" * 16) for x in bounds)
    place = _place(F.col("k"), _head(F.col("t")) if parted else F.lit("0" * 16))
    if parted:
        held = slim.select(_range_of(place, bounds).alias("own"), place.alias("place")).groupBy("own").agg(F.min("place").alias("place"))
        bounds = sorted(r["place"] for r in held.collect())  # a row a range
    home = F.struct(F.col("own").alias("range"), F.lit(0).alias("guest"))
    before = F.when(F.col("own") == 0, len(bounds) - 1).otherwise(F.col("own") - 1)
    first = F.element_at(F.split(F.lit(",".join(bounds)), ","), F.col("own") + 1) == place
    homes = F.when(first, F.array(home, F.struct(before.alias("range"), F.lit(1).alias("guest")))).otherwise(F.array(home))
    dealt = slim.withColumn("own", _range_of(place, bounds)).select("doc_id", "t", F.explode(homes).alias("h")).select("doc_id", "t", "h.*")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), "t")
    chain = dealt.repartition(max(least, min(len(bounds), 4 * least)), "range")
    chain = chain.withColumns({"row": F.row_number().over(order), "later": F.lead("t").over(order)})
    cut = F.floor(F.length("t") / 4).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), F.length("t") - cut), F.substring(F.coalesce("later", F.lit("")), F.lit(1), cut))
    chain = chain.select("range", "row", "guest", "doc_id", "t", F.when(F.col("guest") == 0, edited).otherwise(F.lit("")).alias("e"))
    prints = _fingerprints(chain, ["range", "row"], ["t", "e"], bins, rounds, piece)
    later = F.lead("f0").over(Window.partitionBy("range").orderBy("row"))
    prints = prints.withColumn("next", later).select("range", "row", "f0", "f1", likeness(F.col("f0"), F.col("f1")).alias("near_edited"), likeness(F.col("f0"), F.col("next")).alias("near_next"))
    facts = chain.where("guest = 0").select("range", "row", "doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"))
    return facts.join(prints, ["range", "row"]).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("f0")).alias("fingerprint"), as_text(F.col("f1")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
