"""Near-duplicate documents by min-max hashing.

Under each permutation both the smallest and the largest hash of a document's shingle set are kept, which halves the
hash evaluations a signature of given length takes; matches of the minimum and of the maximum are each unbiased for the
Jaccard similarity and (nearly) uncorrelated. Bands of the signature propose candidates, the full sets decide.

Documents with equal sets form one class (its smallest id stands for it), so copies cost nothing further. In each
bucket of a few bands the members are compared with one hub, not with each other: whatever links to the hub is
connected. Buckets that still hold several components get an anchor each, mostly the same one for all buckets around
one text, and every member of theirs is compared with it, which gives the shingles by which it differs from the anchor.
If two members link and at least one isn't linked with the anchor (else the anchor connects them), their differences
must share more shingles than chance gives: |D1 & D2| >= (|D1| + |D2| - r * (n1 + n2)) / 2, with r = (1 - t) / (1 + t).
So only members of different components whose differences meet in their rarest shingles (a prefix filter) are compared.
That is exact for all members of an anchor, expands no group into all pairs, and leaves no bucket undecided.

Sets are confirmed as sets of 64-bit shingle hashes.

Nulls: a null text is empty; empty texts have no shingles and link with nothing. A null id gets no component and is
kept. Rows that share an id count as linked. An empty table gives an empty result. Other columns are passed over by
near_duplicates() and kept by one_of_each(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof.llm.common import batches_of, broadcast_if, give_back, hold, hold_fit, ship
from tableproof.llm.components import components

ship(__name__)


@dataclass(frozen=True)
class NearDupRules:
    #: Words of a shingle; with fewer words the whole sequence is one.
    width: int = 5
    #: Two documents link if 100 * intersection >= percent * union.
    percent: int = 80
    #: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 8) ** 60, about 1.6 in 100,000, while one
    #: of similarity 0.4, such as two texts around one common passage, shares one with about 4 in 100.
    bands: int = 60
    #: Permutations of a band; each gives two of its values.
    permutations: int = 4
    #: Sets up to this size have their own exact keys as well: links between them differ by one shingle on each side,
    #: or a set of ten by two from one of eight inside it.
    small: int = 10
    #: Bands whose hubs connect groups before what is left is settled by components' centres.
    first_bands: int = 4
    #: Rows that go to Python at once.
    batch_rows: int = 1_000
    #: Up to so many ids (8 bytes each) are broadcast to pick texts; more are joined by shuffle.
    broadcast_ids: int = 500_000

    @property
    def rows(self) -> int:
        return 2 * self.permutations


MIX = np.uint64(0x9E3779B97F4A7C15)


def _place(k: int) -> np.uint64:
    """A constant for the k-th word of a shingle."""
    return np.uint64((k + 1) * int(MIX) % 2**64)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads close ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case and no null; every other byte stays (arrow's own function alters some in slices)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    validity, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    chars = np.frombuffer(data, np.uint8)
    chars = chars + ((chars >= 65) & (chars <= 90)).view(np.uint8) * np.uint8(32)
    return pa.Array.from_buffers(texts.type, len(texts), [validity, offsets, pa.py_buffer(chars)], offset=texts.offset)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in turn, the texts' offsets in them, and which texts have none."""
    import xxhash

    clean = pc.ascii_trim(lower_ascii(texts), characters=" \t\n\v\f\r")
    lists = pc.ascii_split_whitespace(clean)
    codes = pc.dictionary_encode(lists.flatten())
    names = codes.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), dtype=np.uint64, count=len(names))
    hashes = table[codes.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, np.uint64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    blank = pc.equal(clean, "").to_numpy(zero_copy_only=False)
    return hashes, offsets, blank


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, offsets, blank = word_hashes(texts)
    rolled = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    if len(rolled):
        for k in range(width):
            rolled = _scramble(rolled + hashes[k : k + len(rolled)] + _place(k))
    for i in range(len(offsets) - 1):
        start, end = offsets[i], offsets[i + 1]
        if blank[i] or start == end:
            yield np.zeros(0, np.uint64)
        elif end - start < width:
            whole = np.zeros(1, np.uint64)
            for k, h in enumerate(hashes[start:end]):
                whole = _scramble(whole + h + _place(k))
            yield _scramble(whole + np.uint64(int(end - start)))
        else:
            yield np.unique(rolled[start : end - width + 1])


def _factors(rules: NearDupRules) -> np.ndarray:
    """Odd numbers: multiplying a hash by one, modulo 2 ** 64, permutes the hashes."""
    return _scramble(np.arange(1, rules.bands * rules.permutations + 1, dtype=np.uint64) * MIX) | np.uint64(1)


def band_keys(hashes: np.ndarray, factors: np.ndarray, rules: NearDupRules) -> np.ndarray:
    """One key a band: of the minima and maxima of the set under the band's permutations."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for at in range(0, len(hashes), 256):  # small enough for the processor's cache
        values = hashes[at : at + 256, None] * factors
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    keys = np.arange(1, rules.bands + 1, dtype=np.uint64) * MIX
    for p in range(rules.permutations):
        keys = _scramble(keys + low[p :: rules.permutations])
        keys = _scramble(keys ^ high[p :: rules.permutations])
    return keys.view(np.int64)


def small_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of a small set and of the set without each of its members: similar small sets share one of them.

    Sets of ten and more have keys without each two members, too.
    """
    scattered = _scramble(hashes ^ MIX)
    whole = scattered.sum(dtype=np.uint64)
    i, j = np.triu_indices(len(hashes) if len(hashes) >= 10 else 0, 1)
    return _scramble(np.concatenate([whole[None], whole - scattered, whole - scattered[i] - scattered[j]]) ^ np.uint64(0x5DEECE66D)).view(np.int64)


def portions(batch: pa.RecordBatch, column: str, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text (or one longer text)."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // chars
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def signatures(docs: DataFrame, rules: NearDupRules, id_column: str, text_column: str) -> DataFrame:
    """doc_id, n (set size), f1, f2 (fingerprint of the set), keys (one a band, more for small sets) for every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(rules)
        for batch in (part for whole in batches for part in portions(whole, "text")):
            n, f1, f2, keys = [], [], [], []
            for hashes in shingle_sets(batch.column("text"), rules.width):
                n.append(len(hashes))
                both = np.array([hashes.sum(dtype=np.uint64), _scramble(hashes ^ MIX).sum(dtype=np.uint64)], np.uint64).view(np.int64)
                f1.append(both[0])
                f2.append(both[1])
                bands = band_keys(hashes, factors, rules) if len(hashes) else np.zeros(0, np.int64)
                keys.append(np.concatenate([bands, small_keys(hashes)]) if 0 < len(hashes) <= rules.small else bands)
            lengths = np.cumsum([0, *(len(k) for k in keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))],
                names=["doc_id", "n", "f1", "f2", "keys"],
            )
        give_back()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n long, f1 long, f2 long, keys array<long>")


def similar_pairs(pairs: DataFrame, texts: DataFrame, rules: NearDupRules, *, salts: int = 64) -> DataFrame:
    """a, b, linked, n (size of b's set) and delta (shingles of one of both sets) for each pair (a, b).

    They are compared on the full sets of texts (id, text). A hub's text is dealt out over salts, so that the pairs of
    one hub meet in many tasks.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, "tb")):
            both = {}
            for side in ("ta", "tb"):
                encoded = pc.dictionary_encode(batch.column(side))  # a hub's text comes once for each of its pairs
                both[side] = (list(shingle_sets(encoded.dictionary, rules.width)), encoded.indices.to_pylist())
            linked, sizes, deltas = [], [], []
            for i, j in zip(both["ta"][1], both["tb"][1], strict=True):
                x, y = both["ta"][0][i], both["tb"][0][j]
                delta = np.setxor1d(x, y, assume_unique=True)
                linked.append((100 + rules.percent) * len(delta) <= (100 - rules.percent) * (len(x) + len(y)))
                sizes.append(len(y))
                deltas.append(delta.view(np.int64))
            offsets = pa.array(np.cumsum([0, *(len(d) for d in deltas)]).astype(np.int32))
            delta = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(deltas) if deltas else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()), delta], names=["a", "b", "linked", "n", "delta"])
        give_back()

    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    hubs = salted.select("a", "salt").distinct().join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    spokes = salted.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return spokes.join(hubs, ["a", "salt"]).select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long, linked boolean, n long, delta array<long>")


def _fits(x: str, y: str, rules: NearDupRules):
    return 100 * F.least(x, y) >= rules.percent * F.greatest(x, y)


def class_components(classes: DataFrame, docs: DataFrame, rules: NearDupRules, id_column: str, text_column: str) -> DataFrame:
    """node (a class's representative), component for the classes that link with another. classes (held): rep, n, keys."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    members = classes.select(F.col("rep").alias("id"), "n", F.posexplode("keys").alias("band", "key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("id", "n")).alias("hub")).where(F.col("members") > 1)
    # buckets of one class can't propose anything; the others are few and held for what follows
    crowded = hold_fit(members.join(sizes, "key").select("key", "band", "id", "n", "members", F.col("hub.id").alias("id2"), F.col("hub.n").alias("n2")))
    pairs = crowded.where((F.col("band") < rules.first_bands) & (F.col("id") != F.col("id2")) & _fits("n", "n2", rules)).select(F.col("id2").alias("a"), F.col("id").alias("b")).distinct()
    linked = hold_fit(_verify(pairs, texts, rules).where("linked").select("a", "b"))
    more = _open_links(crowded.select("key", "id", "n", "members"), linked, texts, rules)
    return hold_fit(components(linked.unionByName(more)))


def _placed(rows: DataFrame, found: DataFrame, id_column: str = "id") -> DataFrame:
    """rows with the component of id_column; what links with nothing is a component of its own."""
    return rows.join(found.withColumnRenamed("node", id_column), id_column, "left").withColumn("component", F.coalesce("component", id_column))


def _anchored(crowded: DataFrame, found: DataFrame) -> DataFrame:
    """a, b: each class b of a bucket that holds several components, with the bucket's anchor a.

    A component's anchor is its member with most bucket mates; a bucket takes the anchor of its largest component, so
    buckets around one text nearly always share one.
    """
    nodes = _placed(crowded.groupBy("id").agg(F.sum("members").alias("mates")), found)
    chosen = nodes.groupBy("component").agg(F.max(F.struct("mates", F.col("id"))).alias("best"), F.count(F.lit(1)).alias("weight"))
    known = hold_fit(nodes.join(chosen, "component").select("id", "component", F.struct("weight", F.col("best.mates").alias("mates"), F.col("best.id").alias("a")).alias("anchor")))
    placed = crowded.select("key", "id").join(known, "id")
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("anchor").alias("anchor")).where(F.col("low") != F.col("high"))
    return crowded.select("key", F.col("id").alias("b")).join(several.select("key", F.col("anchor.a").alias("a")), "key").select("a", "b").where(F.col("a") != F.col("b")).distinct()


def _open_links(crowded: DataFrame, linked: DataFrame, texts: DataFrame, rules: NearDupRules) -> DataFrame:
    """a, b: links that join components of linked, for all buckets that hold several of them."""
    met = hold_fit(_verify(_anchored(crowded, hold_fit(components(linked))), texts, rules), 20_000)
    to_anchor = met.where("linked").select("a", "b")
    found = hold_fit(components(linked.unionByName(to_anchor)))
    members = hold_fit(_placed(met, found, "b").select("a", "b", "component", "linked", "n", F.size("delta").cast("long").alias("s"), "delta"), 20_000)
    pairs = _delta_pairs(members, rules)
    return to_anchor.unionByName(_verify(pairs, texts, rules).where("linked").select("a", "b"))


def _delta_pairs(members: DataFrame, rules: NearDupRules) -> DataFrame:
    """a, b: members of one anchor and different components that may link: their differences meet in a prefix.

    members: a (the anchor), b, component, linked (b with a), n (size of b's set), s and delta (how it differs from a's).
    A member's differences are ordered so that those come first that no two components share, then rare ones; of two
    sets with i elements in common, the first |D| - i + 1 of each in one order have one in common.
    """
    # all numbers times 2 * (100 + percent), so that they are whole
    unit, r = 100 + rules.percent, 100 - rules.percent
    each = members.select("a", "component", F.explode("delta").alias("e"))
    uses = each.groupBy("a", "e").agg(F.count(F.lit(1)).alias("uses"), F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") != F.col("high")).select("a", "e", "uses")
    met = members.select("a", "b", F.explode("delta").alias("e")).join(uses, ["a", "e"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("uses", "e"))).alias("met"))
    ranked = members.drop("delta").join(met, ["a", "b"])
    # the least overlap with any partner: one linked with the anchor (a set of n - s at least) has partners that aren't;
    # a partner of any other is at most n * 100 / percent large, and no closer to the anchor than the triangle allows
    triangle = 2 * unit * F.col("s") - 2 * r * F.col("n") - F.ceil(200 * r * F.col("n") / rules.percent)
    least = F.greatest(F.when(F.col("linked"), (unit - r) * F.col("s")).otherwise(triangle), F.lit(0))
    listed = ranked.withColumn("least", least).withColumn("lead", F.col("s") - F.size("met")).select("a", "b", "component", "n", "s", "least", "lead", F.posexplode("met").alias("i", "at"))
    heads = listed.select("a", F.col("at.e").alias("e"), "b", "component", "n", "s", "least", (F.col("lead") + F.col("i")).alias("place")).where(2 * unit * (F.col("s") - F.col("place")) >= F.col("least")).drop("least")
    heads = hold_fit(heads)
    other = heads.select("a", "e", *[F.col(c).alias(c + "2") for c in ("b", "component", "n", "s", "place")])
    overlap = unit * (F.col("s") + F.col("s2")) - r * (F.col("n") + F.col("n2"))
    room = 2 * unit * F.least(F.col("s") - F.col("place"), F.col("s2") - F.col("place2"))
    close = (F.col("b") < F.col("b2")) & (F.col("component") != F.col("component2")) & _fits("n", "n2", rules) & (room >= overlap)
    return heads.join(other, ["a", "e"]).where(close).select(F.col("b").alias("x"), F.col("b2").alias("y")).distinct().toDF("a", "b")


def _verify(pairs: DataFrame, texts: DataFrame, rules: NearDupRules) -> DataFrame:
    """pairs compared; only texts that some pair needs are shuffled, one row an id."""
    pairs = hold_fit(pairs)
    needed = hold_fit(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    wanted = hold_fit(texts.join(broadcast_if(needed, rules.broadcast_ids), "id", "left_semi").dropDuplicates(["id"]), 20_000)
    return similar_pairs(pairs, wanted, rules)


def near_duplicates(docs: DataFrame, rules: NearDupRules = NearDupRules(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    with batches_of(docs.sparkSession, rules.batch_rows):  # all that runs Python runs in here
        return _near_duplicates(docs, rules, id_column, text_column)


def _near_duplicates(docs: DataFrame, rules: NearDupRules, id_column: str, text_column: str) -> DataFrame:
    signed = hold(signatures(docs, rules, id_column, text_column))
    full = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "keys")).alias("first"), F.count(F.lit(1)).alias("rows"))
    classes = hold(classes.select("f1", "f2", "n", F.col("first.doc_id").alias("rep"), F.col("first.keys").alias("keys")))
    found = class_components(classes.select("rep", "n", "keys"), docs, rules, id_column, text_column)
    placed = classes.select("f1", "f2", "n", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component_id"))
    rows = signed.select("doc_id", "n", "f1", "f2").join(placed, ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, rules: NearDupRules = NearDupRules(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs with one document of each group: those that aren't its smallest id go."""
    judged = near_duplicates(docs, rules, id_column=id_column, text_column=text_column)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias(id_column)).distinct()
    return docs.join(broadcast_if(hold(gone), rules.broadcast_ids), id_column, "left_anti")
