"""Exact n-gram Jaccard join with token-combination prefixes.

Tokens are the word shingles of a text. All tokens have one global order: rare ones
first, then frequent ones, by hash within a class. Two sets that overlap in at least
``o`` tokens share their first common token within the first ``n - o + 1`` tokens of
each, and a second common one within one token more. So the index holds

* the token itself where it is rare,
* every pair (token, later token of the prefix extended by one) where it is frequent,

and each pair of sets that is similar enough meets at one key at least. Which tokens
count as frequent decides the work, never the result, because it is the same for all
sets. Long sets index frequent tokens alone (pairs would be too many); sets whose size
lies near that border do both, so that partners of either kind meet.

Rows that share a key are not paired with each other all at once: the first set of a
key is compared with the others, found links are merged, and only keys with several
components go on, with more leaders each round, until no pair is left to compare. There
the sets of a key's small components lead, so one large component is not gone through.
Sets with the smallest share of rare tokens lead: a text that many near copies were
made from has no tokens of its own, so it links them all in the first round.

A key stands for the first common token (or the first two), so no more than the tokens
from there on can be common. Pairs whose sizes ask for more are never made, and a set
leaves a key in which no set of another component is of a size that fits.

Only pairs that a bitmap of parities leaves possible are verified: every bit in which
two bitmaps differ needs an element that only one set has. Of those a set is first
verified against one partner; pairs that are in one component by then need no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources import discard
from .common import bit_filter, free_shuffles, marked, mixed, one_of_each, passes, row_key, shared, written
from .components import components
from .shingles import SHINGLE, shingle_sets, signed_sets, slices

SETS = "doc_id long, n int, sig long, bits binary"
INDEX = "key long, sig long, n int, tail int, rank long"
#: A token is frequent from this number of sets on, or more where they are too many to mark.
FREQUENT = 16
MOST_FREQUENT = 1 << 21
#: A task reports a token to the frequency count from this number of its own sets on.
LOCAL = 3
#: Tokens, and postings, that a task holds before it hands them on: 4 MB, and 1 MB of each column.
AT_ONCE, POSTINGS_AT_ONCE = 1 << 19, 1 << 17
#: Bits of the parity bitmap of a set: at least these, and as many as it has tokens.
LEAST_BITS = 512
#: Sets above this size index frequent tokens alone.
PAIRED_SIZE = 256


def _prefix(n: int, percent: int) -> int:
    """Length of the prefix: a partner shares ``percent`` of these n tokens at least."""
    return n - -(-percent * n // 100) + 1


def _parities(tokens: np.ndarray) -> bytes:
    """Per bit: is the number of tokens with that remainder odd?"""
    bits = max(LEAST_BITS, 1 << (len(tokens) - 1).bit_length() if len(tokens) else 0)
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 1)):
            found, sigs = signed_sets(part.column(1), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in found], pa.int32()),
                    pa.array(sigs),
                    pa.array([_parities(s) for s in found], pa.binary()),
                ],
                ["doc_id", "n", "sig", "bits"],
            )

    return run


def _distinct_sets(batch: pa.RecordBatch, k: int, seen: set[int]) -> Iterator[tuple[np.ndarray, int]]:
    """Each non-empty set of a batch that was not ``seen`` before."""
    for part in slices(batch, 1):
        sets, sigs = signed_sets(part.column(1), k)
        for tokens, sig in zip(sets, sigs.tolist()):
            if len(tokens) and sig not in seen:
                seen.add(sig)
                yield tokens, sig


def _common(k: int):
    def run(batches):
        sets, held, seen = [], 0, set()
        for batch in batches:
            for tokens, _ in _distinct_sets(batch, k, seen):
                sets.append(tokens)
                held += len(tokens)
                if held > AT_ONCE:
                    yield _counted(sets)
                    sets, held = [], 0
        if sets:
            yield _counted(sets)

    return run


def _counted(sets: list[np.ndarray]) -> pa.RecordBatch:
    tokens, n = np.unique(np.concatenate(sets), return_counts=True)
    keep = n >= LOCAL
    return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["token", "n"])


def frequent_tokens(texts: DataFrame, k: int) -> np.ndarray:
    """A bit filter of the tokens that many sets hold. ``texts``: id, text."""
    counted = texts.mapInArrow(_common(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = written(counted.where(F.col("n") >= FREQUENT), "tokens")
    sizes = counted.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("n")).collect()
    least, above = FREQUENT, 0
    for power, n in sorted(sizes, reverse=True):
        above += n
        if above > MOST_FREQUENT:
            least = 1 << (int(power) + 1)
            break
    bits = bit_filter(counted.where(F.col("n") >= least), "token")
    discard(counted)
    return bits


def _keys(tokens: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set, given which of its tokens are frequent, and how many tokens
    a partner can share at most if the key is where the two sets first meet."""
    order = np.concatenate([tokens[~often], tokens[often]])
    n, rare = len(order), int((~often).sum())
    p = _prefix(n, percent)
    at = np.arange(min(p, rare))
    parts, tails = [order[at]], [n - at]
    if rare < p:
        if n <= PAIRED_SIZE:
            extended = order[: min(n, p + 1)]
            i, j = np.triu_indices(len(extended), 1)
            keep = (i >= rare) & (i < p)
            i, j = i[keep], j[keep]
            parts.append(mixed(extended[i] * np.uint64(SHINGLE[5]) + extended[j] * np.uint64(SHINGLE[6])))
            tails.append(n - j + 1)
        if 100 * n > PAIRED_SIZE * percent:
            at = np.arange(rare, p)
            parts.append(order[at])
            tails.append(n - at)
    return np.concatenate(parts), np.concatenate(tails)


def _rank(rare: int, n: int, sig: int) -> int:
    """Order of leaders: the share of rare tokens, then the signature; 63 bits."""
    return (1000 * rare // n) << 53 | (sig & ((1 << 64) - 1)) >> 11


def _index(k: int, percent: int, often, wanted=None):
    """Rows of ``INDEX``; with ``wanted``, a bit filter, only keys that pass it."""

    def run(batches):
        marks, only, seen = often.value, wanted.value if wanted else None, set()
        for batch in batches:
            parts, held = [], 0
            for tokens, sig in _distinct_sets(batch, k, seen):
                frequent = passes(marks, tokens)
                own, tails = _keys(tokens, frequent, percent)
                if only is not None:
                    keep = passes(only, own)
                    own, tails = own[keep], tails[keep]
                parts.append((own, tails, sig, len(tokens), _rank(int((~frequent).sum()), len(tokens), sig)))
                held += len(own)
                if held > POSTINGS_AT_ONCE:
                    yield _rows(parts)
                    parts, held = [], 0
            if held:
                yield _rows(parts)

    return run


def _rows(parts) -> pa.RecordBatch:
    keys, tails, *of_set = zip(*parts)
    times = [len(own) for own in keys]
    sigs, sizes, ranks = (np.repeat(np.array(values, dtype=np.int64), times) for values in of_set)
    columns = {
        "key": np.concatenate(keys).view(np.int64), "sig": sigs, "n": sizes.astype(np.int32),
        "tail": np.concatenate(tails).astype(np.int32), "rank": ranks,
    }
    return pa.RecordBatch.from_pydict(columns)


def _key_counts(k: int, percent: int, often):
    index = _index(k, percent, often)

    def run(batches):
        for rows in index(batches):
            keys, n = np.unique(rows.column(0).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def _wanted_texts(k: int, wanted):
    """A text of each set whose signature passes a bit filter."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, 1):
                sets, sigs = signed_sets(part.column(1), k)
                keep = passes(wanted.value, sigs) & np.array([len(s) > 0 for s in sets], dtype=bool)
                for i in np.flatnonzero(keep):
                    keep[i] = (sig := int(sigs[i])) not in seen
                    seen.add(sig)
                yield pa.RecordBatch.from_arrays([pa.array(sigs), part.column(1)], ["sig", "text"]).filter(pa.array(keep))

    return run


def _texts_of_sets(texts: DataFrame, sigs: DataFrame, k: int) -> DataFrame:
    """``sig, text``, one row for each of ``sigs``, written once for all verifications.

    Rows that repeat a set are one row from here on, so that no pair is made of copies.
    Hashes cannot be compressed, so the text goes to disk and not its tokens, which
    are two to three times its size there and are made again for each pair.
    """
    wanted = shared(texts.sparkSession, bit_filter(sigs, "sig"))
    found = texts.mapInArrow(_wanted_texts(k, wanted), "sig long, text string").dropDuplicates(["sig"])
    out = written(found, "texts")
    wanted.destroy()
    return out


def _tokens_of_pairs(k: int, linked):
    """Hand pairs of texts to ``linked`` as pairs of token lists, a slice at a time."""

    def tokens(texts: pa.Array) -> pa.Array:
        found = texts.dictionary_encode()  # one leader has many partners
        sets = pa.array([s.tobytes() for s in shingle_sets(found.dictionary, k)], pa.binary())
        return sets.take(found.indices)

    def run(batches):
        return linked(
            pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *[tokens(part.column(c)) for c in ("left", "right")]], ["a", "b", "left", "right"])
            for batch in batches
            for part in slices(batch, "left")
        )

    return run


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("left"), batch.column("right"))):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _differing(one: bytes, other: bytes) -> int:
    """Bits in which two bitmaps differ; the halves of a longer one are folded together."""
    x, y = np.frombuffer(one, dtype=np.uint8), np.frombuffer(other, dtype=np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _possible(percent: int):
    """Pairs whose overlap can still be large enough, going by sizes and bitmaps."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                apart = np.array([_differing(x.as_py(), y.as_py()) for x, y in zip(batch.column("xa"), batch.column("xb"))])
                total = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
                most = (total - apart) // 2
                keep = 100 * most >= percent * (total - most)
                yield batch.select(["a", "b", "rank"]).filter(pa.array(keep))

    return run


def _verified(lists: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) of signatures that are similar enough."""
    sigs = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    # not an Arrow function: its workers would stand beside those that compare the pairs
    near = marked(lists, "sig", sigs, "sig").where("_maybe")
    left = near.select(F.col("sig").alias("a"), F.col("text").alias("left"))
    right = near.select(F.col("sig").alias("b"), F.col("text").alias("right"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return written(joined.mapInArrow(_tokens_of_pairs(k, _linked(percent)), "a long, b long").distinct(), "links")


def _with_partners(held: DataFrame, percent: int) -> DataFrame:
    """The postings that a set of another component may meet at their key.

    ``tail`` leaves room for partners up to some size. Sizes of a key are looked at
    instead of its sets: one row per key and size, so a hot key is aggregated first.
    """
    held = held.withColumn("room", F.expr(f"{100 + percent}L * tail div {percent} - n"))
    sizes = held.groupBy("key", "n").agg(F.max("room").alias("room"), F.min("root").alias("low"), F.max("root").alias("high"))
    reach = int(math.log(100 / percent) * 1_000_000) + 2  # rounded up: sizes just outside do no harm
    near = Window.partitionBy("key").orderBy(F.floor(F.ln("n") * 1_000_000)).rangeBetween(-reach, reach)
    bounds = {"least": F.min("n"), "most_room": F.max("room"), "lowest": F.min("low"), "highest": F.max("high")}
    sizes = sizes.select("key", "n", *[value.over(near).alias(name) for name, value in bounds.items()])
    sizes = sizes.where("lowest < highest and most_room >= n").select("key", "n", "least")
    return held.join(sizes, ["key", "n"]).where("room >= least").select("key", "sig", "n", "tail", "rank", "root")


def similar_links(texts: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``a, b`` between signatures of different sets that span every component.

    ``texts``: id, text. ``sets``: doc_id, n, sig of the same rows.
    """
    spark = texts.sparkSession
    often = shared(spark, frequent_tokens(texts, k))
    counts = texts.mapInArrow(_key_counts(k, percent, often), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    keys = written(counts.where("n > 1").select("key"), "keys")
    kept = shared(spark, bit_filter(keys, "key"))
    discard(keys)
    free_shuffles(spark)
    index = texts.mapInArrow(_index(k, percent, often, kept), INDEX)
    held = stored = written(index.groupBy("key", "sig").agg(*[F.max(c).alias(c) for c in ("n", "tail", "rank")]), "postings")
    for done in (often, kept):
        done.destroy()
    free_shuffles(spark)
    ids = written(sets.where("n > 0").groupBy("sig").agg(F.min("bits").alias("bits")), "ids")
    links, placed, leaders, lists = None, None, 1, None

    def merged(found: DataFrame):
        if links is None:
            return found, components(found)
        both = written(links.union(found), "links")
        discard(links, found, placed)
        return both, components(both)

    def replaced(older: DataFrame, newer: DataFrame) -> DataFrame:
        newer = written(newer, "postings")
        discard(older)
        return newer

    while True:
        if placed is not None:
            held = held.join(placed, held["sig"] == placed["node"], "left").select(
                "key", "sig", "n", "tail", "rank", F.coalesce("root", "sig").alias("root")
            )
        else:
            held = held.withColumn("root", F.col("sig"))
        held = _with_partners(held, percent)
        if leaders == 1:  # without a window, so that a hot key is aggregated before it moves
            held = stored = replaced(stored, held)
            free_shuffles(spark)
            lists = _texts_of_sets(texts, held.select("sig").distinct(), k)
            free_shuffles(spark)
            first = held.groupBy("key").agg(F.min_by("sig", "rank").alias("first"))
            held = stored = replaced(stored, held.join(first, "key"))
            held = held.withColumn("place", F.when(F.col("sig") == F.col("first"), 1).otherwise(2))
        else:
            # what is left to compare lies between components, so the small ones lead
            held = held.withColumn("of_root", F.count("*").over(Window.partitionBy("key", "root")))
            small_first = Window.partitionBy("key").orderBy("of_root", "rank", "sig")
            held = stored = replaced(stored, held.withColumn("place", F.row_number().over(small_first)).drop("of_root"))
        if held.isEmpty():
            break
        one, other = (
            held.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("sig", "n", "tail", "rank", "root", "place")])
            for side in "ab"
        )
        pairs = one.where(F.col("place_a") <= leaders).join(other, "key")
        pairs = pairs.where("place_a < place_b and root_a <> root_b")
        pairs = pairs.where(f"100L * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        pairs = pairs.where(f"{100 + percent}L * least(tail_a, tail_b) >= {percent}L * (n_a + n_b)")
        # one orientation of a pair, whichever of the two led
        ends = [f"struct(rank_{side} AS rank, sig_{side} AS sig, n_{side} AS n)" for side in "ab"]
        pairs = pairs.selectExpr(f"least({', '.join(ends)}) x", f"greatest({', '.join(ends)}) y")
        pairs = pairs.selectExpr("x.sig a", "y.sig b", "x.n na", "y.n nb", "x.rank rank").distinct()
        for side in ("a", "b"):
            pairs = pairs.join(ids.select(F.col("sig").alias(side), F.col("bits").alias(f"x{side}")), side)
        pairs = written(pairs.mapInArrow(_possible(percent), "a long, b long, rank long"), "pairs")
        # one partner for each set first; after that only what is still apart
        tried = written(pairs.groupBy("b").agg(F.min_by("a", "rank").alias("a")), "pairs")
        links, placed = merged(_verified(lists, tried, k, percent))
        free_shuffles(spark)
        left = pairs.select("a", "b").join(tried, ["a", "b"], "left_anti")
        for side in ("a", "b"):
            place = placed.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
            left = left.join(place, side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
        left = written(left.where("ra <> rb").select("a", "b"), "pairs")
        if not left.isEmpty():
            links, placed = merged(_verified(lists, left, k, percent))
        discard(pairs, tried, left)
        free_shuffles(spark)
        held = held.where(F.col("place") > leaders).select("key", "sig", "n", "tail", "rank")
        leaders *= 16
    discard(stored, lists, ids, links)
    return placed if placed is not None else spark.createDataFrame([], "node long, root long")


def near_duplicate_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``.

    Two rows link when their sets of ``k``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more; components are the closure of links, named by their
    smallest id. Rows of equal sets are one node. A row without words has an empty set
    and is alone: its component is its own id. Null texts count as empty; rows with a
    null id are linked too, and a component of such rows only has a null name. Repeated
    rows come out as often as they go in. Other columns of ``docs`` are ignored. Sets
    are told apart by a 64-bit signature and tokens by 64-bit hashes.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = written(texts.mapInArrow(_sets(k), SETS), "sets")
    placed = similar_links(texts, sets, k, percent)
    own = sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    own = own.join(placed, own["sig"] == placed["node"], "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    named = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(named, "root").select("sig", "component_id")
    full = sets.where("n > 0").join(named, "sig").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(alone)


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with all their columns, one for each component of similar texts.

    The row with the smallest id stays; rows without an id come last, and among rows of
    one id the one with the smallest hash stays. Rows are told apart by a 64-bit hash of
    all their columns, not by their id, so different texts under one id are different
    documents, and rows that are equal in every column are one. Rows without words are
    similar to nothing: all of them stay, repeated ones too.
    """
    keyed = docs.withColumn("_row", row_key(docs.columns))
    found = near_duplicate_components(keyed, "_row", text, k, percent).where("n_shingles > 0")
    counted = found.groupBy(F.col("doc_id").alias("_row"), "component_id").agg(F.count("*").alias("copies"))
    ids = keyed.select(F.col("_row").alias("of"), F.col(doc_id).cast("long").alias("id")).distinct()
    counted = written(counted.join(ids, F.col("_row") == F.col("of")), "rows")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("_row").alias("stays")))
    leaders = counted.groupBy(F.col("component_id").alias("component")).agg(first.alias("first"))
    placed = counted.join(leaders, F.col("component_id") == F.col("component"))
    placed = written(placed.select("_row", "copies", (F.col("first.stays") == F.col("_row")).alias("stays")), "rows")
    discard(counted)
    gone = placed.where("not stays").select("_row")
    repeated = placed.where("stays and copies > 1").select("_row")
    return one_of_each(keyed, gone, repeated, "_row").drop("_row")
