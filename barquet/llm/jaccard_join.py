"""Jaccard join of word-shingle sets, size-aware: light sets by subsets, heavy by lists.

Two documents link when den * |A n B| >= num * |A u B|. For sizes s <= t that is an overlap
of at least o(s, t) = ceil(num (s + t) / (num + den)).

Equal sets are one class, represented by its smallest doc_id; only classes are compared.

* Light sets (size up to a boundary) enumerate their subsets of size o(s, t), tagged with
  (s, t), for every size t that can link. Two light sets meet in a tag exactly when they
  link, so a bucket that has a set of the smaller size is linked by a star to its least
  member: no pairs, no verification.
* Heavy sets enter inverted lists. All sets share one order of shingles, frequent ones last,
  and a set of size n enters the lists of its first n - ceil(num n / den) + 1 shingles only:
  linked sets share one of these. Light sets large enough to link a heavy one enter too.
* The boundary is the size with the least cost: subsets of all light sets plus list entries of
  all heavy ones times the mean length of a list, both from counts.

Large groups of near copies would fill lists with pairs. So hubs are tried first: sets with
an equal min-hash band are compared with the set of the band which shares bands with most
others, one set move each. That decides whether they link, and leaves each set's few differences from
its hub, taken anew from the majority of the hub's sets. Two sets x, y of a hub differ in
|Dx| + |Dy| - 2 |Dx n Dy| shingles. With w = (num + den) |D| - (den - num) n they link without a
common difference exactly when w(x) + w(y) <= 0, and then both link with the set of the least
w: a star. All other links of a hub's sets share differences, which are few and mostly rare, and are found by the
prefixes of their lists. The pairs of a hub are thus decided without listing them.

The lists of shingles are then scanned for pairs of different components and hubs alone (lists
within one component are dropped by a map-side minimum and maximum). A pair from the lists goes on if the
shingles it shares within the prefixes for its o(s, t), plus what can follow the last of them, reach o(s, t). All that
remain are verified: first a few pairs of each component, then more, then all that still lie in different
ones. Most do not link, and prints, about a byte a shingle, bound the overlap from above: only pairs that
these cannot refute are verified on the whole sets. Hubs save work; the lists decide what links.

Which shingles count as frequent is estimated from the sets of every sixteenth text (by its
hash); this only orders shingles, and any order gives the same links. The frequent ones travel to
all tasks: the cut-off doubles until at most `FREQUENT` are left.

Defined cases: null text, or text without words, has an empty set and links with nothing; with
fewer words than a shingle the whole sequence is one shingle; rows that share a doc_id share its
component; a row without doc_id has none; repeated rows are repeated in the result; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import WordHashes, checked_broadcast, lower_words, mixed, shingle_hashes
from barquet.llm.components import components, extended
from barquet.llm.tokens import forget
from barquet.session import materialize

LARGEST_LIGHT = 14
FREQUENT = 2_000_000
SAMPLED = 16
BANDS, BAND_ROWS = 6, 3
HUB_SHARE = 64
HUB_COPIES = 4096
# Partners of a node in one row, and such rows that one copy of its text meets.
PARTNERS = 256
ROWS_A_COPY = 16
# Bytes of partners that may be broadcast, at 64 a partner; beyond that the texts are shuffled to them.
WANTED_BYTES = 128 << 20
# Bytes of the bit map of lists, which every task gets.
MARK_BYTES = 16 << 20
# Pairs of a component tried in each round of verification; the last round takes all.
TRIES = (4, 16)

_hashes = WordHashes()
_SEEDS = np.random.default_rng(20240101).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)


def overlap(s: int, t: int, num: int, den: int) -> int:
    return -(-num * (s + t) // (num + den))


def prefix_length(n, num: int, den: int):
    return n + (-num * n) // den + 1


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    return np.unique(shingle_hashes(_hashes(lower_words(text)), size))


def subset_tags(n: int, boundary: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(s, t, o) of all size pairs with n in which different light sets can link."""
    out = []
    for m in range(1, boundary + 1):
        s, t = min(n, m), max(n, m)
        o = overlap(s, t, num, den)
        if o <= s and not (s == t == o):
            out.append((s, t, o))
    return out


def subset_count(n: int, boundary: int, num: int, den: int) -> int:
    return sum(comb(n, o) for _, _, o in subset_tags(n, boundary, num, den))


def choose_boundary(sizes: dict[int, int], entries_beyond: float, list_length: float, num: int, den: int) -> int:
    """The light size with the least cost. `sizes`: classes of each size up to
    LARGEST_LIGHT; `entries_beyond`: list entries of all larger ones."""

    def cost(boundary: int) -> float:
        light = sum(c * subset_count(n, boundary, num, den) for n, c in sizes.items() if n <= boundary)
        heavy = sum(c * prefix_length(n, num, den) for n, c in sizes.items() if n > boundary)
        return light + (heavy + entries_beyond) * max(list_length, 1.0)

    return min(range(1, LARGEST_LIGHT + 1), key=lambda b: (cost(b), b))


def _bands(tokens: np.ndarray) -> np.ndarray:
    least = np.empty(len(_SEEDS), np.uint64)
    for k, seed in enumerate(_SEEDS):
        with np.errstate(over="ignore"):
            x = tokens * seed
            least[k] = (x ^ (x >> np.uint64(29))).min()
    keys = [xxhash.xxh64_intdigest(row.tobytes(), seed=k) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, np.uint64)


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64) if len(values) else [], pa.int64())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.array([], np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def print_bits(n: int) -> int:
    """First bits of a hash that a print of n shingles keeps: two shingles agree in them by chance
    once in 32 n pairs or less."""
    return n.bit_length() + 5


def set_print(tokens: np.ndarray) -> bytes:
    """The first bits of a sorted set's hashes as differences, 255 standing for 255 and going on."""
    if not len(tokens):
        return b""
    gaps = np.diff(tokens >> np.uint64(64 - print_bits(len(tokens))), prepend=np.uint64(0)).astype(np.int64)
    ends = np.cumsum(gaps // 255 + 1) - 1
    out = np.full(ends[-1] + 1, 255, np.uint8)
    out[ends] = gaps % 255
    return out.tobytes()


def most_shared(raw: bytes, other: bytes) -> tuple[int, int, int]:
    """Sizes of two sets and the most shingles they can share, from their prints."""
    sides = []
    for data in (raw, other):
        steps = np.frombuffer(data, np.uint8)
        sides.append(np.cumsum(steps, dtype=np.int64)[steps != 255])
    n, m = map(len, sides)
    bits = min(print_bits(n), print_bits(m))
    x, y = (side >> (print_bits(len(side)) - bits) for side in sides)
    # A shared shingle has its first bits on both sides.
    return n, m, min(int(np.isin(x, y).sum()), int(np.isin(y, x).sum()))


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh128_digest(tokens.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def _sample(docs: DataFrame, size: int) -> DataFrame:
    """Digest and set of every sixteenth text, equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sets = [shingle_set(t.as_py(), size) for t in batch.column("text")]
            digests = [_digest(x) for x in sets]
            yield pa.record_batch([_longs([d[0] for d in digests]), _longs([d[1] for d in digests]), _lists(sets)],
                                  names=["hi", "lo", "sampled"])

    chosen = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text")
    return chosen.mapInArrow(run, "hi long, lo long, sampled array<long>").groupBy("hi", "lo").agg(
        F.first("sampled").alias("sampled")
    )


def _frequent(sampled: DataFrame, at_most: int = FREQUENT) -> tuple[np.ndarray, float]:
    """Shingles seen often among sampled sets (sorted), and the mean length of a list."""
    counts = materialize(
        sampled.select(F.explode("sampled").alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "counts"
    )
    got = counts.agg(F.sum(F.col("c") * F.col("c")), F.sum("c")).first()
    length = SAMPLED * got[0] / got[1] if got[1] else 1.0
    least = 2
    while counts.filter(F.col("c") >= least).count() > at_most:
        least *= 2
    rows = counts.filter(F.col("c") >= least).select("h").toArrow()["h"].to_numpy()
    return np.sort(rows.astype(np.int64).view(np.uint64)), length


def _sketches(docs: DataFrame, size: int, frequent: np.ndarray, num: int, den: int) -> DataFrame:
    """doc_id, n, 128-bit digest, prefix shingles in order, bands and print of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.array([], np.uint64)
        forget()
        for batch in batches:
            n, digests, prefixes, bands, prints = [], [], [], [], []
            for text in batch.column("text"):
                tokens = shingle_set(text.as_py(), size)
                n.append(len(tokens))
                digests.append(_digest(tokens))
                prints.append(set_print(tokens))
                if not len(tokens):
                    prefixes.append(nothing)
                    bands.append(nothing)
                    continue
                order = mixed(tokens) >> np.uint64(1)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                    order |= (frequent[at] == tokens).astype(np.uint64) << np.uint64(63)
                length = prefix_length(len(tokens), num, den)
                first = np.argpartition(order, length - 1)[:length]
                prefixes.append(tokens[first[np.argsort(order[first])]])
                bands.append(_bands(tokens))
            yield pa.record_batch(
                [batch.column("doc_id"), _longs(n), _longs([d[0] for d in digests]), _longs([d[1] for d in digests]),
                 _lists(prefixes), _lists(bands), pa.array(prints, pa.binary())],
                names=["doc_id", "n", "hi", "lo", "prefix", "bands", "print"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, hi long, lo long, prefix array<long>, bands array<long>, print binary")


def _light_links(light: DataFrame, docs: DataFrame, size: int, boundary: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among light classes. light: node of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, low, ids, sizes = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                tokens = shingle_set(text.as_py(), size).tolist()
                if not 0 < len(tokens) <= boundary:
                    continue
                for s, t, o in subset_tags(len(tokens), boundary, num, den):
                    for subset in itertools.combinations(tokens, o):
                        data = np.array((s, t, *subset), np.uint64).tobytes()
                        keys.append(xxhash.xxh128_hexdigest(data))
                        low.append(s)
                        ids.append(doc_id.as_py())
                        sizes.append(len(tokens))
            yield pa.record_batch([pa.array(keys, pa.string()), _longs(low), _longs(ids), _longs(sizes)],
                                  names=["key", "low", "node", "n"])

    signed = materialize(
        docs.join(checked_broadcast(light), docs.doc_id == light.node, "left_semi").mapInArrow(
            run, "key string, low long, node long, n long"
        ), "subsets",
    )
    hubs = signed.groupBy("key").agg(
        F.min("node").alias("hub"), F.max("node").alias("last"), F.min("n").alias("least"), F.first("low").alias("low")
    ).filter("hub <> last and least = low").select("key", "hub")
    return signed.join(hubs, "key").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def _brought(docs: DataFrame, pairs: DataFrame, payload: Callable[[object], bytes]) -> DataFrame:
    """For stored pairs (a, b) what `payload` makes of their texts, side by side: rows of one (hub, salt) follow
    each other, those of b (role 0) first. That of a goes to b; a b with many partners is copied to several
    tasks, one for each HUB_SHARE of them, HUB_COPIES at most; each streams its share."""
    shares = pairs.groupBy("b").agg(F.least(F.ceil(F.count("*") / HUB_SHARE), F.lit(HUB_COPIES).cast("long")).alias("k"))
    salted = pairs.join(shares, "b").select(
        F.col("a").alias("node"), F.struct(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("k")).alias("salt"), F.lit(1).alias("role")).alias("to")
    )
    hubs = shares.select(
        F.col("b").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("salt")
    ).select("node", F.struct(F.col("node").alias("hub"), "salt", F.lit(0).alias("role")).alias("to"))
    flat = materialize(salted.unionByName(hubs), "wanted")
    # A node's partners are dealt over rows of about PARTNERS.
    hot = materialize(
        flat.groupBy("node").agg(F.ceil(F.count("*") / PARTNERS).alias("parts")).filter("parts > 1"), "hot"
    )
    part = F.pmod(F.xxhash64("to"), F.coalesce("parts", F.lit(1).cast("long")))
    wanted = flat.join(checked_broadcast(hot), "node", "left").groupBy("node", part.alias("part")).agg(
        F.collect_list("to").alias("to")
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                node = batch.column("doc_id")[k].as_py()
                raw = payload(batch.column("text")[k].as_py())
                to = batch.column("to")[k].as_py()
                for at in range(0, len(to), 256):
                    part = to[at : at + 256]
                    yield pa.record_batch(
                        [_longs([x["hub"] for x in part]), _longs([x["salt"] for x in part]),
                         pa.array([x["role"] for x in part], pa.int32()), _longs([node] * len(part)),
                         pa.array([raw] * len(part), pa.binary())],
                        names=["hub", "salt", "role", "node", "tokens"],
                    )

    # A partner is a struct of three numbers in an array, a node at least one row.
    if flat.count() * 64 <= WANTED_BYTES:
        texts = docs.join(F.broadcast(wanted), docs.doc_id == wanted.node)
    else:
        # Only ids are broadcast; partners meet the texts by shuffle, a node with many of them in several copies.
        wanted = wanted.withColumn("copy", F.floor(F.col("part") / ROWS_A_COPY))
        ids = materialize(
            flat.join(checked_broadcast(hot), "node", "left").select(
                F.col("node").alias("id"), F.ceil(F.coalesce("parts", F.lit(1).cast("long")) / ROWS_A_COPY).alias("copies")
            ).distinct(), "ids",
        )
        copies = docs.join(checked_broadcast(ids), docs.doc_id == ids.id).select(
            "doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy_of")
        )
        texts = copies.join(wanted.hint("shuffle_merge"), (copies.doc_id == wanted.node) & (copies.copy_of == wanted["copy"]))
    sent = texts.select("doc_id", "text", "to").mapInArrow(
        send, "hub long, salt long, role int, node long, tokens binary"
    )
    return sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")


def compared(docs: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Of stored pairs (a, b): linked, the sizes n and hub_n of both sets, and where a and b
    differ in at most half of a's size, the difference: shingles of a alone (negative), then
    of b alone."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, nothing = None, [], np.array([], np.uint64)
        for batch in batches:
            a, b, linked, n, hub_n, differences = [], [], [], [], [], []
            columns = [batch.column(c) for c in ("hub", "salt", "role", "node", "tokens")]
            for hub, salt, role, node, raw in zip(*columns):
                hub, role = hub.as_py(), role.as_py()
                tokens = np.frombuffer(raw.as_py(), np.uint64)
                if (hub, salt.as_py()) != key:
                    key, held = (hub, salt.as_py()), []
                if role == 0:
                    held.append(tokens)
                    continue
                for other in held:
                    own = tokens[np.isin(tokens, other, assume_unique=True, invert=True)]
                    both = len(tokens) - len(own)
                    a.append(node.as_py())
                    b.append(hub)
                    linked.append(both > 0 and den * both >= num * (len(other) + len(tokens) - both))
                    n.append(len(tokens))
                    hub_n.append(len(other))
                    # Several rows with the hub's doc_id are no one centre.
                    if len(held) > 1 or 2 * (len(own) + len(other) - both) > len(tokens):
                        differences.append(nothing)
                        continue
                    lost = other[np.isin(other, tokens, assume_unique=True, invert=True)]
                    differences.append(np.concatenate([(own >> np.uint64(1)) | np.uint64(1 << 63), lost >> np.uint64(1)]))
            yield pa.record_batch(
                [_longs(a), _longs(b), pa.array(linked, pa.bool_()), _longs(n), _longs(hub_n), _lists(differences)],
                names=["a", "b", "linked", "n", "hub_n", "difference"],
            )

    return _brought(docs, pairs, lambda text: shingle_set(text, size).tobytes()).mapInArrow(
        check, "a long, b long, linked boolean, n long, hub_n long, difference array<long>"
    )


def possible(prints: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of stored pairs (a, b) those that the prints of both sets cannot refute. prints: doc_id, print."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            a, b = [], []
            columns = [batch.column(c) for c in ("hub", "salt", "role", "node", "tokens")]
            for hub, salt, role, node, raw in zip(*columns):
                hub, raw = hub.as_py(), raw.as_py()
                if (hub, salt.as_py()) != key:
                    key, held = (hub, salt.as_py()), []
                if role.as_py() == 0:
                    held.append(raw)
                    continue
                for other in held:
                    n, m, both = most_shared(raw, other)
                    if den * both >= num * (n + m - both):
                        a.append(node.as_py())
                        b.append(hub)
                        break
            yield pa.record_batch([_longs(a), _longs(b)], names=["a", "b"])

    # Rows with one doc_id may be several sets; a pair is kept once.
    rows = prints.select("doc_id", F.col("print").alias("text"))
    return _brought(rows, pairs, bytes).mapInArrow(check, "a long, b long").distinct()


def verified(docs: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Of stored pairs (a, b) those that link."""
    return compared(docs, pairs, size, num, den).filter("linked").select("a", "b")


def hub_members(tried: DataFrame, num: int, den: int) -> DataFrame:
    """hub, node, w and difference (sorted, from the hub's majority) of each set whose
    difference from its hub is known, and of the hubs themselves."""
    known = tried.filter("size(difference) > 0")
    rows = known.select(F.col("b").alias("hub"), F.col("a").alias("node"), "n", "difference")
    hubs = known.groupBy(F.col("b").alias("hub")).agg(F.first("hub_n").alias("n"), (F.count("*") + 1).alias("members"))
    rows = rows.unionByName(hubs.select("hub", F.col("hub").alias("node"), "n", F.array().cast("array<bigint>").alias("difference")))
    usual = (
        rows.select("hub", F.explode("difference").alias("h")).groupBy("hub", "h").agg(F.count("*").alias("c"))
        .join(hubs, "hub").filter(2 * F.col("c") > F.col("members"))
        .groupBy("hub").agg(F.collect_list("h").alias("usual"))
    )
    rows = rows.join(usual, "hub", "left").withColumn("usual", F.coalesce("usual", F.array().cast("array<bigint>")))
    moved = F.sort_array(F.concat(F.array_except("difference", "usual"), F.array_except("usual", "difference")))
    return rows.select("hub", "node", "n", moved.alias("difference")).withColumn(
        "w", (num + den) * F.size("difference").cast("long") - (den - num) * F.col("n")
    )


def hub_stars(members: DataFrame) -> DataFrame:
    """Links (a, b) of all sets of a hub that link without a common difference."""
    least = members.groupBy("hub").agg(F.min(F.struct("w", "node")).alias("z"))
    return members.join(least, "hub").filter((F.col("w") + F.col("z.w") <= 0) & (F.col("node") != F.col("z.node"))).select(
        F.col("node").alias("a"), F.col("z.node").alias("b")
    )


def hub_links(members: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """All other links (a, b) among the sets of a hub that join two components."""
    entries = _labelled(members, found).select(
        "hub", "node", "component", "w", F.size("difference").alias("d"), F.posexplode("difference").alias("at", "h")
    )
    lists = entries.groupBy("hub", "h").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1")
    used = materialize(entries.join(lists.select("hub", "h"), ["hub", "h"], "left_semi"), "differences")
    sides = [used.select("hub", "h", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "component", "w", "d", "at"))) for k in "ab"]
    # Twice (num + den) times the differences two sets must share to link.
    need = F.col("w_a") + F.col("w_b")
    met = sides[0].join(sides[1], ["hub", "h"]).filter(
        (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
        & (2 * (num + den) * (F.col("d_a") - F.col("at_a")) >= need) & (2 * (num + den) * (F.col("d_b") - F.col("at_b")) >= need)
    ).select("hub", "node_a", "node_b").distinct()
    own = [members.select("hub", F.col("node").alias(f"node_{k}"), F.col("difference").alias(f"difference_{k}"), F.col("w").alias(f"w_{k}")) for k in "ab"]
    shared = F.size(F.array_intersect("difference_a", "difference_b"))
    return met.join(own[0], ["hub", "node_a"]).join(own[1], ["hub", "node_b"]).filter(2 * (num + den) * shared >= need).select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b")
    )


def _labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with the component of each, its own where it has no link."""
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def hub_pairs(bands: DataFrame, found: DataFrame) -> DataFrame:
    """One pair (a, b) for each node in a band with another component's hub. bands: node,
    band, and score, the nodes that share a band with it; the best score makes a hub."""
    rows = _labelled(bands, found)
    hubs = rows.groupBy("band").agg(
        F.max(F.struct("score", F.xxhash64("node"), "node", "component")).alias("h"),
        F.min("component").alias("c0"), F.max("component").alias("c1"),
    ).filter("c0 <> c1").select("band", F.col("h.score").alias("hub_score"), F.col("h.node").alias("b"), F.col("h.component").alias("cb"))
    return rows.join(hubs, "band").filter("component <> cb").groupBy(F.col("node").alias("a")).agg(
        F.max_by("b", F.struct("hub_score", F.xxhash64("b"))).alias("b")
    )


def next_pairs(pairs: DataFrame, found: DataFrame, tries: int | None) -> DataFrame:
    """Of `pairs` those still of different components, at most `tries` for each of them."""
    a = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    rows = pairs.join(a, "a", "left").join(b, "b", "left").select(
        "a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")
    ).filter("ca <> cb")
    if tries is None:
        return rows.select("a", "b")
    # Of each component (the younger one of a pair) the pair with the least hash in each slot,
    # reduced before any exchange.
    slot = F.pmod(F.xxhash64("a", "b"), F.lit(tries))
    return rows.groupBy(F.greatest("ca", "cb").alias("c"), slot.alias("slot")).agg(
        F.min(F.struct(F.xxhash64("b", "a"), "a", "b")).alias("p")
    ).select("p.a", "p.b")


def list_marks(lists: DataFrame, at_most: int = MARK_BYTES) -> tuple[int, np.ndarray]:
    """(k, words): a bit for the first k bits of each h of `lists`, 16 or more for each of them up to `at_most` bytes."""
    k = min(max(16 * lists.count(), 64).bit_length(), (8 * at_most).bit_length() - 1)
    slot = F.shiftrightunsigned("h", 64 - k)
    rows = lists.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(h, {64 - k}) & 63 as int)))").alias("bits")
    ).toArrow()
    words = np.zeros(1 << (k - 6), np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return k, words


def marked_entries(nodes: DataFrame, k: int, words: np.ndarray) -> DataFrame:
    """Entries (h, at and the other columns of `nodes`) of the prefixes' shingles whose bit is set."""
    names = [c for c in nodes.columns if c != "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            flat, lengths = prefix.flatten().to_numpy(zero_copy_only=False), prefix.value_lengths().to_numpy(zero_copy_only=False)
            slot = flat.view(np.uint64) >> np.uint64(64 - k)
            kept = np.flatnonzero((words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
            row = np.repeat(np.arange(len(lengths)), lengths)[kept]
            start = np.cumsum(lengths, dtype=np.int64) - lengths
            own = batch.select(names).take(pa.array(row))
            yield pa.record_batch(
                [*own.columns, pa.array((kept - start[row]).astype(np.int32)), _longs(flat[kept])], names=[*names, "at", "h"]
            )

    kinds = dict(nodes.dtypes)
    return nodes.select(*names, "prefix").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names), "at int", "h long"]))


def list_pairs(
    sketches: DataFrame, found: DataFrame, hubs: DataFrame, boundary: int, num: int, den: int
) -> DataFrame:
    """Pairs (a, b) of different components and hubs whose prefixes leave a link possible.
    hubs: node and hub of the sets that `hub_links` has decided."""
    labelled = _labelled(sketches.select("node", "n", "prefix"), found)
    mixed_lists = materialize(
        labelled.select("component", F.explode("prefix").alias("h")).groupBy("h").agg(
            F.min("component").alias("c0"), F.max("component").alias("c1")
        ).filter("c0 <> c1").select("h"),
        "lists",
    )
    # Most entries are in no such list; a bit map drops nearly all of these where they are read, the join the rest.
    entries = marked_entries(labelled.join(hubs, "node", "left").select("node", "n", "component", "hub", "prefix"), *list_marks(mixed_lists))
    used = materialize(entries.join(checked_broadcast(mixed_lists), "h", "left_semi"), "entries")
    names = ("node", "n", "component", "hub", "at")
    left = used.select("h", *(F.col(c).alias(f"{c}_a") for c in names))
    right = used.select("h", *(F.col(c).alias(f"{c}_b") for c in names))
    met = left.join(right, "h").filter(
        (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
        & ~F.coalesce(F.col("hub_a") == F.col("hub_b"), F.lit(False))
        # Of a pair only the prefixes count that its own sizes ask for.
        & ((num + den) * (F.col("n_a") - F.col("at_a")) >= num * (F.col("n_a") + F.col("n_b")))
        & ((num + den) * (F.col("n_b") - F.col("at_b")) >= num * (F.col("n_a") + F.col("n_b")))
        & (F.greatest("n_a", "n_b") > boundary)
    )
    shared = met.groupBy("node_a", "node_b").agg(
        F.count("*").alias("c"), F.max("at_a").alias("i"), F.max("at_b").alias("j"), F.first("n_a").alias("s"), F.first("n_b").alias("t")
    )
    most = F.col("c") + F.least(F.col("s") - F.col("i") - 1, F.col("t") - F.col("j") - 1)
    return shared.filter((num + den) * most >= num * (F.col("s") + F.col("t"))).select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b")
    )


def _id_links(copies: DataFrame, nodes: DataFrame, every: DataFrame) -> DataFrame:
    """Links (a, b) among the nodes of one doc_id's texts. copies: rows whose node is another doc_id."""
    others = copies.select("doc_id", "node").distinct()
    # The doc_id stands for a text of its own that is a node, or has no words.
    own = nodes.select(F.col("node").alias("doc_id")).unionByName(every.filter("n = 0").select("doc_id"))
    ids = materialize(others.select("doc_id").distinct(), "ids")
    own = own.join(checked_broadcast(ids), "doc_id", "left_semi").distinct().withColumn("node", F.col("doc_id"))
    texts = materialize(others.unionByName(own), "texts")
    least = texts.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b <> last").select("doc_id", "b")
    return texts.join(least, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b")


def join(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    frequent, length = _frequent(_sample(docs, size))
    every = materialize(_sketches(docs, size, frequent, num, den), "sketches")
    known = every.filter("n > 0 and doc_id is not null")
    classes = materialize(known.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.first("n").alias("n")), "classes")
    nodes = classes.select("node", "n").distinct()

    # Boundary between light and heavy sets.
    small = {r["n"]: r["c"] for r in nodes.filter(F.col("n") <= LARGEST_LIGHT).groupBy("n").agg(F.count("*").alias("c")).collect()}
    beyond = nodes.filter(F.col("n") > LARGEST_LIGHT).agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0]
    boundary = choose_boundary(small, float(beyond or 0), length, num, den)
    light = materialize(nodes.filter(F.col("n") <= boundary).select("node"), "light")
    links = materialize(_light_links(light, docs, size, boundary, num, den), "links")

    copies = materialize(
        known.select("doc_id", "hi", "lo").join(classes.select("hi", "lo", "node"), ["hi", "lo"])
        .filter("doc_id <> node").distinct(), "copies",
    )
    links = materialize(links.unionByName(_id_links(copies, nodes, every)), "links")
    lightest = next(n for n in range(1, boundary + 2) if den * n >= num * (boundary + 1))
    originals = known.filter(F.col("n") >= lightest).join(
        checked_broadcast(copies.select("doc_id", "hi", "lo")), ["doc_id", "hi", "lo"], "left_anti"
    )
    sketches = originals.select(F.col("doc_id").alias("node"), "n", "prefix", "bands")
    bands = sketches.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1")
    bands = materialize(bands.join(shared, "band"), "bands")
    scores = bands.groupBy("node").agg(F.sum("k").alias("score"))
    bands = materialize(bands.select("node", "band").join(scores, "node"), "bands")

    found = materialize(components(links), "components")
    pairs = materialize(hub_pairs(bands, found), "pairs")
    tried = materialize(compared(docs, pairs, size, num, den), "tried")
    members = materialize(hub_members(tried, num, den), "members")
    found = extended(found, tried.filter("linked").select("a", "b").unionByName(hub_stars(members)))
    found = extended(found, hub_links(members, found, num, den))
    # A doc_id with several texts is left to the lists.
    once = tried.groupBy(F.col("a").alias("node")).count().filter("count = 1").select("node")
    hubs = materialize(members.filter("node <> hub").select("node", "hub").join(once, "node", "left_semi"), "hubs")
    open_pairs = materialize(list_pairs(sketches, found, hubs, boundary, num, den), "pairs")
    for tries in (*TRIES, None):
        pairs = materialize(next_pairs(open_pairs, found, tries), "pairs")
        if pairs.isEmpty():
            break
        likely = materialize(possible(known, pairs, num, den), "likely")
        found = extended(found, verified(docs, likely, size, num, den))
        if tries is not None:
            open_pairs = materialize(open_pairs.join(pairs, ["a", "b"], "left_anti"), "pairs")

    members = every.select("doc_id", "n", "hi", "lo").join(classes.select("hi", "lo", "node"), ["hi", "lo"], "left")
    return members.select("doc_id", "n", F.coalesce("node", "doc_id").alias("node")).join(found, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"),
    )
